"""Pilot search: the one step of a build that is sequential within a partition.

Buckets are placed one after the other, but what costs time, trying pilots,
is done for many at once: for a block of buckets of every partition of a
group, numpy finds the first pilots that are free as things stand; then each
bucket takes the first of its own that still is. The result depends on the
keys, the seed and the options only, never on input order, grouping, block
size or parallelism.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.arith import np_mix, np_remap

MOST_CELLS = 1 << 18  #: pilots tried in one step, over all buckets of a block
BLOCK_BUCKETS = 512  #: buckets of a block, over all partitions
MOST_FINDS = 16  #: free pilots kept of a bucket at a time
MAX_BUCKET = 255

RESULT = "pid long, n long, m long, pilots array<long>, above array<long>, gaps array<long>, max_pilot long, empty_buckets long, largest_bucket long, problem string"


def _finds(keys: np.ndarray, start: np.ndarray, width: int, room: np.ndarray, offset: np.ndarray, shift: int | None, taken: np.ndarray) -> tuple[list[list[tuple[int, list[int]]]], np.ndarray]:
    """For each bucket (a row of ``keys``) its first pilots from ``start`` on that reach free places of their own, with the places; and the pilot to go on from."""

    def place(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(shift) if shift is not None else np_remap(x, m)).astype(np.int64)

    rows, k = keys.shape
    spread = np_mix((start[:, None] + np.arange(width)).astype(np.uint64))
    seen = place(np_mix(keys[:, 0][:, None] ^ spread), room[:, None]) + offset[:, None]
    row, col = np.nonzero(taken[seen] == 0)
    places = [seen[row, col]]
    for j in range(1, k):  # most pilots fail at the first keys already
        spot = place(np_mix(keys[row, j] ^ spread[row, col]), room[row]) + offset[row]
        fine = taken[spot] == 0
        row, col, spot = row[fine], col[fine], spot[fine]
        places = [x[fine] for x in places] + [spot]
    slots = np.column_stack(places)
    if k > 1:
        ordered = np.sort(slots, axis=1)
        good = (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
        row, col, slots = row[good], col[good], slots[good]
    first = np.searchsorted(row, np.arange(rows + 1))
    until = start + width
    own = np.arange(len(row)) - first[row]
    some = own < MOST_FINDS
    cut = np.flatnonzero(own == MOST_FINDS)
    until[row[cut]] = start[row[cut]] + col[cut]
    found: list[list[tuple[int, list[int]]]] = [[] for _ in range(rows)]
    for r, pilot, spots in zip(row[some].tolist(), (start[row[some]] + col[some]).tolist(), slots[some].tolist(), strict=True):
        found[r].append((pilot, spots))
    return found, until


def search(pid: np.ndarray, bucket: np.ndarray, payload: np.ndarray, sizes: dict[int, int], buckets: int, max_pilot: int = 1 << 34) -> dict[int, dict]:
    """Pilots of some partitions: pid -> {n, m, pilots, taken, largest, problem}.

    ``sizes``: slots of each partition. Buckets are placed by size (largest
    first), then number (largest first); each takes the smallest pilot that
    sends its keys to free slots of their own.
    """
    order = np.lexsort((payload, bucket, pid))
    pid, bucket, payload = pid[order], bucket[order], payload[order]
    twin = (pid[1:] == pid[:-1]) & (bucket[1:] == bucket[:-1]) & (payload[1:] == payload[:-1])
    edge = np.concatenate(([True], (pid[1:] != pid[:-1]) | (bucket[1:] != bucket[:-1])))[: len(pid)]
    start = np.flatnonzero(edge)
    length = np.diff(np.append(start, len(pid)))
    part, number = pid[start], bucket[start]
    order = np.lexsort((-number, -length, part))
    start, length, part, number = start[order], length[order], part[order], number[order]
    parts, first, count = np.unique(part, return_index=True, return_counts=True)
    n_of = np.add.reduceat(length, first) if len(parts) else np.zeros(0, np.int64)
    m = np.array([sizes[p] for p in parts.tolist()], np.int64)
    base = np.concatenate(([0], np.cumsum(m)))
    held = bytearray(int(base[-1]))
    taken = np.frombuffer(held, np.uint8)  # the same bytes, for numpy
    pilots = np.zeros((len(parts), buckets), np.int64)
    problem: list[str | None] = [None] * len(parts)
    for p in np.unique(pid[1:][twin]).tolist() if len(pid) > 1 else []:
        problem[int(np.searchsorted(parts, p))] = "duplicate"
    for k in range(len(parts)):
        if length[first[k]] > MAX_BUCKET and not problem[k]:
            problem[k] = "bucket"
        if n_of[k] > m[k] and not problem[k]:
            problem[k] = "slots"
    same = len(parts) > 0 and (m == m[0]).all() and int(m[0]).bit_count() == 1
    shift = 64 - (int(m[0]).bit_length() - 1) if same and m[0] > 1 else None
    filled = np.zeros(len(parts), np.int64)
    alive = np.array([x is None for x in problem], bool)
    block = max(1, BLOCK_BUCKETS // max(1, len(parts)))
    for low in range(0, int(count.max()) if len(count) else 0, block):
        on = np.flatnonzero(alive & (count > low))
        runs = [np.arange(first[k] + low, first[k] + min(low + block, count[k])) for k in on.tolist()]
        rows = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        of = np.repeat(on, [len(x) for x in runs]) if runs else rows
        for k in np.unique(length[rows])[::-1].tolist():
            here = (length[rows] == k) & alive[of]
            line, owner = rows[here], of[here]
            if not len(line):
                continue
            free = float(max(1e-9, 1 - (filled[owner] / m[owner]).max())) ** k
            width = int(min(max(4, 2 / free), max(4, MOST_CELLS // len(line))))
            keys = payload[start[line][:, None] + np.arange(k)]
            finds, until = _finds(keys, np.zeros(len(line), np.int64), width, m[owner], base[owner], shift, taken)
            goes = np.zeros(len(line), np.int64)  # how often a bucket ran out of finds
            ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(line)).tolist()
            at = [0, *ends[:-1]]  # the next bucket of each partition
            while True:
                stuck = []
                for q, end in enumerate(ends):
                    i = at[q]
                    while i < end:
                        for pilot, spots in finds[i]:
                            if not any(held[x] for x in spots):
                                for x in spots:
                                    held[x] = 1
                                pilots[owner[i], number[line[i]]] = pilot
                                break
                        else:
                            stuck.append(i)
                            break
                        i += 1
                    at[q] = i
                if not stuck:
                    break
                w = np.array(stuck)
                goes[w] += 1
                if (over := until[w] > max_pilot).any():
                    for x in owner[w[over]].tolist():
                        problem[x] = "pilot"
                        alive[x] = False
                    for q, end in enumerate(ends):
                        if not alive[owner[end - 1]]:
                            at[q] = end
                    w = w[~over]
                if len(w):
                    wide = int(min(width << min(30, int(goes[w].max()) - 1), max(4, MOST_CELLS // len(w))))
                    more, upto = _finds(keys[w], until[w], wide, m[owner[w]], base[owner[w]], shift, taken)
                    until[w] = upto
                    for i, x in zip(w.tolist(), more, strict=True):
                        finds[i] = x
            np.add.at(filled, owner, k)
    out = {}
    for k, p in enumerate(parts.tolist()):
        out[p] = {
            "n": int(n_of[k]), "m": int(m[k]), "pilots": pilots[k], "taken": np.flatnonzero(taken[base[k] : base[k + 1]]),
            "largest": int(length[first[k]]), "empty": buckets - int(count[k]), "problem": problem[k],
        }
    return out


def spare(taken: np.ndarray, m: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The used places from ``limit`` on and the unused ones below it: what a minimal function has to redirect, and to where."""
    free = np.ones(max(0, min(limit, m)), bool)
    free[taken[taken < limit]] = False
    return taken[taken >= limit], np.flatnonzero(free)


def kernel(slots: int | None, alpha: float, buckets: int, max_pilot: int, n_all: int):
    """The function that Spark applies to each group of partitions: (pid, bucket, payload) rows to one row per partition.

    With ``slots`` (dense) the positions of all partitions count on and are
    to end below ``n_all``; without, each partition's end below its own n.
    """

    def run(group: pa.Table) -> pa.Table:
        pid, bucket, payload = (group.column(c).to_numpy() for c in ("pid", "bucket", "payload"))
        known, n = np.unique(pid, return_counts=True)
        sizes = {p: slots or int(k / alpha) for p, k in zip(known.tolist(), n.tolist(), strict=True)}
        found = search(pid, bucket, payload.view(np.uint64), sizes, buckets, max_pilot)
        rows = list(found.items())
        moved = [spare(x["taken"], x["m"], n_all - p * slots if slots else x["n"]) for p, x in rows]
        lists = pa.list_(pa.int64())
        return pa.table({
            "pid": pa.array([p for p, _ in rows], pa.int64()), "n": pa.array([x["n"] for _, x in rows], pa.int64()), "m": pa.array([x["m"] for _, x in rows], pa.int64()),
            "pilots": pa.array([x["pilots"] for _, x in rows], lists), "above": pa.array([a for a, _ in moved], lists), "gaps": pa.array([g for _, g in moved], lists),
            "max_pilot": pa.array([int(x["pilots"].max(initial=0)) for _, x in rows], pa.int64()), "empty_buckets": pa.array([x["empty"] for _, x in rows], pa.int64()),
            "largest_bucket": pa.array([x["largest"] for _, x in rows], pa.int64()), "problem": pa.array([x["problem"] for _, x in rows], pa.string()),
        })

    return run
