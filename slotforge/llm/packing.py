"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, written

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 50_000  #: pieces packed by one task group
OVERHEAD = 16  #: cost of a sequence besides its length, in tokens


def best_fit(lengths: list[int], capacities: list[int], overhead: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Best-fit decreasing over lengths sorted from longest to shortest.

    A piece goes to the open bin with the least room that takes it. Otherwise
    a bin opens: of the permitted sizes, the one that costs least for each
    token it can still be given, counting what later pieces can fill of the
    room beside this one; the smaller at a tie. At last each bin shrinks to
    the smallest permitted size that holds its contents.
    Returns the bin and the offset of each piece, and the size and the
    contents of each bin.
    """
    n = len(lengths)
    after = np.concatenate((np.cumsum(np.array(lengths, np.int64)[::-1])[::-1], [0]))
    falling = -np.array(lengths, np.int64)
    room_of: dict[int, list[int]] = {}
    rooms = 0  # bit r: some open bin has room r
    bins, offsets, used, size = [0] * n, [0] * n, [], []
    for i, length in enumerate(lengths):
        if fits := rooms >> length:
            room = length + (fits & -fits).bit_length() - 1
            stack = room_of[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            best = None
            for c in capacities:
                if c >= length:
                    first = max(i + 1, int(np.searchsorted(falling, length - c)))  # the first later piece that fits beside
                    fill = min(c - length, int(after[first]))
                    cost = (c + overhead) / (length + fill)
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, c)
            b, room = len(used), best[1]
            used.append(0)
            size.append(best[1])
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        if left := room - length:
            room_of.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, [min(c for c in capacities if c >= u) for u in used], used


def pieces(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, piece, start, length, salt): each document's words and one end, cut into pieces of at most ``most`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                total = len((text or b"").split()) + 1
                for piece, start in enumerate(range(0, total, most)):
                    rows.append((i, piece, start, min(most, total - start), salt))
                    salt += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "piece", "start", "length", "salt"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, piece long, start long, length long, salt long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(id, piece, start, length, bin_id, offset, bin_size, bin_used): where each piece of each document goes.

    A document is its words and one end token; one longer than the largest
    size is cut there and each piece is packed, so no token is lost. Pieces
    are dealt to shards of about ``shard_pieces`` at random (fixed once
    written) and each shard is packed alone. A null or empty text is its end
    token; repeated rows are packed each; null ids stay null; no rows, no bins.
    """
    sizes = sorted({int(c) for c in capacities})
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    cut = written(pieces(docs, id_col, text_col, sizes[-1]), "packing-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        bins, offsets, size, used = best_fit(group.column("length").to_pylist(), sizes, overhead)
        base = group.column("shard")[0].as_py() << 32
        at = np.array(bins, np.int64)
        return pa.table({
            **{c: group.column(c) for c in ("id", "piece", "start", "length")}, "bin_id": pa.array(at + base), "offset": pa.array(offsets, pa.int64()),
            "bin_size": pa.array(np.array(size, np.int64)[at]), "bin_used": pa.array(np.array(used, np.int64)[at]),
        })

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "salt"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(run, "id long, piece long, start long, length long, bin_id long, offset long, bin_size long, bin_used long")
