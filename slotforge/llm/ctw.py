"""Context-tree weighting over bytes: code lengths from Krichevsky-Trofimov estimates mixed over all depths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, written

DEPTH = 5  #: context bytes; a gram is the context and the byte it predicts
BUCKET_BYTES = 12_000_000  #: text that one task group holds at a time
GROUP_GRAMS = 100_000  #: distinct grams whose nodes a task holds at a time, but for a subtree with more
LEAST_PARTS = 64  #: parts that the subtrees are dealt to; a quarter of the buckets if that is more
END = b"\n"  #: closes a text, and pads the context before its first byte
LOG_HALF = float(np.log(0.5))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: shifted up to 8 and more, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = shift + np.where(low, np.log(np.where(low, y, 1.0)), 0.0)
        y = np.where(low, y + 1, y)
    inverse = 1 / y
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260 - inverse**2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a bit sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def stop_weight(own: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Posterior weight that the tree source stops at a node."""
    return np.minimum(1.0, np.exp(LOG_HALF + own - mixed))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def stream(words: list[bytes]) -> bytes:
    """The bytes that are coded: lower-cased words parted by one blank, then END."""
    return b" ".join(words) + END


def grams(coded: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte of ``coded``: the ``depth`` bytes before it and itself, as one number."""
    flat = np.frombuffer(END * depth + coded, np.uint8).astype(np.int64)
    n = len(coded)
    out = np.zeros(n, np.int64)
    for j in range(depth + 1):
        out = (out << 8) | flat[j : j + n]
    return out


class _Levels:
    """The binary nodes of grams at context depths 2 to ``depth``; holds whole subtrees below contexts of two bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        byte = keys & 0xFF
        steps = np.arange(8)
        self.bit = (byte[:, None] >> (7 - steps)) & 1
        node = (1 << steps) | (byte[:, None] >> (8 - steps))
        weight = np.repeat(counts.astype(float), 8)
        bit = self.bit.ravel()
        self.at, self.node, self.zeros, self.ones, self.first = [], [], [], [], []
        for d in range(2, depth + 1):
            context = (keys >> 8) & ((1 << 8 * d) - 1)
            found, first, at = np.unique((context[:, None] << 8 | node).ravel(), return_index=True, return_inverse=True)
            self.at.append(at)
            self.first.append(first)
            self.node.append(found & 0xFF)
            if d == 2:
                self.last = (found >> 8) & 0xFF
            self.ones.append(np.bincount(at, weight * bit, len(found)))
            self.zeros.append(np.bincount(at, weight * (1 - bit), len(found)))
        self.own = [log_kt(z, o) for z, o in zip(self.zeros, self.ones, strict=True)]
        self.mixed = [None] * len(self.own)
        self.mixed[-1] = self.own[-1]
        for k in range(len(self.own) - 2, -1, -1):
            below = np.bincount(self.at[k][self.first[k + 1]], self.mixed[k + 1], len(self.own[k]))
            self.mixed[k] = LOG_HALF + np.logaddexp(self.own[k], below)

    def predict(self) -> np.ndarray:
        """Probability of a one at each node of each gram (flat, 8 per gram), below depth 1."""
        p = kt_one(self.zeros[-1], self.ones[-1])[self.at[-1]]
        for k in range(len(self.own) - 2, -1, -1):
            w = stop_weight(self.own[k], self.mixed[k])[self.at[k]]
            p = w * kt_one(self.zeros[k], self.ones[k])[self.at[k]] + (1 - w) * p
        return p


@dataclass
class Top:
    """What depths 0 and 1 contribute to a node: share (of the prediction made there) and rest (the weight that deeper ones get)."""

    share: np.ndarray  # 256 last bytes x 256 nodes
    rest: np.ndarray

    @classmethod
    def of(cls, last: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Top:
        z, o, deep = (np.zeros((256, 256)) for _ in range(3))
        z[last, node], o[last, node], deep[last, node] = zeros, ones, below
        own1 = log_kt(z, o)
        mixed1 = LOG_HALF + np.logaddexp(own1, deep)
        z0, o0 = z.sum(axis=0), o.sum(axis=0)
        own0 = log_kt(z0, o0)
        w0 = stop_weight(own0, LOG_HALF + np.logaddexp(own0, mixed1.sum(axis=0)))
        w1 = stop_weight(own1, mixed1)
        return cls(w0 * kt_one(z0, o0) + (1 - w0) * w1 * kt_one(z, o), (1 - w0) * (1 - w1))


def _part(keys: np.ndarray, groups: int) -> np.ndarray:
    """The part of each gram: whole subtrees below contexts of two bytes stay together."""
    sub = ((keys >> 8) & 0xFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((sub >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def _pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Rising grams and their counts: differences, byte by byte of all numbers, compressed."""
    both = np.concatenate([np.diff(keys, prepend=0), n]).astype("<i8")
    return pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 16 * size, codec="zstd", asbytes=True), np.uint8).reshape(8, 2 * size)
    both = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return np.cumsum(both[:size]), both[size:]


def _by_part(keys: np.ndarray, n: np.ndarray, groups: int) -> tuple[list[int], list[int], list[bytes]]:
    """(part, size, packed grams and counts) of rising grams."""
    part = _part(keys, groups)
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    cuts = np.split(order, first[1:]) if len(order) else []
    return found.tolist(), list(map(len, cuts)), [_pack(keys[c], n[c]) for c in cuts]


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams subtree by subtree, their counts, the place there of each gram of each row, where each row ends)."""
    size = group.column("size").to_pylist()
    held = [_unpack(d, k) for d, k in zip(group.column("grams").to_pylist(), size, strict=True)]
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    n = np.bincount(at, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
    order = np.argsort((keys >> 8) & 0xFFFF, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], n[order], place[at], np.cumsum(size)


def _subtrees(keys: np.ndarray, most: int) -> list[slice]:
    """Runs of whole subtrees with about ``most`` grams."""
    starts = np.flatnonzero(np.diff((keys >> 8) & 0xFFFF, prepend=-1))
    cuts = [0]
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        if end - cuts[-1] > most and start > cuts[-1]:
            cuts.append(start)
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]


def coded_parts(packed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(bucket, size, grams, lps): ``packed`` (bucket, part, size, grams) with log10 probabilities of each gram's byte after its context.

    Counts are summed over all buckets; grams with n = 0 are scored from what
    training has seen of their context. A row has the grams of one bucket and
    part, so no row is made or joined per gram. The tree is cut at contexts of
    two bytes: a part holds whole subtrees, and the two depths above are a
    table of at most 256 x 255 rows, which is what the driver holds and
    broadcasts.
    """
    most = GROUP_GRAMS

    def up(group: pa.Table) -> pa.Table:
        keys, n, _, _ = _merged(group)
        sums = np.zeros((3, 256 * 256))
        for cut in _subtrees(keys, most):
            levels = _Levels(keys[cut], n[cut], depth)
            at = levels.last << 8 | levels.node[0]
            for row, values in zip(sums, (levels.zeros[0], levels.ones[0], levels.mixed[0]), strict=True):
                row += np.bincount(at, values, 256 * 256)
        at = np.flatnonzero(sums.any(axis=0))
        return pa.table({"last": at >> 8, "node": at & 0xFF, "zeros": sums[0, at], "ones": sums[1, at], "below": sums[2, at]})

    sums = packed.select("part", "size", "grams").groupBy("part").applyInArrow(up, "last long, node long, zeros double, ones double, below double")
    rows = sums.groupBy("last", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    top = Top.of(*(rows.column(c).to_numpy() for c in ("last", "node", "zeros", "ones", "below")))
    shared = packed.sparkSession.sparkContext.broadcast((top.share, top.rest))

    def down(group: pa.Table) -> pa.Table:
        keys, n, place, ends = _merged(group)
        share, rest = shared.value
        lp = np.empty(len(keys))
        for cut in _subtrees(keys, most):
            levels = _Levels(keys[cut], n[cut], depth)
            at = levels.last[levels.at[0]], levels.node[0][levels.at[0]]
            one = (share[at] + rest[at] * levels.predict()).reshape(-1, 8)
            lp[cut] = np.log10(np.where(levels.bit == 1, one, 1 - one)).sum(axis=1)
        lps = [pa.compress(lp[at].astype("<f8"), codec="zstd", asbytes=True) for at in np.split(place, ends[:-1])]
        return pa.table({"bucket": group.column("bucket"), "size": group.column("size"), "grams": group.column("grams"), "lps": pa.array(lps, pa.binary())})

    return packed.groupBy("part").applyInArrow(down, "bucket long, size long, grams binary, lps binary")


def _lengths(size: list[int], grams_of: list[bytes], lps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, log10 probabilities) of rows of ``coded_parts``, grams rising."""
    keys = np.concatenate([np.zeros(0, np.int64), *(_unpack(d, k)[0] for d, k in zip(grams_of, size, strict=True))])
    values = np.concatenate([np.zeros(0), *(np.frombuffer(pa.decompress(d, 8 * k, codec="zstd", asbytes=True), "<f8") for d, k in zip(lps, size, strict=True))])
    order = np.argsort(keys)
    return keys[order], values[order]


def code_lengths(gram_counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, lp): log10 probability of each gram's byte after its context, from (gram, n) over the whole corpus."""
    groups = max(LEAST_PARTS, -(-gram_counts.count() // GROUP_GRAMS))
    sub = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    keyed = gram_counts.select("gram", "n", F.pmod(F.xxhash64(sub), F.lit(groups)).alias("part"))

    def pack(group: pa.Table) -> pa.Table:
        keys, n = group.column("gram").to_numpy(), group.column("n").to_numpy()
        order = np.argsort(keys)
        return pa.table({"bucket": [0], "part": [group.column("part")[0].as_py()], "size": [len(keys)], "grams": pa.array([_pack(keys[order], n[order])], pa.binary())})

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lps = _lengths(*(batch.column(c).to_pylist() for c in ("size", "grams", "lps")))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lps)], names=["gram", "lp"])

    return coded_parts(keyed.groupBy("part").applyInArrow(pack, "bucket long, part long, size long, grams binary"), depth).mapInArrow(flat, "gram long, lp double")


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(bucket, id, held, text) and the number of buckets: rows dealt at random to buckets of about BUCKET_BYTES of text; the same each time."""
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False))
    n = -(-size // BUCKET_BYTES) or 1
    return picked.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).alias("bucket"), F.col("id").cast("long").alias("id"), held.alias("held"), "text"), n


PARTS = "bucket long, token binary, n long, part long, size long, grams binary"


def parts(rows: DataFrame, depth: int, groups: int) -> DataFrame:
    """Per bucket, each distinct token with its count in training texts, and one row of all distinct grams of a part with theirs. END stands for the end token."""

    def run(group: pa.Table) -> pa.Table:
        bucket, held = group.column("bucket")[0].as_py(), group.column("held").to_pylist()
        counts: Counter[bytes] = Counter()
        keys, sums = [], []
        for at, texts in slices(as_bytes(group.column("text")), 4_000_000):
            coded = {True: [], False: []}
            for text, out in zip(texts, held[at : at + len(texts)], strict=True):
                words = tokens(text)
                if out:
                    counts.update(dict.fromkeys(words, 0))
                    counts.setdefault(END, 0)
                else:
                    counts.update(words)
                    counts[END] += 1
                coded[out].append(grams(stream(words), depth))
            for out, found in coded.items():
                if found:
                    key, n = np.unique(np.concatenate(found), return_counts=True)
                    keys.append(key)
                    sums.append(n * (not out))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(sums), len(key)).astype(np.int64)
        part, size, packed = _by_part(key, n, groups)
        blank, spelled = [None] * len(counts), [None] * len(part)
        return pa.table({
            "bucket": np.full(len(counts) + len(part), bucket, np.int64), "token": pa.array([*counts, *spelled], pa.binary()), "n": pa.array([*counts.values(), *spelled], pa.int64()),
            "part": pa.array([*blank, *part], pa.int64()), "size": pa.array([*blank, *size], pa.int64()), "grams": pa.array([*blank, *packed], pa.binary()),
        })

    return rows.groupBy("bucket").applyInArrow(run, PARTS)


SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _sums(texts: list[bytes], keys: np.ndarray, lps: np.ndarray, depth: int) -> np.ndarray:
    """For each coded text, the sum of its grams' log probabilities: grams are sorted together, each distinct one is looked up once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    key, text = np.concatenate([grams(t, depth) for t in texts]), np.repeat(np.arange(len(texts)), sizes)
    if depth <= 5 and len(texts) <= 1 << 15:  # 48 and 15 bits sort as one number
        mixed = np.sort((key << 15) | text)
        key, text = mixed >> 15, mixed & ((1 << 15) - 1)
    else:
        order = np.argsort(key)
        key, text = key[order], text[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    at = np.searchsorted(keys, key[first])
    if not (keys[at] == key[first]).all():
        raise KeyError("a gram without a code length")
    return np.bincount(text, np.repeat(lps[at], np.diff(np.append(first, len(key)))), len(texts))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes): one row per input row.

    Learns from the rows whose crc32 of the id as text leaves no remainder 1
    by 5 and scores all rows. A text is its lower-cased (A-Z) words and one
    end; ``score`` is the log10 probability of those, coded byte by byte with
    each byte's eight bits weighted over context depths 0 to ``depth``;
    -score / n_bytes * log2(10) is the code length per byte. Null text: empty.
    Null id: training. Repeated rows count each. No rows give no rows. Columns
    other than the id and the text are not read.
    """
    rows, buckets = bucketed(docs, id_col, text_col)
    found = written(parts(rows, depth, max(LEAST_PARTS, buckets // 4)), "ctw-parts")
    words = found.where("token is not null").select("bucket", "token", "n")
    vocabulary = written(words.groupBy("token").agg(F.sum("n").alias("c")), "ctw-vocabulary")
    total, distinct = vocabulary.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total = total or 0
    coded = coded_parts(found.where("token is null").select("bucket", "part", "size", "grams"), depth)
    known = words.join(vocabulary, "token").select("bucket", "token", F.col("c").alias("n"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("lps"))
    facts = known.union(coded.select("bucket", F.lit(None).cast("binary").alias("token"), F.lit(None).cast("long").alias("n"), "size", "grams", "lps"))
    norm = float(np.log10(total + 0.5 * (distinct + 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = right.column("token").is_valid()
        tokens_of, spelled = right.filter(is_word), right.filter(pc.invert(is_word))
        counts = dict(zip(tokens_of.column("token").to_pylist(), tokens_of.column("n").to_pylist(), strict=True))
        keys, lps = _lengths(*(spelled.column(c).to_pylist() for c in ("size", "grams", "lps")))
        keys, lps = np.append(keys, np.iinfo(np.int64).max), np.append(lps, 0.0)
        n_tokens, n_known, base, score, n_bytes = [], [], [], [], []
        for _, texts in slices(as_bytes(left.column("text")), 2_000_000):
            streams = []
            for text in texts:
                split = tokens(text)
                c = np.fromiter(map(counts.__getitem__, split), float, len(split))
                c = np.append(c, counts[END])
                n_tokens.append(len(c))
                n_known.append(int((c > 0).sum()))
                base.append(float(np.log10(c + 0.5).sum() - len(c) * norm))
                streams.append(stream(split))
            n_bytes += map(len, streams)
            score += _sums(streams, keys, lps, depth).tolist()
        return pa.table({
            "id": left.column("id"), "held_out": left.column("held"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()), "n_bytes": pa.array(n_bytes, pa.int64()),
        })

    scored = rows.groupBy("bucket").cogroup(facts.groupBy("bucket")).applyInArrow(run, SCORES)
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")
