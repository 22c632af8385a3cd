"""SimHash near-duplicates linked through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, connected_components, flips, removed, written

BITS = 64


def text_fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit value. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t or b"", shingle, seed) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any two values at most ``radius`` bits apart agree on all of one mask.

    Bit i gets a vector m(i) of radius+1 binary digits; mask v has the bits
    whose m(i) has an odd dot product with v. ``radius`` differing bits put
    that many linear conditions on v, and radius+1 digits leave a solution
    other than zero. If there are odd vectors enough the bits get those, so
    that no mask has fewer than half of the bits.
    """
    width = radius + 1
    odd = bits <= 1 << width - 1
    vectors = [2 * i + 1 if odd else 1 + i % ((1 << width) - 1) for i in range(bits)]
    masks = []
    for v in range(1, 1 << width):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1)
        masks.append(mask)
    return masks


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) edges whose components are those of "at most ``radius`` bits apart" over the column ``fp``.

    Values that collide under a covering mask are expanded to the points within
    radius/2 bits outside the mask. Two values share such a point exactly if
    they are within the radius, and a point has few values around it (65 for
    radius 2), so a bucket of any size costs a constant per member: no pairs
    of a bucket are listed and none is lost. Each value links to the smallest
    one around the point.
    """
    if radius % 2 or not 0 <= radius <= 6:
        raise ValueError("radius must be 0, 2, 4 or 6")
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    around = [flips([i for i in range(BITS) if not m >> i & 1], radius // 2) for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").count().where("count > 1").select("t", "key")
    hit = keyed.join(shared, ["t", "key"], "left_semi")
    parts = [
        hit.where(F.col("t") == t).select("fp", F.explode(F.transform(F.array(*[F.lit(x) for x in own]), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
        for t, own in enumerate(around)
    ] if radius > 2 else [
        hit.select("fp", F.explode(F.transform(F.element_at(F.array(*[F.array(*[F.lit(x) for x in own]) for own in around]), F.col("t") + 1), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    ]
    points = parts[0]
    for more in parts[1:]:
        points = points.union(more)
    points = points.distinct()
    least = F.min("fp").over(Window.partitionBy("point"))
    return points.select("fp", least.alias("low")).where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(id, fp, component): one row per input row, with the smallest id reachable over links.

    Rows with a null or empty text have fingerprint 0 and link like others.
    Repeated rows stay and share a component; null ids are no candidates for
    the smallest id (a component of null ids only has a null id). Columns other
    than the id and the text are not read, so clashing names do no harm.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-values")
    roots = connected_components(links(distinct, radius), "simhash-links")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    label = rooted.join(least, "root").select("fp", "component")
    return fps.join(label, "fp").select("id", "fp", "component")


SIMILAR = 0.8  #: shared share of the five-word shingles of near copies
SHINGLE = 5
CANDIDATE_RADIUS = 6
ALL_PAIRS = 16  #: texts of a bucket whose pairs are all compared at once
AT_ONCE = 4  #: others that each text of a larger bucket is compared with at first; four times as many in each further round
PIECE = 20_000  #: texts of a bucket that the first round looks at together
BINS = 64  #: counters of a text's sketch
FULL = 255  #: a counter that may stand for more


def pairs_fingerprint(text: bytes, seed: int = 42) -> int:
    """SimHash of the distinct pairs of neighbouring words of a text (a single word: that): few bits apart for near copies in terms of longer shingles, many for other texts, whose common words hardly meet in the same pairs."""
    words = text.lower().split()
    pairs = list({a + b" " + b for a, b in zip(words, words[1:], strict=False)} or words)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(pairs), 65536):
        h = np.array([xxhash.xxh64_intdigest(w, seed) for w in pairs[at : at + 65536]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(pairs), bitorder="little").tobytes(), "little", signed=True)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole text if it is shorter; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))], np.uint64).view(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(shingles: np.ndarray) -> bytes:
    """How many of the shingle hashes fall into each of BINS ranges of hashes, FULL at most."""
    counts = np.bincount((shingles.view(np.uint64) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def may_be_similar(n: np.ndarray, sk: np.ndarray, m: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles can reach the similarity, by their sketches: false only if they can't.

    Two sets share no more than the smaller count of each bin, and need
    similarity / (1 + similarity) of their summed sizes. Bins that are FULL on
    both sides set no bound.
    """
    low = np.minimum(sk, other)
    return (low.sum(axis=1, dtype=np.int64) * (1 + similarity) >= similarity * (n + m) - 1e-9) | (low == FULL).any(axis=1)


def buckets(texts: DataFrame, radius: int) -> DataFrame:
    """(k, h, fp): the places where two or more of the texts (h, fp) collide under a covering mask."""
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    keyed = texts.select("h", "fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("t", "mask")).select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "h", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, False  # the last row of all, and whether it has gone out
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in range(3)]
            if last is not None:
                rows = [np.concatenate(([x], c)) for x, c in zip(last, rows, strict=True)]
            same = rows[0][1:] == rows[0][:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            if last is not None and told:
                shared[0] = False
            at = np.flatnonzero(shared)
            told = bool(shared[-1]) if len(shared) > 1 or last is None else told
            last = [c[-1] for c in rows]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in rows], names=["k", "h", "fp"])

    return keyed.repartition("k").sortWithinPartitions("k").mapInArrow(run, "k long, h long, fp long")


def _small(k: np.ndarray, h: np.ndarray, fp: np.ndarray, n: np.ndarray, sk: np.ndarray, size: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of buckets of ALL_PAIRS texts at most that are within the radius and may be similar, for rows that are sorted by bucket."""
    left, right = [], []
    for d in range(1, ALL_PAIRS):
        if len(k) <= d:
            break
        at = np.flatnonzero((k[d:] == k[:-d]) & (size[d:] <= ALL_PAIRS) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius))
        at = at[may_be_similar(n[at], sk[at], n[at + d], sk[at + d], similarity)]
        left.append(h[at])
        right.append(h[at + d])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _large(h: np.ndarray, fp: np.ndarray, n: np.ndarray, sk: np.ndarray, label: np.ndarray, known: list, radius: int, similarity: float, at_once: int) -> list[tuple[int, int]]:
    """Pairs of a large bucket's texts to compare: within the radius, perhaps similar, not joined yet (by label), not compared yet.

    The largest group is only compared with the others' texts, not within itself.
    """
    labels, counts = np.unique(label, return_counts=True)
    order = np.argsort(label == labels[counts.argmax()], kind="stable")
    h, fp, n, sk, label, known = h[order], fp[order], n[order], sk[order], label[order], [known[i] for i in order.tolist()]
    out, todo, times = [], np.arange(1, len(h)), np.zeros(len(h), np.int64)
    for j in range(min(len(h) - int(counts.max()), len(h) - 1)):
        todo = todo[todo > j]
        if not len(todo):
            break
        near = todo[(np.bitwise_count(fp[todo] ^ fp[j]) <= radius) & (label[todo] != label[j])]
        near = near[may_be_similar(n[near], sk[near], n[j], sk[j], similarity)]
        done = [i for i in near.tolist() if known[i] is None or h[j] not in known[i]]
        out.extend((int(h[i]), int(h[j])) for i in done)
        if done:
            times[done] += 1
            todo = todo[times[todo] < at_once]
    return out


def proposals(hits: DataFrame, radius: int, similarity: float, rejected: DataFrame | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(a, b) distinct pairs of texts to compare next, of the buckets ``hits``: (k, h, fp, n, sk) at first, with a label later.

    Pairs whose sketches rule the similarity out are never compared. At first
    there are no labels: small buckets give all pairs, large ones are taken in
    pieces of PIECE texts, so that a task holds no more. Later only large
    buckets with several labels are left (``unsettled``), whole.
    """
    first = rejected is None
    if first:
        full = hits.select("k", "h", "fp", F.col("h").alias("label"), "n", "sk", F.lit(None).cast("array<long>").alias("known"))
    else:
        known = rejected.select(F.col("a").alias("h"), "b").union(rejected.select("b", "a")).groupBy("h").agg(F.collect_set("b").alias("known"))
        full = hits.join(known, "h", "left").select("k", "h", "fp", "label", "n", "sk", "known")

    def pairs(rows: list[np.ndarray], known: list) -> Iterator[pa.RecordBatch]:
        k, h, fp, label, n, sk = rows
        fp = fp.view(np.uint64)
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1, [len(k)]))
        sizes = np.diff(bounds)
        a, b = _small(k, h, fp, n, sk, np.repeat(sizes, sizes), radius, similarity) if first else (np.zeros(0, np.int64),) * 2
        more = []
        for i in np.flatnonzero(sizes > ALL_PAIRS).tolist():
            here = slice(int(bounds[i]), int(bounds[i + 1]))
            more += _large(h[here], fp[here], n[here], sk[here], label[here], known[here], radius, similarity, at_once)
        if more:
            a, b = (np.concatenate((c, np.array(m, np.int64))) for c, m in zip((a, b), zip(*more, strict=True), strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []  # of the last bucket seen, which the next batch may go on with
        marks: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in range(5)]
            rows.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, BINS))
            known = [None] * batch.num_rows if first else batch.column(6).to_pylist()
            known = [None if x is None else set(x) for x in known]
            ends = np.flatnonzero(np.diff(rows[0])) + 1
            if parts and parts[-1][0][-1] != rows[0][0]:
                yield from pairs([np.concatenate(c) for c in zip(*parts, strict=True)], marks)
                parts, marks = [], []
            if len(ends):  # the last bucket of the batch stays, all others are whole
                at = int(ends[-1])
                parts.append([c[:at] for c in rows])
                yield from pairs([np.concatenate(c) for c in zip(*parts, strict=True)], marks + known[:at])
                parts, marks, rows, known = [], [], [c[at:] for c in rows], known[at:]
            parts.append(rows)
            marks += known
            if first and len(marks) > PIECE:
                yield from pairs([np.concatenate(c) for c in zip(*parts, strict=True)], marks)
                parts, marks = [], []
        if parts:
            yield from pairs([np.concatenate(c) for c in zip(*parts, strict=True)], marks)

    found = full.repartition("k").sortWithinPartitions("k", "h").mapInArrow(run, "a long, b long").distinct()
    return found


def unsettled(hits: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, h, fp, n, sk, label): the large buckets whose texts are in several groups; small ones have been compared in full."""
    large = hits.groupBy("k").count().where(F.col("count") > ALL_PAIRS).select("k")
    marked = hits.join(large, "k", "left_semi").join(roots.select(F.col("node").alias("h"), "root"), "h", "left").select("k", "h", "fp", "n", "sk", F.coalesce("root", "h").alias("label"))
    marked = written(marked, "near-large")
    several = marked.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("k")
    return marked.join(several, "k", "left_semi")


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, same): whether the shingle sets of each pair are as similar as that."""
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in (2, 3))
            same = [jaccard(a.values.to_numpy(), b.values.to_numpy()) >= similarity for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["a", "b", "same"])

    return both.mapInArrow(run, "a long, b long, same boolean")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR, shingle: int = SHINGLE, radius: int = CANDIDATE_RADIUS) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): (id, h) of each row, h a hash of its text, and (node, root) for each text with a near copy.

    Candidates are texts whose word-pair fingerprints collide under a covering mask
    and differ in at most ``radius`` bits; those with that similarity of their
    distinct shingles are linked. Sketches of 64 bytes rule out most pairs that
    are not similar and none that is. In a bucket of many texts each is compared
    with a few others at a time, in rounds, until no two texts of a bucket are
    left that are within the radius, in different groups, perhaps similar by
    their sketches and not compared yet: tight groups need few comparisons per
    text, and no link is lost. Buckets whose texts are all in one group leave
    the rounds.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pairs_fingerprint(t) for t in as_bytes(batch.column(2))], pa.int64())], names=["id", "h", "fp"])

    rows = written(picked.mapInArrow(mark, "id long, h long, fp long"), "near-rows")
    shared = written(buckets(rows.select("h", "fp").distinct(), radius), "near-buckets")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, shingle) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64())), pa.array(map(len, made), pa.int64()), pa.array(map(sketch, made), pa.binary())], names=["h", "s", "n", "sk"])

    texts = picked.join(shared.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(cut, "h long, s array<long>, n long, sk binary"), "near-sets")
    hits = written(shared.join(sets.select("h", "n", "sk"), "h"), "near-sketched")
    removed(shared)
    links, rejected, roots, at_once = None, None, None, AT_ONCE
    while True:
        pairs = written(proposals(hits if roots is None else unsettled(hits, roots), radius, similarity, rejected, at_once), "near-pairs")
        if not pairs.limit(1).count():
            break
        done = written(compared(pairs, sets, similarity), "near-compared")
        good, bad = done.where("same").select("a", "b"), done.where("not same").select("a", "b")
        links, rejected = (good, bad) if links is None else (links.union(good), rejected.union(bad))
        if roots is None or good.limit(1).count():
            roots = connected_components(links, "near-links")
        at_once *= 4
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    return rows.select("id", "h"), roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near copies (``similar_texts``), with all columns of ``docs``.

    Of a group stays the row with the smallest id; of rows with that id, the
    one with the smallest hash of its text; of equal ones, any. Rows that share
    an id but not the text are judged apart: unlike ones all stay. Null, empty
    and blank texts are near copies of each other. A row without an id can't
    stand for a group and is left alone.
    """
    rows, roots = similar_texts(docs, id_col, text_col, **options)
    known = rows.where("id is not null").groupBy("id", "h").agg(F.count("*").alias("n"))
    grouped = known.join(roots.withColumnRenamed("node", "h"), "h", "left").select("id", "h", "n", F.coalesce("root", "h").alias("root"))
    grouped = written(grouped, "near-groups")
    best = grouped.groupBy("root").agg(F.min(F.struct("id", "h")).alias("best"))
    judged = grouped.join(best, "root").select("id", "h", "n", ((F.col("best.id") == F.col("id")) & (F.col("best.h") == F.col("h"))).alias("stays"))
    judged = written(judged, "near-judged")
    names = {"id": "__sf_near_id", "h": "__sf_near_h"}
    marked = docs.withColumns({"__sf_near_id": F.col(id_col).cast("long"), "__sf_near_h": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    kept = marked.join(judged.where("not stays").select("id", "h").withColumnsRenamed(names), list(names.values()), "left_anti")
    twice = judged.where("stays and n > 1").select("id", "h").withColumnsRenamed(names)
    if twice.limit(1).count():  # rows that are equal in id and text
        kept = kept.join(twice, list(names.values()), "left_anti").unionByName(kept.join(twice, list(names.values()), "left_semi").dropDuplicates(list(names.values())))
    return kept.select(*docs.columns)
