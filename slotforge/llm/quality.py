"""Quality rules: gradient-boosted trees over document statistics, scored from numpy node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, concatenated, hashed_sample, slices, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistic: sign of its constraint (-1: a larger value never raises the quality score; +1: never lowers it; 0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "digits": 0,
    "bars_per_word": -1, "shouts_per_word": -1, "stops_per_word": 0, "distinct_words": 0, "line_words": 0, "short_lines": 0, "non_ascii": 0,
}


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _SYMBOL, _UPPER, _DIGIT, _STOP = map(_lut, (SPACE, b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:"))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by a window of ``width`` words that the list holds twice or more, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    mixed = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[j : j + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows always have equal hashes
    key = codes[:n]
    for j in range(1, width):  # exact: a number for each distinct window, one word wider at a time
        _, key = np.unique(key * len(ids) + codes[j : j + n], return_inverse=True)
    again = np.bincount(key)[key] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The five counts (n x 5, int64) and the features (n x len(FEATURES)) of some texts."""
    flat, ends = concatenated(texts)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[ends[1:]] - sums[ends[:-1]]

    space = _SPACE[flat] if len(flat) else np.zeros(0, bool)
    start = (flat & 0xC0) != 0x80
    first = ~space
    first[1:] &= space[:-1]
    inner = ends[:-1][ends[:-1] < len(flat)]
    first[inner] = ~space[inner]
    n_words, word_chars, symbols = per_text(first), per_text(start & ~space), per_text(_SYMBOL[flat])
    upper, digit, bars, shout = per_text(_UPPER[flat]), per_text(_DIGIT[flat]), per_text(flat == 124), per_text(flat == 33)
    stop, other = per_text(_STOP[flat]), per_text(start & (flat > 127))
    exact = np.zeros((len(texts), 4), np.int64)  # duplicate lines, repeated words, distinct words, lines with a word
    short = np.zeros(len(texts))
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        lines = repeats = few = 0
        for line in text.split(b"\n"):
            if line and not line.isspace():
                lines += 1
                few += len(line) < 30
                if line in seen:
                    repeats += 1
                else:
                    seen.add(line)
        words = text.split()
        exact[i] = repeats, repeated_words(words), len(set(words)), lines
        short[i] = few
    counts = np.column_stack([n_words, word_chars, symbols, exact[:, 0], exact[:, 1]])
    w, c, l = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(exact[:, 3], 1)  # noqa: E741
    features = np.column_stack([
        np.log1p(n_words), word_chars / w, symbols / w, exact[:, 0] / l, exact[:, 1] / w, upper / c, digit / c, bars / w,
        shout / w, stop / w, exact[:, 2] / w, n_words / l, short / l, other / c,
    ])
    return counts, features


@dataclass
class Trees:
    """Boosted regression trees as node arrays, one row per tree: a leaf points to itself."""

    feature: np.ndarray  # trees x nodes, int32
    cut: np.ndarray  # float64: to the left if value <= cut
    left: np.ndarray  # int32
    right: np.ndarray  # int32
    value: np.ndarray  # float64, at leaves
    depth: int
    base: float
    signs: tuple[int, ...] = field(default=())

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[t][at]] <= self.cut[t][at], self.left[t][at], self.right[t][at])
            out += self.value[t][at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic gradient boosting on binned columns.

    Constrained columns only split where the side that must not be lower has
    the higher value, and children inherit the midpoint as a bound, so the
    whole tree (and so the sum of trees) is monotone in them.
    """
    columns = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(columns)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(columns)]) if len(x) else np.zeros((0, columns), int)
    rise = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rise / (1 - rise)))
    margin, nodes = np.full(len(x), base), (1 << depth + 1) - 1
    made = {k: np.zeros((rounds, nodes), t) for k, t in (("feature", np.int32), ("cut", float), ("left", np.int32), ("right", np.int32), ("value", float))}
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        made["left"][t] = made["right"][t] = np.arange(nodes)
        level = [(0, np.arange(len(x)), -np.inf, np.inf)]
        used = 1
        while level:
            node, rows, low, high = level.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            made["value"][t, node] = rate * min(max(g / (h + penalty), low), high)
            if node_depth(made["left"][t], made["right"][t], node) >= depth or len(rows) < 2 * least:
                continue
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j in range(columns):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                gs, hs = (np.cumsum(np.bincount(binned[rows, j], v[rows], k))[:-1] for v in (grad, hess))
                n = np.cumsum(np.bincount(binned[rows, j], minlength=k))[:-1]
                lv, rv = np.clip(gs / (hs + penalty), low, high), np.clip((g - gs) / (h - hs + penalty), low, high)
                gain = gs * gs / (hs + penalty) + (g - gs) ** 2 / (h - hs + penalty) - g * g / (h + penalty)
                ok = (n >= least) & (len(rows) - n >= least) & ((rv - lv) * signs[j] >= 0)
                gain = np.where(ok, gain, -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], j, i, lv[i], rv[i])
            if best[1] < 0:
                continue
            _, j, i, lv, rv = best
            made["feature"][t, node], made["cut"][t, node] = j, cuts[j][i]
            made["left"][t, node], made["right"][t, node] = used, used + 1
            side, mid = binned[rows, j] <= i, (lv + rv) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[j]]
            level += [(used, rows[side], *bounds[0]), (used + 1, rows[~side], *bounds[1])]
            used += 2
        tree = Trees(*(made[k][t : t + 1] for k in ("feature", "cut", "left", "right", "value")), depth, 0.0)
        margin += tree.margin(x)
    return Trees(made["feature"], made["cut"], made["left"], made["right"], made["value"], depth, base, tuple(signs))


def node_depth(left: np.ndarray, right: np.ndarray, node: int) -> int:
    """Steps from the root to ``node`` in a small tree."""
    steps = 0
    while node:
        parents = np.flatnonzero(((left == node) | (right == node)) & (np.arange(len(left)) != node))
        node, steps = int(parents[0]), steps + 1
    return steps


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, the five counts, features array): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(as_bytes(batch.column(1))):
                counts, features = statistics(texts)
                columns = [batch.column(0).slice(at, len(texts)), *(pa.array(counts[:, j]) for j in range(len(COUNTS))), pa.array(list(features), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *COUNTS, "features"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", most_rows: int = 20_000, **options) -> Trees | None:
    """Fit on at most ``most_rows`` labelled documents, those with the smallest hash of the id.

    Documents that the base rules fail are no examples: the model never judges
    them. Of rows that share an id, the one with the smallest statistics is the example. Conflicting labels of one id count as their lowest; null labels are
    left out. None without examples of both kinds.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    examples = stats.where(~base_failed()).join(marked, "id").groupBy("id").agg(F.min(F.struct(*COUNTS, "features")).alias("own"), F.first("y").alias("y"))
    sample = hashed_sample(examples, most_rows, "id").select(F.col("own.features").alias("features"), "y").toPandas()
    y = sample["y"].to_numpy(float)
    if len(set(y > 0.5)) < 2:
        return None
    x = np.vstack(sample["features"].to_numpy())
    return fit_trees(x, (y > 0.5).astype(float), list(FEATURES.values()), **options)


def score(stats: DataFrame, trees: Trees | None) -> DataFrame:
    """``stats`` without the features, with quality (double). Without a model the quality is 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column(len(COUNTS) + 1)
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), len(FEATURES))
            quality = trees.probability(x) if trees else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(quality, pa.float64())], names=["id", *COUNTS, "quality"])

    return stats.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", quality double")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, most_rows: int = 20_000) -> DataFrame:
    """(id, the five counts, base_failed, quality, kept): one row per input row.

    A null text has no words and fails the base rules. Kept: passes the base
    rules and the model's quality is at least ``threshold``. With no labels
    (or of one kind only) the base rules alone decide. Columns other than id
    and text are not read.
    """
    stats = written(with_statistics(docs, id_col, text_col), "quality-statistics")
    trees = fit(stats, labels, id_col="doc_id", most_rows=most_rows)
    return score(stats, trees).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def labelled_documents(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_rows: int, label_col: str = "quality") -> DataFrame:
    """The documents of ``most_rows`` labels and a fifth more, those with the smallest hashes: what the base rules fail among them still leaves a sample of that size as a rule."""
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col("doc_id").cast("long").alias("__sf_id")).dropna().distinct()
    asked = hashed_sample(marked, most_rows + most_rows // 5, "__sf_id")
    return docs.select(id_col, text_col).join(asked, F.col(id_col).cast("long") == F.col("__sf_id"), "left_semi")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, most_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that ``judge`` would keep, with all their columns; each row is judged by its own text.

    The statistics of labelled documents (``labelled_documents``) are made to
    fit the trees, those of all documents once, while they are filtered.
    """
    stats = written(with_statistics(labelled_documents(docs, labels, id_col, text_col, most_rows), id_col, text_col), "quality-statistics")
    trees = fit(stats, labels, most_rows=most_rows)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(as_bytes(batch.column(at))):
                counts, x = statistics(texts)
                good = (counts[:, 0] >= 10) & (100 * counts[:, 4] <= 20 * counts[:, 0])
                if trees:
                    good &= trees.probability(x) >= threshold
                yield batch.slice(first, len(texts)).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
