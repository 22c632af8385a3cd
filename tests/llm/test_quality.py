import re

import numpy as np
import pytest

from slotforge.llm import quality
from slotforge.llm.queries import op5_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    spots = {}
    for i in range(len(words) - 4):
        spots.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in spots.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


TEXTS = [None, "", " ", "a", "a b c d e a b c d e", "x x x x x x", "é ü ö #*$%&|<>\nline\nline\n \n \n", "a b c d e f " * 300, "one two three\r\none two three\r\n" * 4, "A b\x85c\x1cd", "w " * 100_000]


def test_statistics_equal_brute_force():
    counts, features = quality.statistics([(t or "").encode() for t in TEXTS])
    assert counts.tolist() == [brute(t) for t in TEXTS]
    assert features.shape == (len(TEXTS), len(quality.FEATURES)) and np.isfinite(features).all()


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in op5_quality_rules(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r, want = rows[d["doc_id"]], brute(d["text"])
        assert [r[c] for c in quality.COUNTS] == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judge(docs, labels.where("doc_id % 2 = 0")).withColumnRenamed("id", "doc_id")
    rows = judged.where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] is not None and r["kept"] is not None and r[-2] == 1], [r["kept"] for r in rows if r[-2] == 0]
    assert np.mean(good) >= 0.98, np.mean(good)
    assert not bad or np.mean(bad) <= 0.2, np.mean(bad)


def test_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(quality.FEATURES)))
    y = (x[:, 2] + 0.5 * np.sin(9 * x[:, 2]) + 0.3 * rng.random(800) < 0.7).astype(float)
    signs = list(quality.FEATURES.values())
    trees = quality.fit_trees(x, y, signs, rounds=30)
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.8
    for j, sign in enumerate(signs):
        if sign:
            grid = np.repeat(x[:20], 50, axis=0)
            grid[:, j] = np.tile(np.linspace(0, 1, 50), 20)
            steps = np.diff(trees.margin(grid).reshape(20, 50), axis=1)
            assert (sign * steps >= -1e-9).all()


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x, y = rng.random((300, 4)), rng.random(300) > 0.5
    t = quality.fit_trees(x, y.astype(float), [0, 1, -1, 0], rounds=5, depth=3)

    def walk(row):
        total = t.base
        for k in range(len(t.feature)):
            node = 0
            while t.left[k][node] != node:
                node = t.left[k][node] if row[t.feature[k][node]] <= t.cut[k][node] else t.right[k][node]
            total += t.value[k][node]
        return total

    assert np.allclose(t.margin(x), [walk(r) for r in x])


def test_odd_rows(make_docs, spark):
    docs = make_docs([*((i, t) for i, t in enumerate(TEXTS)), (None, "a b c d e f g h i j k"), (4, "ties and repeated rows of one id make no trouble at all")])
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs, no_labels)
    assert judged.count() == docs.count()
    assert all(r["kept"] == (not r["base_failed"]) for r in judged.collect())
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 0), (7, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert quality.keep_good(make_docs([]), labels).count() == 0 and quality.judge(make_docs([]), labels).count() == 0


@pytest.mark.parametrize("words", [[], [b"a"] * 4, [b"a"] * 5, [b"a"] * 6])
def test_repeated_words_of_short_lists(words):
    assert quality.repeated_words(words) == brute(" ".join(w.decode() for w in words))[4]
