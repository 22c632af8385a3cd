import math
import zlib
from collections import Counter

import numpy as np
import pytest

from slotforge.llm import ctw
from slotforge.llm.queries import op1_ctw_scores


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute(rows, depth):
    """Context-tree weighting by its recursion, node by node, with big dictionaries and math.lgamma."""
    counts, vocabulary = {}, Counter()

    def streams(text):
        words = (text or "").encode().lower().split()
        return words, ctw.stream(words)

    def path(context, byte):
        node = 1
        for j in range(7, -1, -1):
            bit = byte >> j & 1
            yield node, bit
            node = node * 2 + bit

    def visits(coded):
        padded = ctw.END * depth + coded
        for i in range(len(coded)):
            context = padded[i : i + depth]
            for node, bit in path(context, coded[i]):
                yield context, node, bit

    for i, text in rows:
        if not held(i):
            words, coded = streams(text)
            vocabulary.update(words)
            vocabulary[ctw.END] += 1
            for context, node, bit in visits(coded):
                for d in range(depth + 1):
                    counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))

    def own(key):
        z, o = counts.get(key, (0, 0))
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    memo = {}

    def mixed(key):
        if key not in memo:
            if len(key[0]) == depth:
                memo[key] = own(key)
            else:
                memo[key] = math.log(0.5) + np.logaddexp(own(key), sum(mixed(c) for c in children.get(key, ())))
        return memo[key]

    def one(context, node):
        z, o = counts.get((context, node), (0, 0))
        p = (o + 0.5) / (z + o + 1)
        for d in range(depth - 1, -1, -1):
            key = (context[depth - d :], node)
            z, o = counts.get(key, (0, 0))
            w = 0.5 * math.exp(own(key) - mixed(key))
            p = w * (o + 0.5) / (z + o + 1) + (1 - w) * p
        return p

    total, distinct = sum(vocabulary.values()), len(vocabulary)
    out = []
    for i, text in rows:
        words, coded = streams(text)
        score = sum(math.log10(p if bit else 1 - p) for p, bit in ((one(c, n), b) for c, n, b in visits(coded)))
        found = [vocabulary[w] for w in [*words, ctw.END]]
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) for c in found)
        out.append((i, held(i), len(found), sum(c > 0 for c in found), total, base, score))
    return out


ROWS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog sat", None, "", "  \t\n", "été à la mer the cat", "the the the the", "a\x0bb\x0cc", "zzz qqq", "The cat sat on the mat", "MAT the cat"])] + [(None, "the cat"), (3, "the dog"), (3, "the dog")]


@pytest.mark.parametrize("depth", [2, 4])
def test_equals_brute_force(make_docs, depth, monkeypatch):
    monkeypatch.setattr(ctw, "BUCKET_BYTES", 60)
    monkeypatch.setattr(ctw, "GROUP_GRAMS", 30)
    got = sorted((tuple(r)[:7] for r in ctw.score(make_docs(ROWS), depth=depth).collect()), key=str)
    want = sorted(brute(ROWS, depth), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_probabilities_of_all_bytes_sum_to_one(spark):
    text = b"abracadabra"
    keys = ctw.grams(text, 3)
    every = np.unique(np.concatenate([(keys[:, None] >> 8 << 8 | np.arange(256)).ravel()]))
    counts = dict(zip(*np.unique(keys, return_counts=True)))
    df = spark.createDataFrame([(int(k), int(counts.get(k, 0))) for k in every], "gram long, n long")
    rows = ctw.code_lengths(df, 3).toPandas()
    assert np.allclose((10 ** rows["lp"]).groupby(rows["gram"] // 256).sum(), 1)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 8, 123.5, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_better_than_words_alone_on_held_out_texts(spark):
    """With 8,000 texts to learn from; with 800 (sf0.01) the words' own counts are still ahead, as the README says."""
    rows = op1_ctw_scores(spark, "/root/testdata/sf0.1").select("doc_id", "held_out", "score", "base_score").collect()
    assert len(rows) == 10_000
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_long_text_and_no_rows(make_docs):
    rows = ctw.score(make_docs([(1, "word " * 500_000)])).collect()
    assert rows[0]["n_tokens"] == 500_001 and rows[0]["score"] < 0
    assert ctw.score(make_docs([])).count() == 0


def test_five_bytes_of_context_as_one_row_a_part(spark):
    """The default model sees five bytes back, and grams travel packed: rows do not grow with the number of grams."""
    assert ctw.DEPTH >= 5
    docs = spark.createDataFrame([(i, f"{'x' if i % 2 else 'y'}abcd{'p' if i % 2 else 'q'}") for i in range(2, 400)], "doc_id long, text string")
    rows, n = ctw.bucketed(docs, "doc_id", "text")
    made = ctw.parts(rows, ctw.DEPTH, 8).where("token is null").collect()
    assert n == 1 and len(made) <= 8 and len({k for r in made for k in ctw._unpack(r["grams"], r["size"])[0].tolist()}) == sum(r["size"] for r in made)
    deep, flat = (ctw.score(docs, depth=d).selectExpr("sum(score)").first()[0] for d in (ctw.DEPTH, 4))
    assert deep > flat + 50
