import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slotforge.llm import simhash
from slotforge.llm.common import connected_components
from slotforge.llm.queries import op8_simhash_near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, sf):
    rows = {r["doc_id"]: r for r in op8_simhash_near_dedup(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == brute_components(fps)


@pytest.mark.parametrize("radius", [2, 4, 6])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 30  # no mask makes large buckets of unlike values
    rng = random.Random(1)
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not apart & m for m in masks)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(30):  # clouds of close values, chains and loners
        base = rng.getrandbits(64)
        for _ in range(12):
            values.add(base)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                base ^= 1 << b
    values |= {0, 2**63, 2**64 - 1}
    want = brute_components(dict(zip(sorted(values), sorted(values))))
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in connected_components(simhash.links(df)).collect()}
    groups = {}
    for v in values:
        groups.setdefault(roots.get(v, v), set()).add(v)
    expected = {}
    for v, r in want.items():
        expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_odd_rows(make_docs, spark):
    long = "w " * 200_000
    docs = make_docs([(5, None), (3, ""), (9, " \t\n"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (8, "A B c d"), (1, long), (2, long + "x")])
    rows = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(5, 3), (3, 3), (9, 3), (None, 7), (7, 7), (7, 7), (8, 7), (1, 1), (2, 1)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "7", "None"]  # 1 and 2: one of two distinct shingles
    assert len(kept.columns) > 6  # columns of clashing names stay
    empty = make_docs([])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}


def test_no_collected_groups(spark, sf):
    plan = simhash.links(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("fp")))._jdf.queryExecution().toString()
    assert "collect_" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def noisy(rng, words, share):
    return " ".join(rng.choice(["changed", "other", "made", "up"]) + str(rng.random()) if rng.random() < share else w for w in words)


def brute_groups(texts, radius=64):
    fps = [simhash.pairs_fingerprint((t or "").encode()) & (2**64 - 1) for t in texts]
    sets = [simhash.shingle_set((t or "").encode()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for a in range(len(texts)):
        for b in range(a):
            s, t = set(sets[a].tolist()), set(sets[b].tolist())
            if len(s & t) >= 0.8 * len(s | t) and (fps[a] ^ fps[b]).bit_count() <= radius:
                pairs += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(texts))], pairs


def test_near_copies_equal_brute_force(spark, make_docs, monkeypatch):
    """Groups of texts that differ in one word of fifty and more, chains of them, and unlike texts of the same words."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 20)):
            texts.append(noisy(rng, base, 0.008))
        shuffled = base[:]
        rng.shuffle(shuffled)
        texts.append(" ".join(shuffled))  # the same words, no shingle in common
    texts += ["", " \t", "one two three"]
    want, _ = brute_groups(texts, simhash.CANDIDATE_RADIUS)
    for at_once in (8, 2):
        monkeypatch.setattr(simhash, "ALL_PAIRS", at_once)
        kept = {r["doc_id"] for r in simhash.keep_one(make_docs(list(enumerate(texts)))).collect()}
        assert kept == set(want)


def test_rows_that_share_an_id(make_docs):
    a, b, c = ("alpha beta gamma delta epsilon zeta " + x for x in ("one", "two three four five six", "seven nine"))
    docs = make_docs([(1, a), (7, b), (7, c), (7, b), (3, b), (8, c), (None, c), (None, c), (9, None), (10, ""), (11, "")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (3, b), (7, c), (None, c), (None, c), (9, None)], key=str)


def test_near_copies_of_the_corpus(spark):
    """On the corpus' distinct texts: what is within the radius and similar ends in one group, nothing else does. What the radius misses is in the README."""
    texts = sorted({r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_groups(texts, simhash.CANDIDATE_RADIUS)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(want)


def test_sketches_rule_out_no_similar_pair():
    """Sets of any size, with counters that are full too: pairs of the similarity or more always may be similar; unlike ones are ruled out."""
    rng = np.random.default_rng(3)
    ruled_out = 0
    for size in (0, 1, 4, 50, 146, 3000, 60_000):
        for changed in (0.0, 0.05, 0.111, 0.2, 0.6):
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
            b = a.copy()
            at = rng.random(len(a)) < changed
            b[at] = rng.integers(-(2**63), 2**63 - 1, int(at.sum()))
            b = np.unique(b)
            x, y = (np.frombuffer(simhash.sketch(s), np.uint8)[None] for s in (a, b))
            may = simhash.may_be_similar(np.array([len(a)]), x, len(b), y, 0.8)[0]
            assert may or simhash.jaccard(a, b) < 0.8
            ruled_out += not may
    assert ruled_out >= 6
