import random

import pytest

from slotforge.llm import packing
from slotforge.llm.queries import op6_best_fit_packing

SIZES = [8, 16, 32]


def verify(rows, totals, sizes):
    """Every token once, in bins of permitted sizes, none overlapping, none larger than needed."""
    spans, bins = {}, {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        bins.setdefault(r["bin_id"], []).append(r)
    assert set(spans) == set(totals)
    for i, found in spans.items():
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == totals[i]
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert {r["bin_used"] for r in own} == {at} and {r["bin_size"] for r in own} == {min(s for s in sizes if s >= at)}


def brute(lengths, sizes, overhead):
    """The same rule over a plain list of open bins."""
    rooms, size, out = [], [], []
    for i, n in enumerate(lengths):
        fits = [b for b, r in enumerate(rooms) if r >= n]
        if fits:
            room = min(rooms[b] for b in fits)
            b = max((b for b in fits if rooms[b] == room), key=lambda b: order.index(b))
        else:
            costs = [((c + overhead) / (n + min(c - n, sum(x for x in lengths[i + 1 :] if x <= c - n))), c) for c in sizes if c >= n]
            c = min(costs)[1]
            rooms.append(c)
            size.append(c)
            b = len(rooms) - 1
        rooms[b] -= n
        out.append(b)
        order = ([] if i == 0 else [x for x in order if x != b]) + [b]
    return out


def test_equals_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted((rng.randint(1, 32) for _ in range(rng.randint(1, 60))), reverse=True)
        assert packing.best_fit(lengths, SIZES, 3)[0] == brute(lengths, SIZES, 3)


def test_query(spark, sf):
    rows = op6_best_fit_packing(spark, sf).collect()
    totals = {r["doc_id"]: len((r["text"] or "").encode().split()) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    verify(rows, totals, packing.CAPACITIES)
    size = {r["bin_id"]: r["bin_size"] for r in rows}
    assert sum(totals.values()) >= 0.98 * sum(size.values())


def test_shards_and_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, "a " * 31), (4, "a " * 500), (5, "b"), (6, "\t \n"), *((10 + i, "c " * (i % 40)) for i in range(200))]
    got = packing.pack(make_docs(rows), capacities=(32, 8, 16), shard_pieces=40).withColumnRenamed("id", "doc_id").collect()
    verify(got, {i: len((t or "").split()) + 1 for i, t in rows}, SIZES)
    twice = packing.pack(make_docs([(1, "a b"), (1, "a b"), (None, "x")]), capacities=(8,)).collect()
    assert len(twice) == 3
    assert packing.pack(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(make_docs([]), capacities=())


def test_least_cost_bins():
    assert packing.best_fit([5], SIZES, 4)[2] == [8]  # nothing else to fill a larger one
    assert packing.best_fit([16, 16], SIZES, 4)[2] == [32]  # one sequence costs less than two
    assert packing.best_fit([17, 3], [20, 40], 0)[2:] == ([20], [20])
