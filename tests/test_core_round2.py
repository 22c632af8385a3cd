"""Encoders in use, parameter grid, skewed and odd keys, ranges, scratch folders, sweeps."""

import itertools
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotforge.functions import bucketers, hashing
from slotforge.operators import encoders, ranks
from slotforge.operators.build import build
from slotforge.operators.search import kernel, search
from slotforge.plans import sizing
from slotforge.plans.config import DENSE_ENCODERS, PLAIN_ENCODERS, MphConfig
from slotforge.sources import keys as sources
from slotforge.sources import model_io, scratch

SMALL = {"avg_partition_size": 500, "min_partition_size": 100}


@pytest.mark.parametrize("lam", [4.0, 4.5, 5.0, 5.5, 6.0])
@pytest.mark.parametrize("alpha", [1.0, 0.99, 0.98, 0.97, 0.96])
def test_grid_of_searches_through_every_encoder(lam, alpha):
    """One and two hash words, several partition sizes: every key gets a slot of its own from the decoded pilots."""
    rng = np.random.default_rng(int(lam * 100 + alpha * 1000))
    n = 1500
    for words, size, bucketer in itertools.product((1, 2), (300, 1500), bucketers.NAMES):
        first = rng.integers(0, 2**64, n, np.uint64)
        second = first if words == 1 else rng.integers(0, 2**64, n, np.uint64)
        partitions, buckets = sizing.num_partitions(n, size), sizing.num_buckets(size, lam)
        dealt = first * np.uint64(0x517CC1B727220A95) if words == 1 else first ^ second
        pid = bucketers.np_bucket("uniform", dealt, partitions).astype(np.int64)
        bucket = bucketers.np_bucket(bucketer, first, buckets).astype(np.int64)
        sizes = {p: int(k / alpha) for p, k in zip(*map(np.ndarray.tolist, np.unique(pid, return_counts=True)), strict=True)}
        found = search(pid, bucket, second, sizes, buckets)
        for p, x in found.items():
            assert x["problem"] is None
            own = pid == p
            for name in PLAIN_ENCODERS:
                data, _ = encoders.encode_values(name, x["pilots"])
                pilots = encoders.decode_values(name, data, buckets)[bucket[own]].astype(np.uint64)
                h = (second[own] ^ (pilots * np.uint64(0x517CC1B727220A95))) * np.uint64(0x517CC1B727220A95)
                slots = [int(v) * x["m"] >> 64 for v in h.tolist()]
                assert sorted(slots) == x["taken"].tolist() and len(set(slots)) == own.sum()


@pytest.mark.parametrize("mode,names", [("partitioned", PLAIN_ENCODERS), ("dense", DENSE_ENCODERS)])
def test_lookup_save_and_load_through_encoders(spark, tmp_path, mode, names):
    keys = sources.random_longs(spark, 6000, seed=9)
    model = build(keys, "key", MphConfig(mode=mode, seed=2, **SMALL))
    want = {r["key"]: r["pos"] for r in model.lookup(keys).collect()}
    for name in names[:: 2 if mode == "dense" else 3]:
        one = build(keys, "key", MphConfig(mode=mode, seed=2, encoder=name, **SMALL))
        model_io.save(one, f"{tmp_path}/{name}")
        back = model_io.load(spark, f"{tmp_path}/{name}")
        assert {r["encoder"] for r in back.encoded.select("encoder").distinct().collect()} == {name}
        assert {r["key"]: r["pos"] for r in back.lookup(keys).collect()} == want
        assert {r["key"]: r["pos"] for r in encoders.with_encoder(model, name).lookup(keys).collect()} == want


def test_many_ranges_of_one_partition(spark, monkeypatch):
    monkeypatch.setattr(encoders, "RANGE", 64)
    keys = sources.random_strings(spark, 3000, seed=3)
    model = build(keys, "key", MphConfig(seed=2, bucketer="opt"))
    assert model.num_buckets > 5 * 64 and model.check(keys).first()["ok"]
    assert model.table.count() == -(-model.num_buckets // 64)


def test_lookup_deals_out_keys_that_need_no_row(spark):
    """Null keys, and keys already in place, do not meet in one partition when nothing is broadcast."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    keys = sources.random_longs(spark, 20_000, seed=4)
    model = build(keys, "key", MphConfig(mode="dense", seed=1))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        rows = keys.union(spark.range(20_000).select(F.lit(None).cast("long").alias("key"))).repartition(16)
        sizes = [r["count"] for r in model.lookup(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 40_000 and max(sizes) < 12_000


def test_builds_use_all_cores(spark):
    keys = sources.random_longs(spark, 40_000, seed=4)
    parts = build(keys, "key", MphConfig(mode="dense", seed=1)).num_partitions
    together = max(1, max(1 << 12, 40_000 // (2 * spark.sparkContext.defaultParallelism)) * parts // 40_000)
    assert -(-parts // together) >= spark.sparkContext.defaultParallelism


def test_null_keys_get_null_whatever_the_hash(spark):
    for family, kind in itertools.product(hashing.FAMILIES, ("long", "string", "binary")):
        keys = spark.range(50).select(F.col("id").cast("string").cast(kind).alias("key"))
        model = build(keys, "key", MphConfig(seed=1, hash_family=family))
        asked = keys.union(spark.range(3).select(F.lit(None).cast(kind).alias("key")))
        found = [r["pos"] for r in model.lookup(asked).collect()]
        assert found.count(None) == 3 and sorted(x for x in found if x is not None) == list(range(50)), (family, kind)


def test_composite_keys_with_separators(spark):
    keys = spark.createDataFrame([("a\x1f", "b"), ("a", "\x1fb"), ("a", "b"), ("1:a", "b"), ("", "ab"), ("ab", "")], "x string, y string")
    assert build(keys, ["x", "y"], MphConfig(seed=1, hash_family="md5")).check(keys).first()["ok"]


def test_uniform_over_all_ranges(spark):
    words = [0, 1, -1, 2**62, -(2**63), 0x123456789ABCDEF]
    df = spark.createDataFrame([(w,) for w in words], "h long")
    for buckets in (1, 3, (1 << 31) + 7, (1 << 32) - 1, 1 << 32):
        got = [r[0] for r in df.select(bucketers.uniform(F.col("h"), buckets)).collect()]
        assert got == [((w & (2**64 - 1)) >> 32) * buckets >> 32 for w in words]


def test_ranks_over_one_large_class(spark):
    """Most values occur once: no range is much larger than asked."""
    values = spark.range(39_000).select(F.when(F.col("id") < 1000, F.col("id") % 10).otherwise(F.col("id")).alias("v"))
    codes = encoders.dictionary_codes(values, "v")
    rows = sorted((r["code"], r["value"], r["n"]) for r in codes.collect())
    assert [c for c, _, _ in rows] == list(range(38_010))
    assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    counts = values.groupBy("v").count()
    dealt = ranks.ranked_in_ranges(counts, ["count", "v"], rows=2000)
    assert sorted(r["rank"] for r in dealt.collect()) == list(range(38_010))
    sizes = [r["count"] for r in counts.repartitionByRange(20, "count", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 6000


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(fake)


def test_written_files_go(spark):
    from pathlib import Path

    df = scratch.written(spark.range(10).toDF("x"), "some")
    folder = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists() and df.count() == 10
    scratch.removed(df)
    assert not folder.exists()


def test_first_lines(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("\n".join(f"k{i}" for i in range(100)))
    assert sources.read_lines(spark, str(tmp_path / "keys.txt"), most=7).count() == 7


def test_search_metrics_and_empty_partitions(spark):
    """Columns of a build against counts of its keys; partitions without keys still have slots and offsets."""
    keys = spark.range(5).select(F.col("id").alias("key"))
    model = build(keys, "key", MphConfig(mode="partitioned", seed=3, min_partition_size=1, avg_partition_size=1))
    rows = model.partitions.orderBy("pid").collect()
    assert len(rows) == 5 and any(r["n"] == 0 for r in rows)
    assert [r["n_offset"] for r in rows] == [sum(x["n"] for x in rows[:i]) for i in range(5)]
    assert all(r["largest_bucket"] <= r["n"] for r in rows) and model.check(keys).first()["ok"]
    import pyarrow as pa

    group = pa.table({"pid": [7] * 6, "bucket": [0, 0, 0, 2, 2, 4], "payload": list(range(6))})
    row = kernel(None, 1.0, 6, 1 << 20, 6)(group).to_pylist()[0]
    assert (row["pid"], row["n"], row["largest_bucket"], row["empty_buckets"], row["max_pilot"]) == (7, 6, 3, 3, max(row["pilots"]))
