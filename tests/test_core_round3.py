"""Keys worked out once, pilots cut and turned in blocks, losses and distinct positions counted without shuffling values."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotforge.operators import encoders
from slotforge.operators.build import build
from slotforge.plans import bench
from slotforge.plans.config import DENSE_ENCODERS, PLAIN_ENCODERS, MphConfig
from slotforge.sources import keys as sources

SMALL = {"avg_partition_size": 500, "min_partition_size": 100}


def test_sweep_works_out_its_keys_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    keys = sources.random_longs(spark, 6000, seed=5).mapInArrow(count, "key long")
    records = bench.sweep(keys, ["key"], lambdas=(4.0,), alphas=(0.97,), bucketers=("skew",), runs=1, lookups=1)
    assert len(records) == len(PLAIN_ENCODERS) + len(DENSE_ENCODERS) and made.value == 6000
    assert not keys.is_cached


@pytest.mark.parametrize("layout", ["C", "C-int"])
def test_runs_are_cut_into_chunks_and_lose_nothing(layout):
    partitions, buckets = 701, 300
    values = np.arange(partitions * buckets)
    got = {}
    for first in range(0, len(values), 1000):
        for seq, chunk, at, part in encoders._pieces(first, values[first : first + 1000], layout, partitions):
            assert at + len(part) <= encoders.CHUNK
            for k, v in enumerate(part.tolist()):
                got[seq, chunk * encoders.CHUNK + at + k] = v
    if layout == "C":
        assert got == {(0, i): i for i in range(len(values))}
    else:
        assert got == {(b, p): b * partitions + p for b in range(buckets) for p in range(partitions)}


@pytest.mark.parametrize("own", ["C", "D-int"])
def test_sequences_of_dense_functions_of_many_blocks(spark, own):
    """More partitions than stand in one block: each pilot comes back at its bucket and partition."""
    keys = sources.random_longs(spark, 560_000, seed=7)
    model = build(keys, "key", MphConfig(mode="dense", seed=3, encoder=own))
    n = model.num_partitions
    assert n > encoders.SIDE
    pilots = model.pilots
    assert pilots.count() == n * model.num_buckets and model.check(keys).first()["ok"]
    for name, seq, i in (("R", F.lit(0), F.col("bucket") * n + F.col("pid")), ("R-int", F.col("bucket"), F.col("pid"))):
        want = pilots.select(seq.cast("long").alias("seq"), i.alias("i"), F.col("pilot").alias("value"))
        for got in (encoders.sequences(model, name), encoders.decode(encoders.encode(model, name))):
            assert want.exceptAll(got).count() == 0 and got.count() == n * model.num_buckets


@pytest.mark.parametrize("mode,names", [("partitioned", PLAIN_ENCODERS), ("dense", DENSE_ENCODERS)])
def test_lost_counts_what_changes_or_is_missing(spark, mode, names):
    model = build(sources.random_longs(spark, 9000, seed=6), "key", MphConfig(mode=mode, seed=3, **SMALL))
    assert encoders.lost(model, names).first()["lost"] == 0
    one = F.when((F.col("seq") == 0) & (F.col("chunk") == 0), F.transform("values", lambda x, i: F.when(i == 5, x + 1).otherwise(x))).otherwise(F.col("values"))
    changed = replace(model, _made={"C": encoders.chunks(model, "C").withColumn("values", one)})
    assert encoders.lost(changed, ["C"]).first()["lost"] == 2  # one value gone, another one there
    missing = replace(model, encoded=model.encoded.where("seq > 0"), _made={"C": encoders.chunks(model, "C")})
    assert encoders.lost(missing, ["C"]).first()["lost"] == model.num_buckets * (model.num_partitions if mode == "dense" else 1)


def test_check_counts_positions_in_bitmaps(spark):
    keys = sources.random_longs(spark, 70_000, seed=2)
    model = build(keys, "key", MphConfig(mode="partitioned", seed=3, **SMALL))
    row = model.check(keys.union(keys.limit(10)).union(spark.createDataFrame([(None,)], "key long"))).first()
    assert (row["n"], row["n_distinct"], row["lowest"], row["highest"], row["ok"]) == (70_010, 70_000, 0, 69_999, False)
    assert model.check(keys).first()["total"] == 70_000 * 69_999 // 2
    empty = model.check(keys.limit(0)).first()
    assert (empty["n"], empty["n_distinct"], empty["lowest"], empty["ok"]) == (0, 0, None, False)
    assert "bitmap" in model.check(keys)._jdf.queryExecution().optimizedPlan().toString()  # positions are not shuffled
