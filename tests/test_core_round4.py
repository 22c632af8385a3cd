"""Lookups through all encodings of a function at once: keys are read, hashed and shuffled once, and meet pilots and targets in one join."""

import pytest
from pyspark.sql import functions as F

from slotforge.operators import build as building
from slotforge.operators import encoders
from slotforge.operators.build import build
from slotforge.plans import queries
from slotforge.plans.config import DENSE_ENCODERS, PLAIN_ENCODERS, MphConfig
from slotforge.sources import keys as sources

SMALL = {"avg_partition_size": 500, "min_partition_size": 100}


def _counting(spark, df):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), made


def test_encoded_lookup_reads_its_keys_once_for_all_encoders(spark, monkeypatch):
    customers, made = _counting(spark, spark.range(1, 2001).withColumnRenamed("id", "c_custkey"))
    lines = spark.range(5000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    monkeypatch.setattr(queries, "_table", lambda spark, sf, name: {"customer": customers, "lineitem": lines}[name])
    rows = queries.encoded_lookup(spark, "").collect()
    want = {("partitioned", x): 2000 for x in PLAIN_ENCODERS} | {("dense", x): 5000 for x in DENSE_ENCODERS}
    assert {(r["mode"], r["encoder"]): r["n"] for r in rows} == want and len(rows) == 15
    assert all(r["n_distinct"] == r["n"] == r["highest"] + 1 and r["lowest"] == 0 and r["ok"] for r in rows)
    assert made.value == 3 * 2000  # counted, built on, looked up (not once for each encoder)


@pytest.mark.parametrize("mode,names", [("partitioned", PLAIN_ENCODERS), ("dense", DENSE_ENCODERS)])
@pytest.mark.parametrize("beside", [True, False])
def test_one_pass_is_the_lookups_of_each_encoder(spark, monkeypatch, mode, names, beside):
    if not beside:
        monkeypatch.setattr(building, "BESIDE", -1)
    keys = sources.random_longs(spark, 9000, seed=6)
    model = build(keys, "key", MphConfig(mode=mode, seed=3, **SMALL))
    assert model.beside == beside
    asked = keys.limit(500).union(spark.range(300).toDF("key")).union(spark.createDataFrame([(None,)], "key long"))
    got = model.lookup_each(asked, list(names))
    assert got.columns == ["key", "encoder", "pos"]
    want = {tuple(r) for r in model.lookup(asked).collect()}
    rows = got.collect()
    assert len(rows) == len(names) * 801
    for name in names:
        assert {(r["key"], r["pos"]) for r in rows if r["encoder"] == name} == want
    assert (None, None) in want and all(0 <= pos < 9000 for key, pos in want if key is not None)
    alone = model.check(keys).first()
    for row in model.check_each(keys, names).drop("encoder").collect():
        assert row == alone and row["ok"]


def test_an_encoding_that_changes_pilots_fails_alone(spark, monkeypatch):
    keys = sources.random_longs(spark, 9000, seed=6)
    model = build(keys, "key", MphConfig(mode="dense", seed=3))
    right = encoders.encode_each

    def wrong(model, names):
        rows = right(model, names)
        zeros, bits = encoders.encode_values("D", [0] * (model.num_partitions * model.num_buckets))
        return rows.withColumn("data", F.when(F.col("encoder") == "D", F.lit(bytearray(zeros))).otherwise(F.col("data")))

    monkeypatch.setattr(encoders, "encode_each", wrong)
    rows = {r["encoder"]: r for r in model.check_each(keys, ["C", "D", "R-int"]).collect()}
    assert rows["C"]["ok"] and rows["R-int"]["ok"] and not rows["D"]["ok"]
    assert rows["D"]["n"] == 9000 and rows["D"]["n_distinct"] < 9000


def test_bitmaps_passed_on_early_count_the_same(spark, monkeypatch):
    keys = sources.random_longs(spark, 70_000, seed=2)
    model = build(keys, "key", MphConfig(mode="partitioned", seed=3, **SMALL))
    asked = keys.union(keys.limit(10))
    want = model.check(asked).first()
    monkeypatch.setattr(building, "COUNT_ROWS", 1000)
    monkeypatch.setattr(building, "MOST_BITMAPS", 1)
    assert model.check(asked).first() == want
    assert (want["n"], want["n_distinct"], want["lowest"], want["highest"], want["ok"]) == (70_010, 70_000, 0, 69_999, False)


def test_a_partition_of_many_spare_slots_has_its_targets_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(building, "REDIRECT", 64)
    keys = sources.random_longs(spark, 3000, seed=4)
    for config in (MphConfig(seed=3, alpha=0.8), MphConfig(mode="partitioned", seed=3, alpha=0.7, **SMALL)):
        model = build(keys, "key", config)
        assert model.beside and model.check(keys).first()["ok"]
