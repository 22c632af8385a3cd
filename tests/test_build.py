import numpy as np
import pytest
from pyspark.sql import functions as F

from slotforge.operators import encoders
from slotforge.operators.apply import dictionary_encode, direct_join, members
from slotforge.operators.build import BuildError, DuplicateKeys, build
from slotforge.operators.ranks import free_slots
from slotforge.operators.search import search
from slotforge.plans.config import DENSE_ENCODERS, PLAIN_ENCODERS, MphConfig
from slotforge.sources import model_io
from slotforge.sources.keys import random_longs, random_strings

SMALL = {"avg_partition_size": 500, "min_partition_size": 100}


def positions(model, df):
    return [r[0] for r in model.lookup(df).select("pos").collect()]


@pytest.mark.parametrize("minimal", [True, False])
@pytest.mark.parametrize("bucketer,family,alpha,lam", [("uniform", "xx64x2", 1.0, 4.0), ("skew", "md5", 0.97, 5.0), ("opt", "xx64", 0.94, 6.0)])
@pytest.mark.parametrize("mode", ["single", "partitioned"])
def test_bijection(spark, mode, bucketer, family, alpha, lam, minimal):
    keys = random_longs(spark, 1777, seed=3)
    model = build(keys, "key", MphConfig(mode=mode, bucketer=bucketer, hash_family=family, alpha=alpha, lam=lam, minimal=minimal, seed=11, **SMALL))
    row = model.check(keys).first()
    assert row["ok"] and row["n_distinct"] == 1777
    found = positions(model, keys)
    if minimal:
        assert sorted(found) == list(range(1777))
    else:
        assert len(set(found)) == 1777 and max(found) < model.table_size


@pytest.mark.parametrize("minimal", [True, False])
def test_dense(spark, minimal):
    keys = random_strings(spark, 9000, seed=2)
    model = build(keys, "key", MphConfig(mode="dense", minimal=minimal, seed=4))
    assert model.table_size == 4096 * model.num_partitions
    found = positions(model, keys)
    assert len(set(found)) == 9000
    assert not minimal or sorted(found) == list(range(9000))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny(spark, n):
    keys = spark.range(n).select(F.col("id").alias("key"))
    model = build(keys, "key", MphConfig(seed=1))
    assert sorted(positions(model, keys)) == list(range(n))
    assert model.check(keys).first()["ok"]


def test_result_does_not_depend_on_order_or_partitions(spark):
    keys = random_longs(spark, 3000, seed=8)
    config = MphConfig(mode="partitioned", seed=5, **SMALL)
    one = build(keys, "key", config).pilots.orderBy("pid", "bucket").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        other = build(keys.orderBy(F.rand(1)).repartition(5), "key", config).pilots.orderBy("pid", "bucket").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == other


def test_smallest_pilots_by_brute_force():
    mask, mix = 2**64 - 1, 0x517CC1B727220A95
    rng = np.random.default_rng(1)
    n, m, buckets = 60, 64, 15
    payload = rng.integers(0, 2**63, n).astype(np.uint64)
    bucket = rng.integers(0, buckets, n)
    got = search(np.zeros(n, np.int64), bucket, payload, {0: m}, buckets)[0]
    groups = {b: [int(p) for p, x in zip(payload, bucket) if x == b] for b in set(bucket.tolist())}
    taken, want = set(), [0] * buckets
    for b in sorted(groups, key=lambda b: (-len(groups[b]), -b)):
        for pilot in range(10**6):
            spots = [((p ^ (pilot * mix & mask)) * mix & mask) * m >> 64 for p in groups[b]]
            if len(set(spots)) == len(spots) and not taken & set(spots):
                taken |= set(spots)
                want[b] = pilot
                break
    assert got["pilots"].tolist() == want and set(got["taken"].tolist()) == taken


def test_errors(spark):
    twice = spark.createDataFrame([(1,), (1,), (2,)], "key long")
    with pytest.raises(DuplicateKeys):
        build(twice, "key")
    assert build(twice, "key", MphConfig(on_duplicates="drop", seed=1)).num_keys == 2
    with pytest.raises(ValueError):
        build(spark.createDataFrame([(1,), (None,)], "key long"), "key")
    with pytest.raises(ValueError):
        build(spark.range(100), "id", MphConfig(mode="dense"))
    with pytest.raises(BuildError):
        build(spark.range(100), "id", MphConfig(most_keys=10))
    with pytest.raises(BuildError):
        build(spark.range(4000), "id", MphConfig(lam=4000.0, seed=1))  # a bucket of more than 255 keys


def test_clashing_names_null_lookups_and_strangers(spark):
    keys = spark.createDataFrame([(i, i) for i in range(50)], "key long, pilot long")
    model = build(keys, "key", MphConfig(seed=1))
    asked = spark.createDataFrame([(3, "a", 1), (None, "b", 2), (99, "c", 3)], "key long, bucket string, n long")
    rows = {r["bucket"]: r for r in model.lookup(asked).collect()}
    assert rows["b"]["pos"] is None and 0 <= rows["c"]["pos"] < 50 and rows["a"]["n"] == 1
    sure = {r["bucket"]: r["pos"] for r in model.lookup_verified(asked, keys).collect()}
    assert sure["a"] == rows["a"]["pos"] and sure["b"] is None and sure["c"] is None
    assert {r["bucket"]: r["member"] for r in members(asked, "key", model, keys).collect()} == {"a": True, "b": False, "c": False}


def test_composite_keys(spark):
    keys = spark.createDataFrame([(i, f"x{j}") for i in range(30) for j in range(20)], "a int, b string")
    model = build(keys, ["a", "b"], MphConfig(seed=2))
    assert sorted(positions(model, keys)) == list(range(600))


def test_save_and_load(spark, tmp_path):
    keys = random_longs(spark, 800, seed=1)
    model = build(keys, "key", MphConfig(mode="partitioned", seed=9, **SMALL))
    model_io.save(model, str(tmp_path / "f"))
    again = model_io.load(spark, str(tmp_path / "f"))
    assert again.config == model.config
    a, b = model.lookup(keys), again.lookup(keys)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("name", ["C", "PC", "D", "EF", "R", "C-C", "D-D", "R-R"])
@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [7], [1, 2, 3, 2**33, 0, 5], list(range(600)), [3] * 300 + [0] * 300])
def test_codecs(name, values):
    data, bits = encoders.encode_values(name, np.array(values, np.int64))
    assert encoders.decode_values(name, data, len(values)).tolist() == values
    assert bits >= 0


def test_encoded_models(spark):
    keys = random_longs(spark, 9000, seed=6)
    for config, names in ((MphConfig(mode="partitioned", seed=3, **SMALL), PLAIN_ENCODERS[:3]), (MphConfig(mode="dense", seed=3), DENSE_ENCODERS[2:6])):
        model = build(keys, "key", config)
        for name in names:
            kept, back = encoders.sequences(model, name), encoders.decode(encoders.encode(model, name))
            assert kept.exceptAll(back).count() == 0 and back.exceptAll(kept).count() == 0
        assert 1 < encoders.bits(model).first()["total_bits_per_key"] < 16


def test_free_slots_of_no_spare(spark):
    used = spark.createDataFrame([(0,), (1,), (5,), (9,)], "slot long")
    assert sorted(tuple(r) for r in free_slots(used, 4).collect()) == [(5, 2), (9, 3)]


def test_dictionary_and_join(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("zz", 4)], "k string, v long")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "j string, w long")
    coded, model = dictionary_encode(right, "j", MphConfig(seed=1))
    assert sorted(r["code"] for r in coded.collect()) == [0, 1, 2]
    assert sorted((r["k"], r["v"], r["w"]) for r in direct_join(left, right, "k", "j", model).collect()) == [("a", 1, 10), ("b", 2, 20)]
