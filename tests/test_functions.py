import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slotforge.functions import arith, bucketers, hashing

random.seed(5)
EDGE = [0, 1, 2**63 - 1, 2**63, 2**64 - 1, arith.MIX]
WORDS = EDGE + [random.getrandbits(64) for _ in range(300)]
M64 = 2**64 - 1


@pytest.fixture(scope="module")
def words(spark):
    rows = [(i, arith.signed(x), arith.signed(y)) for i, (x, y) in enumerate(zip(WORDS, reversed(WORDS)))]
    return spark.createDataFrame(rows, "i long, x long, y long")


def run(words, **columns):
    rows = words.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    return {n: [r[n] & M64 for r in rows] for n in columns}


def test_unsigned_arithmetic(words):
    x, y = F.col("x"), F.col("y")
    got = run(words, mix=arith.mix(x), remap=arith.remap(x, 999_983), high=arith.mul_high(x, y), less=arith.unsigned_less(x, bucketers.THRESHOLD).cast("long"))
    assert got["mix"] == [w * arith.MIX & M64 for w in WORDS]
    assert got["remap"] == [w * 999_983 >> 64 for w in WORDS]
    assert got["high"] == [w * v >> 64 for w, v in zip(WORDS, reversed(WORDS))]
    assert got["less"] == [int(w < bucketers.THRESHOLD) for w in WORDS]
    a = np.array(WORDS, np.uint64)
    assert arith.np_mix(a).tolist() == got["mix"]
    assert arith.np_remap(a, 999_983).tolist() == got["remap"]
    assert arith.np_mul_high(a, a[::-1]).tolist() == got["high"]


@pytest.mark.parametrize("name", bucketers.NAMES)
@pytest.mark.parametrize("buckets", [1, 3, 334, 100_000])
def test_bucketers_agree_and_stay_in_range(words, name, buckets):
    got = run(words, b=bucketers.EXPRESSIONS[name](F.col("x"), buckets))["b"]
    assert got == bucketers.np_bucket(name, np.array(WORDS, np.uint64), buckets).tolist()
    assert all(0 <= b < buckets for b in got)


def test_skew_constants():
    assert bucketers.THRESHOLD == 11068046884030382080
    assert [bucketers.dense_buckets(b) for b in (3, 4, 10, 334, 1000, 22222223)] == [0, 1, 3, 100, 300, 6666667]


def test_hash_families(spark):
    df = spark.createDataFrame([(42, "abc")], "n long, s string")
    first, second = hashing.hash_columns(df, ["s"], 0, "md5")
    assert df.select(first).first()[0] == -8070080442485551184
    first, second = hashing.hash_columns(df, ["n"], 7, "xxh128")
    both = xxhash.xxh128_intdigest((42).to_bytes(8, "little"), 7)
    assert tuple(df.select(first, second).first()) == (arith.signed(both >> 64), arith.signed(both))
    one, two = hashing.hash_columns(df.select(F.col("n").cast("int").alias("n")), ["n"], 7, "xx64x2")
    wide = hashing.hash_columns(df, ["n"], 7, "xx64x2")[0]
    assert df.select(F.col("n").cast("int").alias("n")).select(one).first()[0] == df.select(wide).first()[0]
    with pytest.raises(ValueError):
        hashing.guard_collisions("xx64", 2**31)
