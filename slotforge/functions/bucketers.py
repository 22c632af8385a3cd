"""Key hash to bucket: uniform, skew and opt, as columns and on numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arith import M32, high, let, low, mul_high, np_mul_high, np_remap, remap, unsigned_less

NAMES = ("uniform", "skew", "opt")
#: 60 % of the keys go to 30 % of the buckets, both as 32-bit floats.
DENSE_KEYS, DENSE_BUCKETS = np.float32(0.6), np.float32(0.3)
THRESHOLD = int(float(DENSE_KEYS) * 2.0**64)


def dense_buckets(buckets: int) -> int:
    return int(DENSE_BUCKETS * np.float32(buckets))


def uniform(h: Column, buckets: int) -> Column:
    if buckets > 1 << 32:
        raise ValueError("at most 2^32 ranges")
    upper, n = high(h), F.lit(buckets).cast("long")
    return F.shiftright(F.shiftright(upper, 16) * n + F.shiftright(upper.bitwiseAND(F.lit(0xFFFF)) * n, 16), 16)  # no product reaches 2^63


def skew(h: Column, buckets: int) -> Column:
    dense = dense_buckets(buckets)
    place = F.shiftleft(low(h), 32)
    return F.when(unsigned_less(h, THRESHOLD), remap(place, dense) if dense else F.lit(0).cast("long")).otherwise(F.lit(dense) + remap(place, buckets - dense))


def _curve_start(x: Column) -> Column:
    return mul_high(x, x)


def _curve_end(x: Column, square: Column) -> Column:
    return mul_high(square, F.shiftrightunsigned(x, 1).bitwiseOR(F.lit(-(1 << 63))))


def _blend(x: Column, z: Column) -> Column:
    """7/8 z + 1/8 x."""
    upper_z, upper_x = F.shiftrightunsigned(z, 3), F.shiftrightunsigned(x, 3)
    lower = low(upper_z) * 7 + low(upper_x)
    upper = low(high(upper_z) * 7 + high(upper_x) + high(lower))
    return F.shiftleft(upper, 32).bitwiseOR(low(lower))


def opt(h: Column, buckets: int) -> Column:
    """Approximates x + (1 - e)(1 - x) ln(1 - x) with e = 1/8 by the product of h, h and (1 + h) / 2."""
    return let(h, lambda x: let(let(_curve_start(x), lambda s: let(_curve_end(x, s), lambda z: _blend(x, z))), lambda y: remap(y, buckets)))


EXPRESSIONS = {"uniform": uniform, "skew": skew, "opt": opt}


def with_bucket(df: DataFrame, name: str, h: str, buckets: int, out: str) -> DataFrame:
    """``df`` with the bucket of the hash column ``h``. What is used more than once is a column of a step of its own, so it is worked out once, inside generated code."""
    if name != "opt":
        return df.withColumn(out, EXPRESSIONS[name](F.col(h), buckets))
    steps = df.withColumn("__opt_s", _curve_start(F.col(h)))
    steps = steps.withColumn("__opt_z", _curve_end(F.col(h), F.col("__opt_s")))
    steps = steps.withColumn("__opt_y", _blend(F.col(h), F.col("__opt_z")))
    return steps.withColumn(out, remap(F.col("__opt_y"), buckets)).drop("__opt_s", "__opt_z", "__opt_y")


def np_bucket(name: str, h: np.ndarray, buckets: int) -> np.ndarray:
    """The same on uint64 arrays."""
    if name == "uniform":
        return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    if name == "skew":
        dense, place = dense_buckets(buckets), (h & np.uint64(M32)) << np.uint64(32)
        return np.where(h < np.uint64(THRESHOLD), np_remap(place, dense), np.uint64(dense) + np_remap(place, buckets - dense))
    z = np_mul_high(np_mul_high(h, h), (h >> np.uint64(1)) | np.uint64(1 << 63))
    return np_remap((z >> np.uint64(3)) * np.uint64(7) + (h >> np.uint64(3)), buckets)
