"""What positions are for: dictionary codes, direct-address joins, dense group ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .build import MphConfig, MphModel, build


def dictionary_encode(df: DataFrame, key: str, config: MphConfig | None = None, out: str = "code") -> tuple[DataFrame, MphModel]:
    """``df`` with a dense code in [0, distinct) for each distinct value of ``key`` (null: null), and the function."""
    config = (config or MphConfig()).but(minimal=True)
    model = build(df.select(key).where(F.col(key).isNotNull()).distinct(), key, config)
    return model.lookup(df, [key], out), model


def direct_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, model: MphModel, how: str = "inner") -> DataFrame:
    """Join on positions instead of keys: 8-byte join keys whatever the keys' width.

    The function was built on the distinct keys of ``right``; keys of ``left``
    that it lacks are told apart by comparing the keys themselves.
    """
    a, b = model.lookup(left, [left_key], "__pos_a"), model.lookup(right, [right_key], "__pos_b")
    return a.join(b, (F.col("__pos_a") == F.col("__pos_b")) & (F.col(left_key) == F.col(right_key)), how).drop("__pos_a", "__pos_b")


def group_by_id(df: DataFrame, key: str, model: MphModel, *aggregates: Column) -> DataFrame:
    """Aggregates per key, grouped by dense id: (id, key, aggregates)."""
    return model.lookup(df, [key], "id").groupBy("id").agg(F.first(key, ignorenulls=True).alias(key), *aggregates)


def members(df: DataFrame, key: str, model: MphModel, keys: DataFrame) -> DataFrame:
    """``df`` with member: whether the key is one the function was built on."""
    return model.lookup_verified(df, keys, [key], "__pos").withColumn("member", F.col("__pos").isNotNull()).drop("__pos")
