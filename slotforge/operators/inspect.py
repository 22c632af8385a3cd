"""Views of the steps of a build, as DataFrames: placement, partition sizes, bucket sizes, search order, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import MphConfig
from .build import with_place
from .ranks import prefix_sums


def placement(df: DataFrame, columns: list[str], config: MphConfig, partitions: int, buckets: int) -> DataFrame:
    """(pid, bucket, payload) of each key."""
    placed = with_place(df.select(*columns), columns, config, config.seed or 0, partitions, buckets)
    return placed.select(F.col("__mph_pid").alias("pid"), F.col("__mph_bucket").alias("bucket"), F.col("__mph_second").alias("payload"))


def partition_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("pid").agg(F.count("*").alias("n"))


def partition_offsets(placed: DataFrame) -> DataFrame:
    """(pid, n, offset): where each partition's positions begin."""
    return prefix_sums(partition_sizes(placed), "pid", {"offset": "n"})


def partition_extremes(placed: DataFrame) -> DataFrame:
    return partition_sizes(placed).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count("*").alias("partitions"))


def bucket_sizes(placed: DataFrame) -> DataFrame:
    """(size, buckets): how many buckets have so many keys."""
    return placed.groupBy("pid", "bucket").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("buckets"))


def search_order(placed: DataFrame) -> DataFrame:
    """(pid, bucket, size, turn): the order in which a partition's buckets are placed."""
    sizes = placed.groupBy("pid", "bucket").agg(F.count("*").alias("size"))
    return sizes.withColumn("turn", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("size"), F.desc("bucket"))).cast("long"))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
