"""Reports over benchmark records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What tells configurations apart; build times do not depend on the encoder.
KEYS = ["n", "lambda", "alpha", "minimal", "encoder_type", "bucketer_type", "avg_partition_size", "num_partitions", "dense_partitioning", "seed", "num_threads", "external_memory"]
MEASURES = {"space": "bits_per_key", "query": "nanosec_per_key", "build": "total_microseconds"}
CEILING = 5.0  #: the top of the space axis


def filled_alpha(records: DataFrame, dense_alpha: float | None = None) -> DataFrame:
    """Dense records have no alpha of their own: they get the one given, or -1."""
    return records.withColumn("alpha", F.when(F.col("dense_partitioning"), F.lit(-1.0 if dense_alpha is None else dense_alpha)).otherwise(F.col("alpha")))


def select(records: DataFrame, family: str | None = None, bucketer: str | None = None, alpha: float | None = None, encoder: str | None = None) -> DataFrame:
    """Records of a family (partitioned or dense), bucketer, alpha and encoder, each if given."""
    wanted = {"dense": F.col("dense_partitioning"), "partitioned": ~F.col("dense_partitioning") & (F.col("num_partitions") > 1)}
    out = records.where(wanted[family]) if family else records
    for name, value in (("bucketer_type", bucketer), ("alpha", alpha), ("encoder_type", encoder)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def averages(records: DataFrame, measure: str) -> DataFrame:
    """Mean of a measure (space, query, build) per configuration; build times in seconds as well."""
    column = MEASURES[measure]
    keys = [k for k in KEYS if measure != "build" or k != "encoder_type"]
    out = records.groupBy(*keys).agg(F.avg(column).alias(column))
    return out.withColumn("total_seconds", F.col(column) / 1e6) if measure == "build" else out


def limits(records: DataFrame, measure: str) -> DataFrame:
    """One row: lowest and highest; the highest space is cut off at CEILING."""
    column = MEASURES[measure]
    top = F.max(column)
    return records.agg(F.min(column).alias("lowest"), (F.least(top, F.lit(CEILING)) if measure == "space" else top).alias("highest"))


def values(records: DataFrame, column: str) -> DataFrame:
    return records.select(column).distinct().orderBy(column)
