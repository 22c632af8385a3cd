"""Prefix sums and free slots as joins and windows that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

CHUNK = 4096
RANGE_ROWS = 1 << 20  #: rows ranked by one task


def prefix_sums(df: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """``df`` with exclusive prefix sums (new name: column) by an integer key that has one row each.

    Sums within chunks of CHUNK keys, and sums of whole chunks before: the
    only window without a partition runs over one row per chunk.
    """
    chunk = F.floor(F.col(key) / CHUNK).cast("long")
    parts = df.withColumn("__chunk", chunk)
    total = parts.groupBy("__chunk").agg(*[F.sum(c).alias(f"__{new}") for new, c in values.items()])
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select("__chunk", *[F.coalesce(F.sum(f"__{new}").over(before), F.lit(0)).alias(f"__{new}") for new in values])
    inner = Window.partitionBy("__chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(new) for new, c in values.items()])
    joined = summed.join(offset, "__chunk")
    return joined.select(*df.columns, *[(F.col(new) + F.col(f"__{new}")).alias(new) for new in values])


def ranked(df: DataFrame, key: str, within: str, rank: str = "rank") -> DataFrame:
    """``df`` (key, within, ...) with each row's 0-based place in the order of key, then within."""
    counts = prefix_sums(df.groupBy(key).agg(F.count("*").alias("__n")), key, {"__before": "__n"}).select(key, "__before")
    own = df.withColumn("__own", F.row_number().over(Window.partitionBy(key).orderBy(within)) - 1)
    return own.join(counts, key).withColumn(rank, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before")


def ranked_in_ranges(df: DataFrame, order: list[str], rank: str = "rank", rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with each row's 0-based place in the order of some columns that tell all rows apart.

    Rows are dealt to ranges of about ``rows`` each by sampled bounds and
    written, so that counts and ranks see the same ranges; each is ranked alone.
    """
    ranges = max(1, -(-df.count() // rows))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id().cast("long")), "ranges")
    before = prefix_sums(dealt.groupBy("__range").agg(F.count("*").alias("__n")), "__range", {"__before": "__n"}).select("__range", "__before")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(rank, (F.col("__own") + F.col("__before")).cast("long")).drop("__range", "__own", "__before")  # one row a range


def free_slots(used: DataFrame, n: int, group_slots: int = 1 << 16) -> DataFrame:
    """(slot, target): a slot below n for every used slot from n on, both in ascending order.

    ``used`` has a column slot, each once, n rows in all. The k-th used slot
    from n on takes the k-th unused slot below n: there are as many of both.
    """
    last = max(0, n - 1)
    slots = used.where(F.col("slot") < n).groupBy(F.floor(F.col("slot") / group_slots).cast("long").alias("g")).agg(F.collect_set("slot").alias("held"))
    groups = used.sparkSession.range(0, last // group_slots + 1 if n else 0).withColumnRenamed("id", "g").join(slots, "g", "left")
    whole = F.sequence(F.col("g") * group_slots, F.least((F.col("g") + 1) * group_slots - 1, F.lit(last)))
    free = groups.select("g", F.explode(F.array_except(whole, F.coalesce("held", F.array().cast("array<long>")))).alias("target"))
    above = used.where(F.col("slot") >= n).select(F.floor(F.col("slot") / group_slots).cast("long").alias("g"), "slot")
    return paired(above, free, "g")


def paired(above: DataFrame, free: DataFrame, group: str) -> DataFrame:
    """(slot, target): the k-th slot of ``above`` with the k-th target of ``free``; groups are ranges in ascending order."""
    return ranked(above, group, "slot").join(ranked(free, group, "target"), "rank").select("slot", "target")
