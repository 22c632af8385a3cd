"""Where keys come from: text lines, iterators, generators, caches; and benchmark records."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import signed, xorshift

#: Field of a benchmark record: type it is cast to (fixed values: the records hold strings).
RECORD = {
    "n": "bigint", "lambda": "double", "alpha": "double", "minimal": "boolean", "encoder_type": "string", "bucketer_type": "string", "avg_partition_size": "bigint",
    "num_partitions": "bigint", "dense_partitioning": "boolean", "seed": "decimal(20,0)", "num_threads": "bigint", "external_memory": "boolean",
    "partitioning_microseconds": "bigint", "mapping_ordering_microseconds": "bigint", "searching_microseconds": "bigint", "encoding_microseconds": "bigint", "total_microseconds": "bigint",
    "pt_bits_per_key": "double", "mapper_bits_per_key": "double", "bits_per_key": "double", "nanosec_per_key": "double",
}


def read_lines(spark: SparkSession, path: str, column: str = "key", most: int | None = None) -> DataFrame:
    """A key per line, of the first ``most`` lines if given. More than one blank line is an error: blank keys would be equal."""
    lines = spark.read.text(path).withColumnRenamed("value", column)
    if most is not None:
        lines = lines.limit(most)
    if lines.where(F.col(column) == "").limit(2).count() > 1:
        raise ValueError("more than one blank line")
    return lines


def line_stats(df: DataFrame, column: str = "key") -> DataFrame:
    """One row: count, longest, total and average length in bytes, blank lines."""
    size = F.octet_length(column)
    return df.agg(F.count("*").alias("n"), F.max(size).cast("long").alias("longest"), F.sum(size).alias("total"), F.avg(size).alias("average"), F.count_if(F.col(column) == "").alias("blank"))


def from_iterator(spark: SparkSession, keys: Iterable, path: str, kind: str = "string", rows: int = 1_000_000, column: str = "key") -> DataFrame:
    """Keys of a one-pass iterator, written to ``path`` in runs of ``rows``, then read back."""
    schema = f"{column} {kind}"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    source = iter(keys)
    while run := [(k,) for k in itertools.islice(source, rows)]:
        spark.createDataFrame(run, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def random_longs(spark: SparkSession, n: int, seed: int = 0, column: str = "key") -> DataFrame:
    """n distinct longs: xorshift steps permute the 64-bit values other than 0, so nothing need be made distinct."""
    start = F.col("id") + F.lit(1 + (seed & 0xFFFFFFFF) * (1 << 30))
    x = start
    for _ in range(2):
        x = xorshift(x)
    return spark.range(n).select(x.bitwiseXOR(F.lit(signed(seed * 0x9E3779B97F4A7C15))).alias(column))


def random_strings(spark: SparkSession, n: int, seed: int = 0, column: str = "key") -> DataFrame:
    """n distinct strings of 10 to 49 characters: 10 that number them, in an order of their own, and a random rest."""
    space = 36**10
    number = F.pmod(F.col("id") * 1_000_003 + F.lit(seed % space), F.lit(space))
    rest = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id")), 256), F.lit(1), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(40)).cast("int"))
    return spark.range(n).select(F.concat(F.lpad(F.lower(F.conv(number.cast("string"), 10, 36)), 10, "0"), rest).alias(column))


def cached(spark: SparkSession, path: str, make, n: int, seed: int) -> DataFrame:
    """make(spark, n, seed), kept under ``path`` by n and seed."""
    place = f"{path}/n={n}/seed={seed}"
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(place)
    except (AnalysisException, Py4JJavaError):
        make(spark, n, seed).write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark records, one JSON object of strings per line, cast to their types."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in RECORD)).json(path)
    return cast_records(raw)


def cast_records(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in RECORD.items()])
