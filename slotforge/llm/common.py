"""Helpers shared by the training-data operators."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import removed, written  # noqa: F401

#: Bytes that separate words; also what ``bytes.split()`` splits on.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each value of a string (or binary) column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if pa.types.is_string(kind):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(kind):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of each (one more than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def slices(texts: list[bytes | None], most: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (null: empty) of about ``most`` bytes, with the index of their first."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text or b""
        if run and size + len(text) > most:
            yield start, run
            start, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def hashed_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most ``most`` rows: those with the smallest hashes of the columns.

    Rows are first thinned by hash to a little over that, so that only about
    ``most`` rows, not so many of each task, reach the driver.
    """
    n = df.count()
    if n > most:
        share = most / n
        least = int((1 << 32) * min(1.0, share + 6 * (share / n) ** 0.5 + 10 / n))
        df = df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 32)) <= least)
    return df.orderBy(F.pmod(F.xxhash64(*columns), F.lit(1 << 32)), *columns).limit(most)


def code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def batches_of(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph.

    ``edges`` has two columns of one type. Returns (node, root) for each node
    of an edge. Alternating large-star and small-star rounds: each round is
    two aggregations and two joins, never a collected neighbour list, and is
    written to the shared folder. An empty graph gives no rows; loops and
    repeated edges change nothing.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = written(pairs, name)

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(pairs)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
        )
        old, pairs = pairs, written(small.where("u <> v").distinct(), name)
        removed(old)
        after = mark(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def flips(bits: list[int], most: int) -> list[int]:
    """XOR patterns of up to ``most`` of the given bit positions, as signed 64-bit values."""
    out = []
    for k in range(most + 1):
        for chosen in itertools.combinations(bits, k):
            value = sum(1 << i for i in chosen)
            out.append(value - (1 << 64) if value >> 63 else value)
    return out
