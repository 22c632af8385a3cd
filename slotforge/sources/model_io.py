"""Functions as Parquet: a header row and three tables, the pilots packed by the encoder of the function."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..operators.build import MphModel
from ..plans.config import MphConfig

TABLES = ("partitions", "encoded", "free")


def save(model: MphModel, path: str) -> None:
    spark = model.partitions.sparkSession
    header = {"config": json.dumps(asdict(model.config)), "key_columns": json.dumps(model.key_columns), "seed": model.seed, "num_keys": model.num_keys, "table_size": model.table_size, "num_partitions": model.num_partitions, "num_buckets": model.num_buckets}
    schema = "config string, key_columns string, seed decimal(20,0), num_keys long, table_size long, num_partitions long, num_buckets long"
    from decimal import Decimal

    spark.createDataFrame([(*list(header.values())[:2], Decimal(model.seed), *list(header.values())[3:])], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    for name in TABLES:
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> MphModel:
    row = spark.read.parquet(f"{path}/header").first()
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return MphModel(MphConfig(**json.loads(row["config"])), tuple(json.loads(row["key_columns"])), int(row["seed"]), row["num_keys"], row["table_size"], row["num_partitions"], row["num_buckets"], **tables)
