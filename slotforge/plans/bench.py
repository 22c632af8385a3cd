"""Measured builds and sweeps; each result is a benchmark record."""

from __future__ import annotations

from collections.abc import Iterable
from time import perf_counter

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import encoders
from ..operators.build import build
from ..sources.keys import RECORD
from .config import DENSE_ENCODERS, PLAIN_ENCODERS, MphConfig

LAMBDAS, ALPHAS, BUCKETERS, RUNS = range(2, 11), (0.94, 0.97), ("skew", "opt"), 2


def lookup_seconds(model, keys: DataFrame, runs: int = 5) -> float:
    """Mean time to look all keys up and drop the positions."""
    began = perf_counter()
    for _ in range(runs):
        model.lookup(keys).select("pos").write.format("noop").mode("overwrite").save()
    return (perf_counter() - began) / runs


def measure(keys: DataFrame, columns: list[str], config: MphConfig, names: Iterable[str] | None = None, runs: int = 5, queries: int | None = None, verify: bool = False) -> list[dict]:
    """One build, then a record for each encoder. The phases add up to the total: planning, joining offsets and free slots count as partitioning, hashing and the shuffle as mapping."""
    model = build(keys, columns, config, phases=True)
    total = sum(model.seconds.values()) - model.seconds["encoding"]
    partitioning = model.seconds["planning"] + model.seconds["assembling"]
    asked = keys if queries is None else keys.limit(queries)
    n = max(1, asked.count())
    lookup = lookup_seconds(model, asked, runs) / n * 1e9 if runs else None
    if verify and not model.check(keys).first()["ok"]:
        raise AssertionError("positions are not distinct")
    out = []
    for name in names or [config.encoder]:
        began = perf_counter()
        bits = encoders.bits(model, name).first()
        spent = model.seconds["encoding"] if name == config.encoder else perf_counter() - began
        record = {
            "n": model.num_keys, "lambda": config.lam, "alpha": None if config.mode == "dense" else config.alpha, "minimal": config.minimal, "encoder_type": name, "bucketer_type": config.bucketer,
            "avg_partition_size": model.num_keys // max(1, model.num_partitions), "num_partitions": model.num_partitions, "dense_partitioning": config.mode == "dense", "seed": model.seed,
            "num_threads": keys.sparkSession.sparkContext.defaultParallelism, "external_memory": False, "partitioning_microseconds": int(partitioning * 1e6),
            "mapping_ordering_microseconds": int(model.seconds["mapping"] * 1e6), "searching_microseconds": int(model.seconds["searching"] * 1e6), "encoding_microseconds": int(spent * 1e6),
            "total_microseconds": int((total + spent) * 1e6), "pt_bits_per_key": bits["pilot_bits_per_key"], "mapper_bits_per_key": bits["mapper_bits_per_key"], "bits_per_key": bits["total_bits_per_key"], "nanosec_per_key": lookup,
        }
        out.append({k: None if record[k] is None else str(record[k]).lower() if isinstance(record[k], bool) else str(record[k]) for k in RECORD})
    model.release()
    return out


def sweep(keys: DataFrame, columns: list[str], lambdas: Iterable[float] = LAMBDAS, alphas: Iterable[float] = ALPHAS, bucketers: Iterable[str] = BUCKETERS, runs: int = RUNS, base: MphConfig | None = None, lookups: int = 5) -> list[dict]:
    """Partitioned builds over lambda x alpha x bucketer, dense ones once for each lambda and bucketer; all encoders each. The keys are worked out once and kept for all builds and lookups."""
    base = base or MphConfig(mode="partitioned")
    kept = keys.is_cached
    keys = keys.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    for lam in lambdas:
        for bucketer in bucketers:
            for _ in range(runs):
                for alpha in alphas:
                    out += measure(keys, columns, base.but(mode="partitioned", lam=lam, alpha=alpha, bucketer=bucketer, encoder="C"), PLAIN_ENCODERS, runs=lookups)
                out += measure(keys, columns, base.but(mode="dense", lam=lam, bucketer=bucketer, encoder="C"), DENSE_ENCODERS, runs=lookups)
    if not kept:
        keys.unpersist()
    return out


def write_records(spark: SparkSession, records: list[dict], path: str) -> None:
    """JSON lines, appended."""
    spark.createDataFrame([tuple(r.values()) for r in records], ", ".join(f"`{c}` string" for c in RECORD)).coalesce(1).write.mode("append").json(path)
