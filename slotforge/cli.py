"""python -m slotforge.cli: build a function over the lines of a file or over random keys, check it, measure it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .functions.bucketers import NAMES
from .plans.bench import measure
from .plans.config import DENSE_ENCODERS, MODES, PLAIN_ENCODERS, MphConfig
from .sources.keys import random_longs, read_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-n", type=int, default=100_000, help="random keys, if there is no file")
    p.add_argument("-i", "--input", help="a file with one key per line")
    p.add_argument("-m", "--mode", choices=MODES, default="single")
    p.add_argument("-l", "--lam", type=float, default=4.5)
    p.add_argument("-a", "--alpha", type=float, default=0.94)
    p.add_argument("-b", "--bucketer", choices=NAMES, default="skew")
    p.add_argument("-e", "--encoder", default="C", help="an encoder, or all")
    p.add_argument("-p", "--partition-size", type=int, default=0)
    p.add_argument("-s", "--seed", type=int)
    p.add_argument("-q", "--queries", type=int, default=0, help="keys to look up for the timing; 0: none")
    p.add_argument("-o", "--output", help="where to save the function")
    p.add_argument("--non-minimal", action="store_true")
    p.add_argument("--check", action="store_true")
    return p


def main(args: list[str] | None = None) -> list[dict]:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    keys = read_lines(spark, a.input) if a.input else random_longs(spark, a.n, a.seed or 0)
    names = (DENSE_ENCODERS if a.mode == "dense" else PLAIN_ENCODERS) if a.encoder == "all" else (a.encoder,)
    config = MphConfig(mode=a.mode, lam=a.lam, alpha=a.alpha, bucketer=a.bucketer, encoder=names[0], seed=a.seed, minimal=not a.non_minimal, avg_partition_size=a.partition_size)
    records = measure(keys, ["key"], config, names, runs=5 if a.queries else 0, queries=a.queries or None, verify=a.check)
    if a.output:
        from .operators.build import build
        from .sources.model_io import save

        save(build(keys, "key", config.but(seed=int(records[0]["seed"]))), a.output)
    for record in records:
        print(json.dumps(record))
    return records


if __name__ == "__main__":
    main()
