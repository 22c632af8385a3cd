"""Registered queries over the key-set operators, each with the SQL that must give the same rows.

Either the result does not depend on the hash (any correct function has it),
or the md5 family is used, which the SQL computes as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arith
from ..operators import apply, encoders, inspect, ranks
from ..operators.build import build
from ..sources import keys as sources
from ..sources import model_io
from ..sources.scratch import scratch_path
from ..streaming.lookup import stream_lookup
from . import bench, report, sizing
from .config import DENSE_ENCODERS, PLAIN_ENCODERS, MphConfig, compact_preset

SEED = 20240
SMALL = {"avg_partition_size": 3000, "min_partition_size": 1000}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _checked(df: DataFrame, key: list[str] | str, config: MphConfig) -> DataFrame:
    model = build(df, key, config)
    row = model.check(df)
    if config.minimal:
        return row.select("n", "n_distinct", F.col("lowest"), F.col("highest"), F.col("total").cast("double").alias("total"), "ok")
    return row.select("n", "n_distinct", "ok")


def _minimal_sql(source: str) -> str:
    return f"SELECT n, n AS n_distinct, 0::BIGINT AS lowest, n - 1 AS highest, (n * (n - 1) / 2)::DOUBLE AS total, true AS ok FROM (SELECT count(*) AS n FROM {source})"


def mph_single(spark, sf):
    return _checked(_table(spark, sf, "customer"), "c_custkey", MphConfig(seed=SEED))


def mph_partitioned(spark, sf):
    return _checked(_table(spark, sf, "orders"), "o_orderkey", MphConfig(mode="partitioned", seed=SEED, **SMALL))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct composite keys: enough for dense partitions at every scale. Builds, lookups and checks read them many times, so they are kept."""
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().persist(StorageLevel.MEMORY_AND_DISK)


_PAIR = ["l_orderkey", "l_linenumber"]


def mph_dense(spark, sf):
    return _checked(_lines(spark, sf), _PAIR, MphConfig(mode="dense", seed=SEED, bucketer="opt"))


def mph_dense_composite(spark, sf):
    return _checked(_lines(spark, sf), _PAIR, compact_preset(lam=5.0, seed=SEED))


def mph_non_minimal(spark, sf):
    return _checked(_table(spark, sf, "events"), "event_id", MphConfig(mode="partitioned", minimal=False, alpha=0.97, seed=SEED, **SMALL))


def mph_string_keys(spark, sf):
    return _checked(_table(spark, sf, "pages").select("url").distinct(), "url", MphConfig(bucketer="uniform", seed=SEED))


def mph_binary_keys(spark, sf):
    names = _table(spark, sf, "customer").select(F.encode("c_name", "UTF-8").alias("k"))
    return _checked(names, "k", MphConfig(hash_family="xxh128", seed=SEED))


def mph_full_load(spark, sf):
    return _checked(_table(spark, sf, "supplier"), "s_suppkey", MphConfig(alpha=1.0, seed=SEED))


_MD5 = MphConfig(hash_family="md5", seed=0)


def _placed(spark, sf, bucketer: str, partitions: int, buckets: int) -> DataFrame:
    return inspect.placement(_table(spark, sf, "customer"), ["c_custkey"], _MD5.but(bucketer=bucketer), partitions, buckets)


_WORDS = """words AS (SELECT ('0x' || substr(md5(c_custkey::VARCHAR), 1, 16))::UBIGINT AS first, ('0x' || substr(md5(c_custkey::VARCHAR), 17, 16))::UBIGINT AS second FROM customer)"""
_UNIFORM = "(((first >> 32)::UHUGEINT * {b}) >> 32)::BIGINT"
_SKEW = "(CASE WHEN first < 11068046884030382080::UBIGINT THEN ((((first & 4294967295)::UHUGEINT << 32) * 100) >> 64)::BIGINT ELSE 100 + ((((first & 4294967295)::UHUGEINT << 32) * 234) >> 64)::BIGINT END)"
_PLACED = f"WITH {_WORDS}, placed AS (SELECT (((xor(first, second) >> 32)::UHUGEINT * 16) >> 32)::BIGINT AS pid, {_SKEW} AS bucket FROM words)"


def partition_sizes(spark, sf):
    return inspect.partition_sizes(_placed(spark, sf, "uniform", 16, 334))


def partition_extremes(spark, sf):
    return inspect.partition_extremes(_placed(spark, sf, "uniform", 16, 334))


def partition_offsets(spark, sf):
    return inspect.partition_offsets(_placed(spark, sf, "uniform", 16, 334)).select("pid", "n", F.col("offset").cast("long").alias("offset"))


def bucket_histogram(spark, sf):
    out = None
    for name in ("uniform", "skew", "opt"):
        one = inspect.bucket_sizes(_placed(spark, sf, name, 1, 334)).withColumn("bucketer", F.lit(name))
        out = one if out is None else out.union(one)
    return out


BUCKET_SQL = f"""WITH {_WORDS}, squares AS (SELECT *, ((first::UHUGEINT * first::UHUGEINT) >> 64) AS s, ((first >> 1) | 9223372036854775808::UBIGINT) AS y FROM words),
curved AS (SELECT *, ((s * y::UHUGEINT) >> 64)::UBIGINT AS z FROM squares),
b AS (SELECT 'uniform' AS bucketer, {_UNIFORM.format(b=334)} AS bucket FROM words UNION ALL SELECT 'skew', {_SKEW} FROM words
  UNION ALL SELECT 'opt', ((((z // 8) * 7 + first // 8)::UHUGEINT * 334) >> 64)::BIGINT FROM curved)
SELECT bucketer, size, count(*) AS buckets FROM (SELECT bucketer, bucket, count(*) AS size FROM b GROUP BY ALL) GROUP BY ALL"""


def search_order(spark, sf):
    return inspect.search_order(_placed(spark, sf, "skew", 16, 334))


def free_slots(spark, sf):
    """Free slots of a made-up placement: distinct hash positions in a table with a tenth to spare."""
    orders = _table(spark, sf, "orders")
    slot = F.col("o_orderkey") + F.floor(F.col("o_orderkey") / 7)
    used = orders.select(slot.cast("long").alias("slot"))
    return ranks.free_slots(used, orders.count())


FREE_SQL = """WITH used AS (SELECT (o_orderkey + o_orderkey // 7)::BIGINT AS slot FROM orders), n AS (SELECT count(*) AS n FROM used),
above AS (SELECT slot, row_number() OVER (ORDER BY slot) AS r FROM used, n WHERE slot >= n),
free AS (SELECT s AS target, row_number() OVER (ORDER BY s) AS r FROM (SELECT unnest(range(0, (SELECT n FROM n))) AS s) WHERE s NOT IN (SELECT slot FROM used))
SELECT slot, target FROM above JOIN free USING (r)"""


def duplicate_keys(spark, sf):
    return inspect.duplicates(_table(spark, sf, "lineitem"), ["l_orderkey"])


_SIZES = (4599, 15_000, 45_832, 100_000, 150_000, 456_861, 1_000_000, 100_000_000)


def sizing_plan(spark, sf):
    rows = []
    for n in _SIZES:
        a = sizing.dense_partition_size(n)
        p = sizing.num_partitions(n, a)
        rows.append((n, a, p, sizing.largest_partition(a, p), sizing.num_buckets(a, 4.5), sizing.clamped_partition_size(n, 1000), sizing.table_size(n, 0.94)))
    return spark.createDataFrame(rows, "n long, average long, partitions long, largest long, buckets long, clamped long, slots long")


SIZING_SQL = f"""WITH n AS (SELECT unnest({list(_SIZES)})::BIGINT AS n), a AS (SELECT n, unnest(range(3596, 4096))::BIGINT AS a FROM n),
p AS (SELECT n, a, ceil(n / a)::BIGINT AS p, floor(a + sqrt(2 * a * ln(ceil(n / a))))::BIGINT AS top FROM a),
best AS (SELECT n, min(a) AS average FROM p WHERE top + 0.5 >= 4096 GROUP BY n)
SELECT p.n, average, p AS partitions, top AS largest, ceil(average / 4.5)::BIGINT AS buckets, least(p.n, 100000)::BIGINT AS clamped, floor(p.n / 0.94::DOUBLE)::BIGINT AS slots
FROM p JOIN best ON p.n = best.n AND p.a = best.average"""


def pilot_entropy(spark, sf):
    return encoders.entropy(_table(spark, sf, "lineitem"), "l_quantity").select(F.round("entropy", 6).alias("entropy"))


def compact_blocks(spark, sf):
    values = _table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.pmod(F.col("c_custkey") * 37, F.lit(1 + 3)).alias("value"))
    return encoders.block_widths(values, "i", "value")


def dictionary_codes(spark, sf):
    return encoders.dictionary_codes(_table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("q")), "q")


def prefix_sums(spark, sf):
    values = _table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    sums = ranks.prefix_sums(values, "p_partkey", {"before": "size"})
    return sums.select("p_partkey", "size", F.col("before").cast("long").alias("before"))


def direct_join(spark, sf):
    orders, customers = _table(spark, sf, "orders").select("o_custkey", "o_totalprice"), _table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    model = build(customers, "c_custkey", MphConfig(mode="partitioned", seed=SEED, **SMALL))
    met = apply.direct_join(orders, customers, "o_custkey", "c_custkey", model)
    return met.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")), 2).cast("double").alias("total"))


def dense_group_by(spark, sf):
    events = _table(spark, sf, "events")
    model = build(events.select("user_id").distinct(), "user_id", MphConfig(seed=SEED))
    return apply.group_by_id(events, "user_id", model, F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")).drop("id")


def dictionary_encoding(spark, sf):
    coded, _ = apply.dictionary_encode(_table(spark, sf, "part").select("p_name"), "p_name", MphConfig(seed=SEED))
    codes = coded.groupBy("p_name").agg(F.count_distinct("code").alias("codes"), F.count("*").alias("n"))
    span = coded.agg((F.max("code") + 1).alias("span"), F.count_distinct("code").alias("used"))
    return codes.join(F.broadcast(span))  # span is one row


def membership(spark, sf):
    labels, docs = _table(spark, sf, "labels").select("doc_id"), _table(spark, sf, "documents").select("doc_id")
    model = build(labels.distinct(), "doc_id", MphConfig(seed=SEED))
    return apply.members(docs, "doc_id", model, labels)


def line_stats(spark, sf):
    return sources.line_stats(_table(spark, sf, "pages").select(F.col("url").alias("key")))


_RECORDS = [
    # n, lambda, alpha, encoder, bucketer, partitions, dense, microseconds, bits, nanoseconds
    (100_000_000, 7.0, None, "C-int", "opt", 26_192, True, 8_311_588, 2.509203, 33.461714), (100_000_000, 7.0, 0.94, "C-C", "opt", 34, False, 10_230_403, 2.499817, 33.747594),
    (100_000_000, 7.0, 0.94, "C-C", "opt", 34, False, 10_330_403, 2.499817, 34.747594), (100_000_000, 4.0, 0.97, "EF", "skew", 34, False, 3_100_000, 5.5, 51.25),
]
_RECORD_COLUMNS = ["n", "lambda", "alpha", "encoder_type", "bucketer_type", "num_partitions", "dense_partitioning", "total_microseconds", "bits_per_key", "nanosec_per_key"]


def _records(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame([tuple(None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r) for r in _RECORDS], ", ".join(f"`{c}` string" for c in _RECORD_COLUMNS))
    missing = [c for c in sources.RECORD if c not in _RECORD_COLUMNS]
    return sources.cast_records(raw.select("*", *[F.lit(None).cast("string").alias(c) for c in missing]))


def bench_report(spark, sf):
    records = report.filled_alpha(_records(spark))
    build_times = report.averages(report.select(records, "partitioned", "opt", 0.94), "build").select("lambda", "alpha", F.lit("build").alias("measure"), F.round("total_seconds", 6).alias("value"))
    space = report.averages(records, "space").select("lambda", "alpha", F.lit("space").alias("measure"), F.round("bits_per_key", 6).alias("value"))
    top = report.limits(records, "space").select(F.lit(None).cast("double").alias("lambda"), F.lit(None).cast("double").alias("alpha"), F.lit("highest").alias("measure"), F.col("highest").alias("value"))
    return build_times.union(space).union(top)


_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in _RECORDS)
_NAMES = ", ".join(f'"{c}"' for c in _RECORD_COLUMNS)
REPORT_SQL = f"""WITH t({_NAMES}) AS (VALUES {_VALUES}),
r AS (SELECT "lambda"::DOUBLE AS "lambda", (CASE WHEN dense_partitioning THEN -1.0 ELSE alpha END)::DOUBLE AS alpha, encoder_type, bucketer_type, num_partitions, dense_partitioning, total_microseconds, bits_per_key::DOUBLE AS bits_per_key FROM t)
SELECT "lambda", alpha, 'build' AS measure, round((avg(total_microseconds) / 1e6)::DOUBLE, 6) AS value FROM r WHERE NOT dense_partitioning AND num_partitions > 1 AND bucketer_type = 'opt' AND alpha = 0.94 GROUP BY ALL
UNION ALL SELECT "lambda", alpha, 'space', round(value, 6) FROM (SELECT "lambda", alpha, encoder_type, bucketer_type, num_partitions, avg(bits_per_key) AS value FROM r GROUP BY ALL)
UNION ALL SELECT NULL, NULL, 'highest', least(max(bits_per_key), 5.0) FROM r"""


def mixed_words(spark, sf):
    """Multiplication and remapping of unsigned words, summed up in decimal."""
    h = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 16), 16, -10).cast("long")
    words = _table(spark, sf, "customer").select("c_custkey", h.alias("h"))
    return words.select("c_custkey", arith.mix(F.col("h")).alias("mixed"), arith.remap(F.col("h"), 1_000_003).alias("slot"), arith.mul_high(F.col("h"), F.col("h")).alias("square"))


_SIGNED = "(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN ({x})::HUGEINT - 18446744073709551616::HUGEINT ELSE ({x})::HUGEINT END)::BIGINT"
MIX_SQL = f"""WITH w AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 16))::UBIGINT::UHUGEINT AS h FROM customer),
x AS (SELECT c_custkey, (h * 5871781006564002453::UHUGEINT) % 18446744073709551616::UHUGEINT AS m, (h * 1000003) >> 64 AS s, (h * h) >> 64 AS q FROM w)
SELECT c_custkey, {_SIGNED.format(x="m")} AS mixed, s::BIGINT AS slot, {_SIGNED.format(x="q")} AS square FROM x"""


def encoded_round_trip(spark, sf):
    """Pilots that change in any of the encodings of a partitioned and of a dense function."""
    rows = None
    for df, key, config, names in ((_table(spark, sf, "orders"), "o_orderkey", MphConfig(mode="partitioned", seed=SEED, **SMALL), PLAIN_ENCODERS), (_lines(spark, sf), _PAIR, MphConfig(mode="dense", seed=SEED), DENSE_ENCODERS)):
        model = build(df, key, config)
        lost = encoders.lost(model, names)
        rows = lost if rows is None else rows.union(lost)
    return rows.agg(F.sum("lost").cast("long").alias("lost"))


def encoded_lookup(spark, sf):
    """Lookups through each encoder: a partitioned function over customers, a dense one over order lines."""
    rows = None
    for df, key, config, names in ((_table(spark, sf, "customer"), "c_custkey", MphConfig(mode="partitioned", seed=SEED, **SMALL), PLAIN_ENCODERS), (_lines(spark, sf), _PAIR, MphConfig(mode="dense", seed=SEED), DENSE_ENCODERS)):
        model = build(df, key, config)
        each = model.check_each(df, names).select(F.lit(config.mode).alias("mode"), "encoder", "n", "n_distinct", "lowest", "highest", "ok")
        rows = each if rows is None else rows.union(each)
    return rows


def _lookup_sql(source: str, mode: str, names: tuple[str, ...]) -> str:
    return f"SELECT '{mode}' AS mode, unnest({list(names)}) AS encoder, n, n AS n_distinct, 0::BIGINT AS lowest, n - 1 AS highest, true AS ok FROM (SELECT count(*) AS n FROM {source})"


def _tiny(spark, sf):
    """A function over 25 names, small enough for SQL to search as well."""
    return build(_table(spark, sf, "nation"), "n_name", MphConfig(hash_family="md5", seed=0, bucketer="uniform", lam=2.5, alpha=0.94))


def tiny_pilots(spark, sf):
    return _tiny(spark, sf).pilots.select("bucket", "pilot")


def tiny_pilot_entropy(spark, sf):
    return encoders.entropy(_tiny(spark, sf).pilots, "pilot").select(F.round("entropy", 6).alias("entropy"))


def tiny_space(spark, sf):
    """Bits of the pilots in fixed width and in blocks, a width of 8 bits each."""
    model = _tiny(spark, sf)
    return encoders.bits(model, "C").select(F.lit("C").alias("encoder"), "pilot_bits").union(encoders.bits(model, "PC").select(F.lit("PC"), "pilot_bits"))


#: 25 keys, 10 buckets, 26 slots; each bucket in turn takes the first pilot whose slots are free.
_WALK = """WITH RECURSIVE words AS (SELECT ('0x' || substr(md5(n_name), 1, 16))::UBIGINT AS first, ('0x' || substr(md5(n_name), 17, 16))::UBIGINT AS second FROM nation),
placed AS (SELECT (((first >> 32)::UHUGEINT * 10) >> 32)::BIGINT AS bucket, second FROM words),
turns AS (SELECT bucket, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, bucket DESC) AS turn FROM placed GROUP BY bucket),
spread AS (SELECT p, ((p::UHUGEINT * 5871781006564002453::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS s FROM range(20000) t(p)),
slots AS (SELECT bucket, p, (((((xor(second, s))::UHUGEINT * 5871781006564002453::UHUGEINT) % 18446744073709551616::UHUGEINT) * 26) >> 64)::BIGINT AS slot FROM placed, spread),
tries AS (SELECT t.turn, t.bucket, p, list(slot) AS slots FROM slots JOIN turns t USING (bucket) GROUP BY t.turn, t.bucket, t.size, p HAVING count(DISTINCT slot) = t.size),
walk AS (SELECT 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS bucket, NULL::BIGINT AS pilot
  UNION ALL SELECT w.turn + 1, list_concat(any_value(w.taken), arg_min(t.slots, t.p)), any_value(t.bucket), min(t.p)
  FROM walk w JOIN tries t ON t.turn = w.turn + 1 WHERE NOT list_has_any(t.slots, w.taken) GROUP BY w.turn),
pilots AS (SELECT b AS bucket, coalesce(pilot, 0) AS pilot FROM range(10) t(b) LEFT JOIN walk ON walk.bucket = b)"""


def elias_fano_sums(spark, sf):
    """Sums of part sizes brand by brand, out of their Elias-Fano codes."""
    parts = _table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("size"))

    def run(group):
        group = group.sort_by("p_partkey")
        n = group.num_rows
        back = encoders.decode_values("EF", encoders.encode_values("EF", group.column("size").to_numpy())[0], n)
        return pa.table({"p_brand": group.column("p_brand"), "p_partkey": group.column("p_partkey"), "total": pa.array(np.cumsum(back), pa.int64())})

    return parts.groupBy("p_brand").applyInArrow(run, "p_brand string, p_partkey long, total long")


def mph_drawn_seed(spark, sf):
    """Keys with repeats, which are dropped, and a seed that is drawn until one works."""
    lines = _table(spark, sf, "lineitem").select("l_orderkey")
    model = build(lines, "l_orderkey", MphConfig(mode="partitioned", on_duplicates="drop", **SMALL))
    return model.check(lines.distinct()).select("n", "n_distinct", "lowest", "highest", F.col("total").cast("double").alias("total"), "ok")


def xorshift_words(spark, sf):
    state, below = arith.xorshift_below(F.col("c_custkey"), 1000)
    return _table(spark, sf, "customer").select("c_custkey", state.alias("state"), below.alias("below"))


def sweep_grid(spark, sf):
    """What a small sweep has measured: a record for each encoder of each configuration."""
    records = bench.sweep(_lines(spark, sf), _PAIR, lambdas=(4.0,), alphas=(0.97,), bucketers=("skew",), runs=1, lookups=1)
    raw = spark.createDataFrame([tuple(r.values()) for r in records], ", ".join(f"`{c}` string" for c in sources.RECORD))
    spent = [F.col(f"{c}_microseconds") for c in ("partitioning", "mapping_ordering", "searching", "encoding")]
    adds_up = F.abs(sum(spent[1:], spent[0]) - F.col("total_microseconds")) <= 5  # rounded down each
    return sources.cast_records(raw).select("n", "lambda", "alpha", "encoder_type", "dense_partitioning", adds_up.alias("adds_up"), (F.col("bits_per_key") > 0).alias("sized"), (F.col("nanosec_per_key") > 0).alias("looked_up"))


def sorted_distinct(spark, sf):
    return report.values(_table(spark, sf, "events"), "event_type")


def stream_positions(spark, sf):
    """A stream of events looked up against a function, through a Parquet sink."""
    events = _table(spark, sf, "events")
    model = build(events.select("user_id").distinct(), "user_id", MphConfig(seed=SEED))
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").load(sf, format="parquet")
    out = scratch_path(spark, "stream")
    found = stream_lookup(stream, model).select("event_id", "user_id", "pos")
    found.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.schema("event_id long, user_id long, pos long").parquet(out)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("positions"))


def saved_function(spark, sf):
    """Positions that change when a function is saved and loaded, and positions in all."""
    orders = _table(spark, sf, "orders").select("o_orderkey")
    model = build(orders, "o_orderkey", MphConfig(mode="partitioned", seed=SEED, **SMALL))
    path = scratch_path(spark, "function")
    model_io.save(model, path)
    a, b = model.lookup(orders), model_io.load(spark, path).lookup(orders)
    return a.join(b.withColumnRenamed("pos", "again"), "o_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("pos") != F.col("again")).alias("changed"))


QUERIES = {
    f.__name__: f
    for f in (
        mph_single, mph_partitioned, mph_dense, mph_dense_composite, mph_non_minimal, mph_string_keys, mph_binary_keys, mph_full_load, partition_sizes, partition_extremes, partition_offsets,
        bucket_histogram, search_order, free_slots, duplicate_keys, sizing_plan, pilot_entropy, compact_blocks, dictionary_codes, prefix_sums, direct_join, dense_group_by, dictionary_encoding,
        membership, line_stats, bench_report, mixed_words, encoded_round_trip, sorted_distinct, stream_positions, saved_function,
        encoded_lookup, tiny_pilots, tiny_pilot_entropy, tiny_space, elias_fano_sums, mph_drawn_seed, xorshift_words, sweep_grid,
    )
}

ORACLE_SQL = {
    "mph_single": _minimal_sql("customer"),
    "mph_partitioned": _minimal_sql("orders"),
    "mph_dense": _minimal_sql("(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"),
    "mph_dense_composite": _minimal_sql("(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"),
    "mph_non_minimal": "SELECT count(*) AS n, count(*) AS n_distinct, true AS ok FROM events",
    "mph_string_keys": _minimal_sql("(SELECT DISTINCT url FROM pages)"),
    "mph_binary_keys": _minimal_sql("customer"),
    "mph_full_load": _minimal_sql("supplier"),
    "partition_sizes": _PLACED + " SELECT pid, count(*) AS n FROM placed GROUP BY pid",
    "partition_extremes": _PLACED + " SELECT min(n) AS smallest, max(n) AS largest, count(*) AS partitions FROM (SELECT pid, count(*) AS n FROM placed GROUP BY pid)",
    "partition_offsets": _PLACED + ' SELECT pid, n, (coalesce(sum(n) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM (SELECT pid, count(*) AS n FROM placed GROUP BY pid)',
    "bucket_histogram": BUCKET_SQL,
    "search_order": _PLACED + " SELECT pid, bucket, size, row_number() OVER (PARTITION BY pid ORDER BY size DESC, bucket DESC) AS turn FROM (SELECT pid, bucket, count(*) AS size FROM placed GROUP BY ALL)",
    "free_slots": FREE_SQL,
    "duplicate_keys": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
    "sizing_plan": SIZING_SQL,
    "pilot_entropy": "SELECT round(sum(-p * log2(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_quantity)",
    "compact_blocks": "SELECT block, width, coalesce(sum(width * n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT c_custkey // 256 AS block, greatest(1, ceil(log2(max((c_custkey * 37) % 4) + 1)))::BIGINT AS width, count(*) AS n FROM customer GROUP BY 1)",
    "dictionary_codes": "SELECT l_quantity::BIGINT AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_quantity::BIGINT) - 1 AS code FROM lineitem GROUP BY l_quantity",
    "prefix_sums": "SELECT p_partkey, p_size::BIGINT AS size, coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM part",
    "direct_join": "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(20, 2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "dense_group_by": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "dictionary_encoding": "SELECT p_name, 1::BIGINT AS codes, count(*) AS n, (SELECT count(DISTINCT p_name) FROM part) AS span, (SELECT count(DISTINCT p_name) FROM part) AS used FROM part GROUP BY p_name",
    "membership": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS member FROM documents",
    "line_stats": "SELECT count(*) AS n, max(strlen(url))::BIGINT AS longest, sum(strlen(url))::BIGINT AS total, avg(strlen(url)) AS average, count(*) FILTER (WHERE url = '') AS blank FROM pages",
    "bench_report": REPORT_SQL,
    "mixed_words": MIX_SQL,
    "encoded_round_trip": "SELECT 0::BIGINT AS lost",
    "stream_positions": "SELECT user_id, count(*) AS n, 1::BIGINT AS positions FROM events GROUP BY user_id",
    "saved_function": "SELECT count(*) AS n, 0::BIGINT AS changed FROM orders",
    "sorted_distinct": "SELECT DISTINCT event_type FROM events ORDER BY 1",
    "encoded_lookup": _lookup_sql("customer", "partitioned", PLAIN_ENCODERS) + " UNION ALL " + _lookup_sql("(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)", "dense", DENSE_ENCODERS),
    "tiny_pilots": _WALK + " SELECT bucket, pilot FROM pilots",
    "tiny_pilot_entropy": _WALK + " SELECT round(sum(-p * log2(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM pilots GROUP BY pilot)",
    "tiny_space": _WALK + " SELECT unnest(['C', 'PC']) AS encoder, 10 * greatest(1, ceil(log2(max(pilot) + 1)))::BIGINT + 8 AS pilot_bits FROM pilots",
    "elias_fano_sums": "SELECT p_brand, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey)::BIGINT AS total FROM part",
    "mph_drawn_seed": _minimal_sql("(SELECT DISTINCT l_orderkey FROM lineitem)"),
    "xorshift_words": f"""WITH a AS (SELECT c_custkey, xor(c_custkey::UHUGEINT, (c_custkey::UHUGEINT << 13) % 18446744073709551616::UHUGEINT) AS x FROM customer),
b AS (SELECT c_custkey, xor(x, x >> 7) AS x FROM a), c AS (SELECT c_custkey, xor(x, (x * 131072) % 18446744073709551616::UHUGEINT) AS x FROM b)
SELECT c_custkey, {_SIGNED.format(x="x")} AS state, ((x * 1000) >> 64)::BIGINT AS below FROM c""",
    "sweep_grid": f"""SELECT n, 4.0::DOUBLE AS "lambda", alpha::DOUBLE AS alpha, encoder_type, dense AS dense_partitioning, true AS adds_up, true AS sized, true AS looked_up
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), (SELECT unnest({list(PLAIN_ENCODERS)}) AS encoder_type, 0.97 AS alpha, false AS dense UNION ALL SELECT unnest({list(DENSE_ENCODERS)}), NULL, true)""",
}
