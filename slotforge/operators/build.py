"""Build a (minimal) perfect hash function over the key columns of a DataFrame."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterable
from dataclasses import dataclass, field
from time import perf_counter

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucketers, hashing
from ..functions.arith import mix, remap
from ..plans import sizing
from ..plans.config import MphConfig
from . import encoders
from .ranks import paired, prefix_sums
from .search import RESULT, kernel

GROUP_KEYS = 1 << 18  #: keys whose partitions are searched together in one task, at most
LEAST_GROUP = 1 << 12  #: and at least, however many cores there are
TASKS_PER_CORE = 2
BITMAP = 1 << 15  #: positions of a bitmap of bitmap_or_agg
COUNT_ROWS = 1 << 18  #: positions that a task counts at a time
MOST_BITMAPS = 1 << 12  #: bitmaps that a task which counts positions holds before it passes them on
REDIRECT = 4096  #: slots whose targets stand in one row; as many as a dense partition has
BESIDE = 1 << 14  #: spare slots of a partition, on average, up to which their targets stand beside its pilots


class BuildError(RuntimeError):
    """The function could not be built."""


class DuplicateKeys(BuildError, ValueError):
    """Equal keys: no seed can tell them apart."""


@dataclass(frozen=True)
class MphModel:
    """A built function.

    partitions (pid, n, m, n_offset, m_offset, max_pilot, empty_buckets,
    largest_bucket), encoded (the pilots as ``config.encoder`` packs them, see
    ``encoders``), free (slot, target). A slot is counted over all partitions:
    m_offset + place.
    """

    config: MphConfig
    key_columns: tuple[str, ...]
    seed: int
    num_keys: int
    table_size: int
    num_partitions: int
    num_buckets: int
    partitions: DataFrame
    encoded: DataFrame
    free: DataFrame
    seconds: dict[str, float] = field(default_factory=dict, compare=False)
    _made: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    @property
    def pilots(self) -> DataFrame:
        """(pid, bucket, pilot), decoded."""
        rows = self.table.select("pid", "part", F.posexplode("pilots").alias("i", "pilot"))
        return rows.select("pid", (F.col("part") * encoders.RANGE + F.col("i")).alias("bucket"), "pilot")

    @property
    def table(self) -> DataFrame:
        """What lookups read: (pid, part, n, m, n_offset, m_offset, pilots, and from, targets if they stand beside): RANGE decoded pilots a row; made once and kept."""
        if "table" not in self._made:
            self._made["table"] = self._table([self.config.encoder]).withColumnRenamed("pilots0", "pilots").persist(StorageLevel.MEMORY_AND_DISK)
        return self._made["table"]

    def _table(self, names: list[str]) -> DataFrame:
        """``table`` with a column for each of some encoders, pilots0 and on: the pilots that come back from its encoding."""
        facts = self.partitions.select("pid", "n", "m", "n_offset", "m_offset")
        if self.beside:
            facts = facts.join(self.targets, "pid", "left")
        arrays = encoders.pilot_arrays(encoders.encode_each(self, names), self.config, self.num_partitions, names)
        return arrays.join(facts, "pid")

    @property
    def beside(self) -> bool:
        """Whether the targets of a partition's spare slots stand beside its pilots, so that lookups join once. They are few but for large partitions."""
        return self.config.minimal and self.table_size - self.num_keys <= BESIDE * self.num_partitions

    @property
    def targets(self) -> DataFrame:
        """(pid, from, targets): the targets of a partition's slots from ``from`` on, which are beyond the positions; -1 where a slot has none. Made once and kept."""
        if "targets" not in self._made:
            begin = F.greatest("m_offset", F.lit(self.num_keys)) if self.config.mode == "dense" else F.col("m_offset") + F.col("n")
            spans = self.partitions.select("pid", begin.cast("long").alias("from"), (F.col("m_offset") + F.col("m")).cast("long").alias("until")).where(F.col("from") < F.col("until"))
            rows = spans.withColumn("g", F.explode(F.sequence(F.floor(F.col("from") / REDIRECT), F.floor((F.col("until") - 1) / REDIRECT))))
            none = F.array_repeat(F.lit(-1).cast("long"), REDIRECT)
            met = rows.join(self.redirects, "g", "left").groupBy("pid", "from", "until").agg(F.array_sort(F.collect_list(F.struct("g", F.coalesce("targets", none).alias("targets")))).alias("runs"))
            whole = F.flatten(F.col("runs.targets"))
            start = (F.col("from") - F.col("runs")[0]["g"] * REDIRECT + 1).cast("int")
            some = met.select("pid", "from", F.slice(whole, start, (F.col("until") - F.col("from")).cast("int")).alias("targets"))
            self._made["targets"] = some.persist(StorageLevel.MEMORY_AND_DISK)
        return self._made["targets"]

    @property
    def redirects(self) -> DataFrame:
        """(g, targets): the targets of the slots from g * REDIRECT on, -1 where a slot has none; made once and kept."""
        if "redirects" not in self._made:
            self._made["redirects"] = redirect_arrays(self.free).persist(StorageLevel.MEMORY_AND_DISK)
        return self._made["redirects"]

    def release(self) -> None:
        """Gives back what is kept; the function still works, at the price of making it again."""
        for df in (self.partitions, self.encoded, self.free, *self._made.values()):
            df.unpersist()
        self._made.clear()

    def lookup(self, df: DataFrame, key_cols: list[str] | None = None, out: str = "pos") -> DataFrame:
        """``df`` with each key's position, [0, n) if minimal and [0, m) if not.

        A key that was not in the set gets some position in range; a null key
        gets null. Keys meet rows of RANGE pilots by partition and bucket range:
        Spark broadcasts the rows if they are few and shuffles otherwise. The
        targets of slots beyond the positions stand in the same rows, or, of
        large partitions, in rows of REDIRECT targets of their own. Keys that
        need no row (null ones; those in place) are dealt out, so that no task
        gets them all. Added columns start with __mph_ and go.
        """
        if not self.num_keys:
            return df.withColumn(out, F.lit(None).cast("long"))
        return self._looked_up(df, list(key_cols or self.key_columns), self.table.withColumnRenamed("pilots", "pilots0"), df.columns, out)

    def lookup_each(self, df: DataFrame, names: list[str], key_cols: list[str] | None = None, out: str = "pos", encoder: str = "encoder") -> DataFrame:
        """Like lookup, through several encodings of the pilots: each row once for each of some encoders. Keys are read, hashed and shuffled once for all of them."""
        every = F.array(*map(F.lit, names))
        if not self.num_keys:
            return df.withColumn(encoder, F.explode(every)).withColumn(out, F.lit(None).cast("long"))
        if names == [self.config.encoder]:
            return self.lookup(df, key_cols, out).select(*df.columns, every[0].alias(encoder), out)
        found = self._looked_up(df, list(key_cols or self.key_columns), self._table(names), [*df.columns, "__mph_which"], out)
        return found.select(*df.columns, every[F.col("__mph_which")].alias(encoder), out)

    def _looked_up(self, df: DataFrame, columns: list[str], table: DataFrame, keep: list[str], out: str) -> DataFrame:
        nowhere = -1 - F.spark_partition_id().cast("long")
        keyed = with_place(df, columns, self.config, self.seed, self.num_partitions, self.num_buckets).withColumn("__mph_pid", F.coalesce("__mph_pid", nowhere))
        each = [f"__mph_t_{c}" for c in table.columns if c.startswith("pilots")]
        table = table.select(*[F.col(c).alias(f"__mph_t_{c}") for c in table.columns])
        meets = F.col("__mph_pid") == F.col("__mph_t_pid")
        if self.num_buckets > encoders.RANGE:
            keyed = keyed.withColumn("__mph_part", F.coalesce(F.floor(F.col("__mph_bucket") / encoders.RANGE), F.lit(0)))
            meets = meets & (F.col("__mph_part") == F.col("__mph_t_part"))
        met = keyed.join(table, meets, "left")
        at = (F.col("__mph_bucket") - F.col("__mph_t_part") * encoders.RANGE + 1).cast("int")
        if len(each) == 1 and "__mph_which" not in keep:
            met = met.withColumn("__mph_pilot", F.try_element_at(each[0], at))
        else:  # a row for each encoder, so that the generated code does not grow with their number
            met = met.select("*", F.posexplode(F.array(*[F.try_element_at(c, at) for c in each])).alias("__mph_which", "__mph_pilot"))
        met = met.withColumn("__mph_mixed", F.col("__mph_second").bitwiseXOR(mix(F.col("__mph_pilot"))))
        met = met.withColumn("__mph_mixed", mix(F.col("__mph_mixed"))).withColumn("__mph_place", remap(F.col("__mph_mixed"), F.col("__mph_t_m")))
        met = met.withColumn("__mph_slot", F.col("__mph_t_m_offset") + F.col("__mph_place"))
        slot = F.col("__mph_slot")
        kept = [F.col(c) for c in keep]
        if not self.config.minimal:
            return met.select(*kept, slot.alias(out))
        direct = F.when(slot < self.num_keys, slot) if self.config.mode == "dense" else F.when(F.col("__mph_place") < F.col("__mph_t_n"), F.col("__mph_t_n_offset") + F.col("__mph_place"))
        known = F.col("__mph_pid") >= 0
        stray = F.when(F.col("__mph_known"), F.lit(0).cast("long"))  # a foreign key that meets no used slot, or a partition without keys
        if self.beside:
            met = met.withColumns({"__mph_known": known, "__mph_direct": direct})
            target = F.when(F.col("__mph_direct").isNull(), F.try_element_at("__mph_t_targets", (slot - F.col("__mph_t_from") + 1).cast("int")))
            return met.select(*kept, F.coalesce("__mph_direct", F.when(target >= 0, target), stray).alias(out))
        found = met.select(*kept, known.alias("__mph_known"), direct.alias("__mph_direct"), F.when(direct.isNull(), slot).alias("__mph_slot"))
        found = found.withColumn("__mph_g", F.coalesce(F.floor(F.col("__mph_slot") / REDIRECT), nowhere))
        free = self.redirects.select(F.col("g").alias("__mph_free"), F.col("targets").alias("__mph_targets"))
        done = found.join(free, F.col("__mph_g") == F.col("__mph_free"), "left")
        target = F.try_element_at("__mph_targets", (F.col("__mph_slot") - F.col("__mph_g") * REDIRECT + 1).cast("int"))
        return done.select(*kept, F.coalesce("__mph_direct", F.when(target >= 0, target), stray).alias(out))

    def lookup_verified(self, df: DataFrame, keys: DataFrame, key_cols: list[str] | None = None, out: str = "pos") -> DataFrame:
        """Like lookup, but null for keys that ``keys``, the set the function was built on, does not hold."""
        columns = list(key_cols or self.key_columns)
        stored = self.lookup(keys.select(*self.key_columns).distinct(), out="__mph_at")
        stored = stored.select(F.col("__mph_at"), *[F.col(c).alias(f"__mph_k_{c}") for c in self.key_columns])
        found = self.lookup(df, columns, "__mph_pos")
        same = F.col("__mph_pos") == F.col("__mph_at")
        for c, k in zip(columns, self.key_columns, strict=True):
            same = same & (F.col(c) == F.col(f"__mph_k_{k}"))
        return found.join(stored, same, "left").select(*[F.col(c) for c in df.columns], F.col("__mph_at").alias(out))

    def check(self, keys: DataFrame) -> DataFrame:
        """One row: n, n_distinct, lowest, highest, total, ok. Distinct positions in range make the check sufficient."""
        return self.check_each(keys, [self.config.encoder]).drop("encoder")

    def check_each(self, keys: DataFrame, names: Iterable[str]) -> DataFrame:
        """A row for each of some encoders: encoder, then what check has, by lookups through its encoding. The keys are read, hashed and shuffled once for all."""
        names = list(dict.fromkeys(names))
        found = self.lookup_each(keys.select(*self.key_columns), names).select("encoder", "pos")
        limit = self.num_keys if self.config.minimal else self.table_size
        some = position_bitmaps(found).groupBy("encoder", "part").agg(
            F.sum("n").alias("n"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("n_distinct"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.sum("rest").alias("rest")
        )
        start = F.col("part").cast("decimal(19,0)") * BITMAP * F.col("n")
        total = F.sum((start + F.col("rest")).cast("decimal(38,0)"))
        rows = some.groupBy("encoder").agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), total.alias("total"))
        every = keys.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("encoder"))
        rows = every.join(rows, "encoder", "left").select("encoder", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "lowest", "highest", "total")
        good = (F.col("n") == self.num_keys) & (F.col("n_distinct") == self.num_keys) & (F.coalesce("lowest", F.lit(0)) >= 0) & (F.coalesce("highest", F.lit(-1)) < limit)
        return rows.withColumn("ok", good)


def with_place(df: DataFrame, columns: list[str], config: MphConfig, seed: int, partitions: int, buckets: int) -> DataFrame:
    """``df`` with __mph_pid, __mph_bucket and __mph_second, null for null keys."""
    first, second = hashing.hash_columns(df, columns, seed, config.hash_family)
    null = any_null(columns)
    hashed = df.withColumns({"__mph_first": F.when(~null, first), "__mph_second": F.when(~null, second)})
    pid = bucketers.uniform(hashing.mixed(F.col("__mph_first"), F.col("__mph_second"), config.hash_family), partitions) if partitions > 1 else F.when(F.col("__mph_first").isNotNull(), F.lit(0).cast("long"))
    return bucketers.with_bucket(hashed.withColumn("__mph_pid", pid), config.bucketer, "__mph_first", buckets, "__mph_bucket").drop("__mph_first")


def any_null(columns: list[str]) -> Column:
    null = F.col(columns[0]).isNull()
    for c in columns[1:]:
        null = null | F.col(c).isNull()
    return null


def redirect_arrays(free: DataFrame) -> DataFrame:
    """(g, targets) from (slot, target)."""
    import numpy as np
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        out = np.full(REDIRECT, -1, np.int64)
        out[group.column("slot").to_numpy() % REDIRECT] = group.column("target").to_numpy()
        return pa.table({"g": group.column("g").slice(0, 1), "targets": pa.array([out], pa.list_(pa.int64()))})

    return free.select(F.floor(F.col("slot") / REDIRECT).alias("g"), "slot", "target").groupBy("g").applyInArrow(run, "g long, targets array<long>")


def position_bitmaps(found: DataFrame) -> DataFrame:
    """(encoder, part, n, lowest, highest, rest, bits) from (encoder, pos): ranges of BITMAP positions, a bit a position; rest: sum of the places in the range.

    No row is sorted or shuffled for it. Keys come partition by partition from
    the join, so a task has few ranges at a time; one that holds MOST_BITMAPS
    passes them on, and a range may have several rows.
    """
    import numpy as np
    import pyarrow as pa

    range_, most, rows = BITMAP, MOST_BITMAPS, COUNT_ROWS

    def passed(held: dict) -> pa.RecordBatch:
        encoder, part = zip(*held, strict=True)
        *longs, bits = zip(*held.values(), strict=True)
        columns = [pa.array(encoder, pa.string()), *[pa.array(x, pa.int64()) for x in (part, *longs)], pa.array([x.tobytes() for x in bits], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["encoder", "part", "n", "lowest", "highest", "rest", "bits"])

    def add(held: dict, encoder: str, pos: np.ndarray) -> None:
        pos = np.sort(pos)
        part = pos // range_
        edges = np.flatnonzero(np.diff(part)) + 1
        for own, k in zip(np.split(pos, edges), part[[0, *edges]].tolist(), strict=True):
            places = own - k * range_
            flags = np.zeros(range_, bool)
            flags[places] = True
            bits, low, high, rest = np.packbits(flags, bitorder="little"), int(own[0]), int(own[-1]), int(places.sum())
            n, lowest, highest, before, old = held.get((encoder, k), (0, low, high, 0, 0))
            held[encoder, k] = n + len(own), min(lowest, low), max(highest, high), before + rest, bits | old

    def run(batches):
        held: dict[tuple[str, int], tuple] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        count = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                name = batch.column(0).dictionary_encode()
                code, pos = name.indices.to_numpy(), batch.column(1)
                known = pos.is_valid().to_numpy(zero_copy_only=False)
                pos = pos.fill_null(0).to_numpy()
                for k, encoder in enumerate(name.dictionary.to_pylist()):
                    waiting.setdefault(encoder, []).append(pos[(code == k) & known])
                count += batch.num_rows
            if batch is None or count >= rows:
                for encoder, some in waiting.items():
                    if len(all_ := np.concatenate(some)):
                        add(held, encoder, all_)
                waiting, count = {}, 0
            if held and (batch is None or len(held) >= most):
                yield passed(held)
                held = {}

    return found.mapInArrow(run, "encoder string, part long, n long, lowest long, highest long, rest long, bits binary")


def plan(n: int, config: MphConfig) -> tuple[int, int]:
    """(partitions, buckets of each)."""
    if config.mode == "dense":
        average = sizing.dense_partition_size(n)
    elif config.mode == "partitioned":
        average = sizing.clamped_partition_size(n, config.avg_partition_size, config.min_partition_size)
    else:
        average = n
    if average > config.most_keys:
        about = sizing.kernel_bytes(average, sizing.table_size(average, config.alpha), sizing.num_buckets(average, config.lam)) >> 20
        raise BuildError(f"{average} keys are too many for one task (about {about} MB): use partitioned or dense mode")
    return sizing.num_partitions(n, average), max(1, sizing.num_buckets(average, config.lam))


def build(df: DataFrame, key_cols: list[str] | str, config: MphConfig | None = None, phases: bool = False) -> MphModel:
    """The function over the keys of ``df``; rows are keys.

    Null keys are an error. Equal keys are an error too, or dropped if the
    configuration says so. No rows give an empty function (except in dense
    mode, which needs 4096 keys). One pass hashes and shuffles the keys; each
    task searches whole partitions; the driver only sees counts. ``phases``
    also times hashing and the shuffle by themselves, at the price of keeping what is shuffled until the search is done.
    """
    config = config or MphConfig()
    columns = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    began = perf_counter()
    keys = df.select(*columns)
    if config.on_duplicates == "drop":
        keys = keys.distinct()
    n, nulls = keys.agg(F.count("*"), F.count_if(any_null(columns))).first()
    if nulls:
        raise ValueError(f"{nulls} null keys")
    hashing.guard_collisions(config.hash_family, n)
    spark = df.sparkSession
    if not n and config.mode != "dense":
        empty = spark.createDataFrame([], "pid long, n long, m long, n_offset long, m_offset long, max_pilot long, empty_buckets long, largest_bucket long")
        return MphModel(config, tuple(columns), config.seed or 0, 0, 0, 0, 0, empty, spark.createDataFrame([], encoders.ENCODED), spark.createDataFrame([], "slot long, target long"))
    partitions, buckets = plan(n, config)
    dense = config.mode == "dense"
    seconds = {"planning": perf_counter() - began}
    reasons: dict[str, int] = {}
    for _ in range(1 if config.seed is not None else config.max_attempts):
        seed = config.seed if config.seed is not None else random.getrandbits(63)
        began = perf_counter()
        together = max(LEAST_GROUP, min(GROUP_KEYS, n // (TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
        per_group = max(1, together * partitions // max(1, n))  # the result does not depend on it
        placed = with_place(keys, columns, config, seed, partitions, buckets).select(F.col("__mph_pid").alias("pid"), F.col("__mph_bucket").alias("bucket"), F.col("__mph_second").alias("payload")).withColumn("part_group", F.floor(F.col("pid") / per_group))
        seconds["mapping"] = 0.0
        if phases:
            placed = placed.repartition("part_group").persist(StorageLevel.MEMORY_AND_DISK)  # the search reads what is shuffled here
            placed.count()
            seconds["mapping"] = perf_counter() - began
            began = perf_counter()
        work = kernel(sizing.DENSE_SLOTS if dense else None, config.alpha, buckets, config.max_pilot, n)
        found = placed.groupBy("part_group").applyInArrow(work, RESULT).persist(StorageLevel.MEMORY_AND_DISK)
        reasons = {r["problem"]: r["count"] for r in found.where("problem is not null").groupBy("problem").count().collect()}  # four kinds at most
        seconds["searching"] = max(0.0, perf_counter() - began - seconds["mapping"])
        placed.unpersist()
        if not reasons:
            break
        found.unpersist()
        if "duplicate" in reasons and keys.groupBy(*columns).count().where("count > 1").limit(1).count():
            raise DuplicateKeys("keys are not distinct")
    else:
        raise BuildError(f"no function found: {reasons}")
    began = perf_counter()
    known = found.select("pid", "n", "m", "max_pilot", "empty_buckets", "largest_bucket")
    if partitions > 1:  # partitions without keys count as well
        known = spark.range(partitions).withColumnRenamed("id", "pid").join(known, "pid", "left").fillna(0)
        if dense:
            known = known.withColumn("m", F.lit(sizing.DENSE_SLOTS).cast("long"))
    known = prefix_sums(known, "pid", {"n_offset": "n", "m_offset": "m"}).persist(StorageLevel.MEMORY_AND_DISK)
    encoded = encoders.encoded(found.select("pid", "pilots"), config, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    m = known.agg(F.sum("m")).first()[0]
    free = spark.createDataFrame([], "slot long, target long")
    if config.minimal and m > n:
        if dense:
            slot = F.col("pid") * sizing.DENSE_SLOTS
            above = found.select("pid", F.explode("above").alias("place")).select("pid", (slot + F.col("place")).alias("slot"))
            gaps = found.select("pid", F.explode("gaps").alias("place")).select("pid", (slot + F.col("place")).alias("target"))
            gaps = gaps.union(_empty_slots(spark, found, partitions, n))
            free = paired(above, gaps, "pid")
        else:
            moves = found.select("pid", F.explode(F.arrays_zip("above", "gaps")).alias("x")).join(known.select("pid", "n_offset", "m_offset"), "pid")
            free = moves.select((F.col("m_offset") + F.col("x.above")).alias("slot"), (F.col("n_offset") + F.col("x.gaps")).alias("target"))
        free = free.persist(StorageLevel.MEMORY_AND_DISK)
        free.count()
    seconds["assembling"] = perf_counter() - began
    began = perf_counter()
    encoded.count()
    seconds["encoding"] = perf_counter() - began
    found.unpersist()
    return MphModel(config, tuple(columns), seed, n, m, partitions, buckets, known, encoded, free, seconds)


def _empty_slots(spark, found: DataFrame, partitions: int, n: int) -> DataFrame:
    """(pid, target): the slots below n of dense partitions that no key fell into."""
    empty = spark.range(partitions).withColumnRenamed("id", "pid").join(found.select("pid"), "pid", "left_anti")
    first = F.col("pid") * sizing.DENSE_SLOTS
    last = F.least(first + sizing.DENSE_SLOTS, F.lit(n)) - 1
    return empty.where(first < n).select("pid", F.explode(F.sequence(first, last)).alias("target"))
