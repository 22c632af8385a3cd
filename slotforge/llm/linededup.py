"""Reversible line dedup: sharded cuckoo filters over exact reference tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, code_points, written

SLOTS = 4  #: fingerprints per bucket
SHARD_KEYS = 100_000  #: keys a shard is sized for
GROUP_LINES = 200_000  #: line references probed by one task group


def line_key(line: bytes) -> bytes:
    """What makes two lines equal: stripped of white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Cuckoo filter of 16-bit fingerprints over 16-byte digests; supports deletion.

    ``add`` returns False when no place is found; the caller then rebuilds at
    twice the size, so that nothing is ever lost (no false negatives).
    """

    def __init__(self, buckets: int):
        self.mask = buckets - 1
        assert buckets & self.mask == 0, "buckets must be a power of two"
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        buckets = 1 << max(3, int(len(digests) / (0.85 * SLOTS)).bit_length())
        while True:
            made = cls(buckets)
            if all(map(made.add, digests)):
                return made
            buckets *= 2

    @staticmethod
    def _spread(tag: int) -> int:
        return tag * 0x5BD1E995

    def _places(self, d: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(d[4:6], "little") or 1
        first = int.from_bytes(d[6:14], "little") & self.mask
        return tag, first, (first ^ self._spread(tag)) & self.mask

    def add(self, d: bytes) -> bool:
        tag, first, second = self._places(d)
        table = self.table
        for b in (first, second):
            free = np.flatnonzero(table[b] == 0)
            if len(free):
                table[b, free[0]] = tag
                return True
        b, undo = second, []
        for step in range(500):
            slot = (tag + step) % SLOTS
            undo.append((b, slot, int(table[b, slot])))
            table[b, slot], tag = tag, int(table[b, slot])
            b = (b ^ self._spread(tag)) & self.mask
            free = np.flatnonzero(table[b] == 0)
            if len(free):
                table[b, free[0]] = tag
                return True
        for b, slot, old in reversed(undo):
            table[b, slot] = old
        return False

    def remove(self, d: bytes) -> bool:
        """Take out one occurrence of a digest that was added."""
        tag, first, second = self._places(d)
        for b in (first, second):
            at = np.flatnonzero(self.table[b] == tag)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def holds(self, digests: list[bytes]) -> np.ndarray:
        """Vectorised membership: a bool per digest; True may be wrong, False never is."""
        if not digests:
            return np.zeros(0, bool)
        raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
        tag = raw[:, 4:6].copy().view(np.uint16)[:, 0]
        tag = np.where(tag == 0, np.uint16(1), tag)
        mask = np.uint64(self.mask)
        first = raw[:, 6:14].copy().view(np.uint64)[:, 0] & mask
        second = (first ^ (tag.astype(np.uint64) * np.uint64(0x5BD1E995))) & mask
        return ((self.table[first] == tag[:, None]) | (self.table[second] == tag[:, None])).any(axis=1)

    def dumps(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> CuckooFilter:
        made = cls(len(raw) // (2 * SLOTS))
        made.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return made


def line_references(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, id) once per document part: the digests of its lines of at least ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                seen = {k for k in map(line_key, (text or b"").split(b"\n")) if len(k) >= min_chars and code_points(k) >= min_chars}
                keys.extend(map(digest, seen))
                ids.extend([i] * len(seen))
                if len(keys) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "id"])
                    ids, keys = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "id"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "key binary, id long")


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


@dataclass
class LineStore:
    """State of the incremental dedup: written tables, one row per fact.

    references (key, id): exact; a key's reference count is its number of rows.
    counts (shard, key, n_docs, keeper): keys in at least ``min_docs`` documents.
    filters (shard, filter): a cuckoo filter of each shard's keys in ``counts``.
    """

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 40
    min_docs: int = 5

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> LineStore:
        refs = written(line_references(docs, id_col, text_col, min_chars).groupBy("key", "id").agg(F.lit(1).alias("held")).select("key", "id"), "line-references")
        return cls._of(refs, min_chars, min_docs)

    @classmethod
    def _of(cls, refs: DataFrame, min_chars: int, min_docs: int) -> LineStore:
        many = written(refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs), "line-counts")
        shards = max(1, -(-many.count() // SHARD_KEYS))
        counts = many.select(_shard(shards).alias("shard"), "key", "n_docs", "keeper")

        def fill(group: pa.Table) -> pa.Table:
            keys = group.column("key").to_pylist()
            return pa.table({"shard": group.column("shard").slice(0, 1), "filter": pa.array([CuckooFilter.of(keys).dumps()], pa.binary())})

        filters = written(counts.select("shard", "key").groupBy("shard").applyInArrow(fill, "shard int, filter binary"), "line-filters")
        return cls(refs, counts, filters, shards, min_chars, min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """The state with more documents; those already held add nothing."""
        new = line_references(docs, id_col, text_col, self.min_chars)
        return self._of(written(self.references.union(new).groupBy("key", "id").agg(F.lit(1).alias("held")).select("key", "id"), "line-references"), self.min_chars, self.min_docs)

    def delete(self, ids: DataFrame) -> LineStore:
        """The state without the documents of ``ids`` (one column): as if they had never been inserted.

        Keys that fall below ``min_docs`` are taken out of their shard's filter
        in place; shards without such keys keep theirs.
        """
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
        refs = written(self.references.join(gone, "id", "left_anti").select("key", "id"), "line-references")
        counts = written(refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= self.min_docs).select(_shard(self.shards).alias("shard"), "key", "n_docs", "keeper"), "line-counts")
        lost = self.counts.join(counts.select("key"), "key", "left_anti").select("shard", "key")

        def take(left: pa.Table, right: pa.Table) -> pa.Table:
            held = CuckooFilter.loads(left.column("filter")[0].as_py())
            for key in right.column("key").to_pylist():
                held.remove(key)
            return pa.table({"shard": left.column("shard").slice(0, 1), "filter": pa.array([held.dumps()], pa.binary())})

        filters = written(self.filters.groupBy("shard").cogroup(lost.groupBy("shard")).applyInArrow(take, "shard int, filter binary"), "line-filters")
        return LineStore(refs, counts, filters, self.shards, self.min_chars, self.min_docs)

    def suspects(self, refs: DataFrame) -> DataFrame:
        """The (key, id) rows whose key its shard's filter holds; dealt out by shard and a salt, so that no key makes a large group."""
        salts = max(1, -(-refs.count() // (GROUP_LINES * self.shards)))
        left = refs.select(_shard(self.shards).alias("shard"), F.pmod(F.xxhash64("key", "id"), F.lit(salts)).cast("int").alias("salt"), "key", "id")
        right = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "filter")

        def probe(lines: pa.Table, filters: pa.Table) -> pa.Table:
            lines = lines.select(["key", "id"])
            if not filters.num_rows or not lines.num_rows:
                return lines.slice(0, 0)
            held = CuckooFilter.loads(filters.column("filter")[0].as_py())
            return lines.filter(pa.array(held.holds(lines.column("key").to_pylist())))

        return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(probe, "key binary, id long")

    def dropped(self) -> DataFrame:
        """(id, keys): the digests of the lines that each document loses. Suspects are held against the exact counts."""
        hot = self.counts.select("key", "keeper")
        lost = self.suspects(self.references).join(hot, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with the lines taken out of the text; adds __sf_lines, __sf_dropped (long) before all columns.

        A null or empty text is one empty line and becomes an empty text.
        Rows that share an id are one document. Rows without an id hold lines
        like one document whose id is smaller than any other.
        """
        lost = self.dropped().withColumnRenamed("id", "__sf_id").withColumnRenamed("keys", "__sf_keys")
        joined = docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col("__sf_id")), "left").drop("__sf_id")
        names, kinds = docs.columns, docs.schema
        at = names.index(text_col)
        least = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, totals, drops = [], [], []
                for text, keys in zip(as_bytes(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                    lines = (text or b"").split(b"\n")
                    totals.append(len(lines))
                    if keys:
                        gone = set(keys)
                        lines = [x for x in lines if len(x) < least or digest(line_key(x)) not in gone]
                    drops.append(totals[-1] - len(lines))
                    texts.append(b"\n".join(lines))
                columns = [batch.column(i) for i in range(len(names))]
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int64()), pa.array(drops, pa.int64()), *columns], names=["__sf_lines", "__sf_dropped", *names])

        schema = "__sf_lines long, __sf_dropped long, " + ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in kinds)
        return joined.mapInArrow(run, schema)
