"""Separator scan: documents and their token counts from flat token files without an index."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  #: rank file; its ids stay below SEPARATOR
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"  #: fixed value: the public pattern that belongs to the ranks
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 18  #: tokens of a block of a flat file
FILE_TOKENS = 1 << 24  #: tokens of a flat file
BLOCKS = "file string, block long, data binary, ids array<long>"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, made once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def flat_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Flat token files as rows of blocks (file, block, data, ids): token ids as little-endian uint16, a separator after each document.

    Blocks cut documents wherever they fill up. ``ids`` lists the documents
    whose separator is in the block: the writer's manifest, which the scan
    does not look at. Null and empty texts are a separator alone.
    """
    if not 0 <= separator < 1 << 16:
        raise ValueError("token ids are 16 bits wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, file, block = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ends: list[tuple[int, int | None]] = []  # place of the separator among what is held, document
        size = 0
        made = encoder(tokenizer)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, ends, size, file, block
            flat = np.concatenate(held) if held else np.zeros(0, np.uint16)
            while len(flat) >= block_tokens or last and len(flat):
                here = [i for at, i in ends if at < block_tokens]
                row = [f"{task:06d}-{file:06d}"], [block], [flat[:block_tokens].astype("<u2").tobytes()], [here]
                yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.int64()), pa.array(row[2], pa.binary()), pa.array(row[3], pa.list_(pa.int64()))], names=["file", "block", "data", "ids"])
                flat, ends = flat[block_tokens:], [(at - block_tokens, i) for at, i in ends if at >= block_tokens]
                block += 1
            held, size = [flat], len(flat)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                coded = made.encode_ordinary((text or b"").decode("utf-8", "replace"))
                held.append(np.array([*coded, separator], np.uint16))
                size += len(coded) + 1
                ends.append((size - 1, i))
                if size + block * block_tokens >= file_tokens:  # a file ends with a document
                    yield from cut(True)
                    file, block = file + 1, 0
                elif size >= block_tokens:
                    yield from cut(False)
        yield from cut(True)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, BLOCKS)


def read_flat(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw flat token files (uint16, little-endian) under a path or glob; an odd last byte is an error.

    Spark's binary reader gives a file to one task, 2 GB at most: larger
    corpora come as several files, as ``flat_blocks`` makes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(content) % 2:
                    raise ValueError(f"{name}: {len(content)} bytes are not whole tokens")
                for block, at in enumerate(range(0, len(content), 2 * block_tokens)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([content[at : at + 2 * block_tokens]], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["file", "block", "data", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed, block): the documents of flat files, n_tokens without the separator.

    Each block is searched as one vector; what it passes on is a summary:
    its length, its separators and where the first and last of them are. A
    prefix scan over a file's blocks gives each block the ordinal of its
    first document and where that document began, blocks earlier if need be
    (the last separator before this block), so a document of any number of
    blocks is one row. Tokens after a file's last separator are a document
    that is not closed. A file without tokens has no documents; two
    separators in a row hold an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = [], []
            for data in batch.column(2).to_pylist():
                flat = np.frombuffer(data or b"", "<u2")
                sizes.append(len(flat))
                places.append(np.flatnonzero(flat == separator).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64())), batch.column(3)], names=["file", "block", "size", "places", "ids"])

    found = blocks.select("file", "block", "data", "ids").mapInArrow(run, "file string, block long, size long, places array<long>, ids array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("size").over(before), F.lit(0))
    placed = found.withColumn("base", base).withColumn("ordinal", F.coalesce(F.sum(F.size("places")).over(before), F.lit(0)))
    last = F.max(F.when(F.size("places") > 0, F.col("base") + F.element_at("places", -1) + 1)).over(before)
    placed = placed.withColumn("open", F.coalesce(last, F.lit(0)))
    final = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    placed = placed.withColumn("final", final)
    stops = F.transform("places", lambda p: F.col("base") + p)
    tail = F.coalesce(F.element_at(stops, -1) + 1, F.col("open"))
    placed = placed.withColumn("stops", F.coalesce(stops, F.array().cast("array<long>"))).withColumn("tail", F.when(F.size("places") > 0, tail).otherwise(F.col("open")))
    closed = placed.select("file", "block", "ordinal", "open", "stops", "ids", F.posexplode("stops").alias("k", "stop")).select(
        "file", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.when(F.col("k") == 0, F.col("open")).otherwise(F.try_element_at("stops", F.col("k")) + 1).alias("start"),
        F.col("stop"), F.lit(True).alias("closed"), "block", F.try_element_at("ids", F.col("k") + 1).alias("id"))
    end = F.col("base") + F.col("size")
    rest = placed.where(F.col("final") & (F.col("tail") < end)).select("file", (F.col("ordinal") + F.size("places")).alias("ordinal"), F.col("tail").alias("start"), end.alias("stop"), F.lit(False).alias("closed"), "block", F.lit(None).cast("long").alias("id"))
    return closed.union(rest).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed", "block", "id")
