"""Compressed pilot sequences. Each row of an encoded model is one chunk of a sequence, packed by one task."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bucketers import DENSE_BUCKETS
from ..plans.config import MphConfig

if TYPE_CHECKING:
    from .build import MphModel

BLOCK = 256  #: values that share a width in PC
CHUNK = 1 << 16  #: values of a sequence that are packed together
RANGE = 1 << 12  #: pilots of a partition that stand in one row of what lookups read
SIDE = 128  #: neighbouring dense partitions whose pilots are turned from bucket by bucket to partition by partition together
CHUNKS = "seq long, chunk long, values array<long>"
DECODED = f"{CHUNKS}, encoder string"
PIECES = "seq long, chunk long, at long, values array<long>"
TURNED = "which long, block long, bucket long, at long, values array<long>"
ENCODED = "seq long, chunk long, n long, encoder string, data binary, bits long"


def width_of(top: int) -> int:
    return max(1, int(top).bit_length())


def pack(values: np.ndarray, width: int) -> bytes:
    """Fixed-width values, least significant bit first."""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _unary(high: np.ndarray) -> bytes:
    """Non-decreasing numbers as one bit each behind that many zeros in all."""
    at = high + np.arange(len(high))
    bits = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _from_unary(data: bytes, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))[:n] - np.arange(n)


def _c(v):
    w = width_of(v.max(initial=0))
    return struct.pack("<B", w) + pack(v, w), len(v) * w + 8


def _uc(data, n):
    return unpack(data[1:], data[0], n)


def _pc(v):
    out, bits = [], 0
    for at in range(0, len(v), BLOCK):
        block = v[at : at + BLOCK]
        w = width_of(block.max())
        out.append(struct.pack("<B", w) + pack(block, w))
        bits += len(block) * w + 8
    return b"".join(out), bits


def _upc(data, n):
    out, at = [], 0
    while n > 0:
        k, w = min(BLOCK, n), data[at]
        size = -(-k * w // 8)
        out.append(unpack(data[at + 1 : at + 1 + size], w, k))
        at, n = at + 1 + size, n - k
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _d(v):
    """Distinct values, frequent first, and the place of each value among them."""
    found, at, count = np.unique(v, return_inverse=True, return_counts=True)
    order = np.lexsort((found, -count))
    code = np.empty(len(found), np.int64)
    code[order] = np.arange(len(found))
    w, wide = width_of(max(0, len(found) - 1)), width_of(found.max(initial=0))
    return struct.pack("<IBB", len(found), w, wide) + pack(found[order], wide) + pack(code[at], w), len(v) * w + len(found) * wide + 48


def _ud(data, n):
    k, w, wide = struct.unpack_from("<IBB", data)
    size = -(-k * wide // 8)
    return unpack(data[6 : 6 + size], wide, k)[unpack(data[6 + size :], w, n)] if n else np.zeros(0, np.int64)


def _split(v, low):
    """Low bits packed, high parts in unary; values must not fall."""
    lows = pack(v & ((1 << low) - 1), low) if low else b""
    high = _unary(v >> low)
    bits = len(v) * low + (int(v[-1] >> low) + len(v) if len(v) else 0)
    return struct.pack("<B", low) + lows + high, bits + 8


def _join(data, n):
    low = data[0]
    size = -(-n * low // 8)
    lows = unpack(data[1 : 1 + size], low, n) if low and n else np.zeros(n, np.int64)
    return (_from_unary(data[1 + size :], n) << low) | lows


def _ef(v):
    sums = np.cumsum(v)
    low = max(0, int(sums[-1] // len(v)).bit_length() - 1) if len(v) else 0
    return _split(sums, low)


def _uef(data, n):
    return np.diff(_join(data, n), prepend=0)


def _r(v):
    """Golomb-Rice codes: the unary quotients of all values make one non-falling sequence of sums."""
    mean = float(v.mean()) if len(v) else 0.0
    low = max(0, int(np.log2(mean * 0.6931 + 1e-9))) if mean > 1 else 0
    quotient = np.cumsum(v >> low)
    lows = pack(v & ((1 << low) - 1), low) if low else b""
    return struct.pack("<B", low) + lows + _unary(quotient), len(v) * (low + 1) + (int(quotient[-1]) if len(v) else 0) + 8


def _ur(data, n):
    low = data[0]
    size = -(-n * low // 8)
    lows = unpack(data[1 : 1 + size], low, n) if low and n else np.zeros(n, np.int64)
    return (np.diff(_from_unary(data[1 + size :], n), prepend=0) << low) | lows


CODECS = {"C": (_c, _uc), "PC": (_pc, _upc), "D": (_d, _ud), "EF": (_ef, _uef), "R": (_r, _ur)}


def encode_values(name: str, values: np.ndarray) -> tuple[bytes, int]:
    """(data, bits). F-B splits the values: the first 30 % by F, the rest by B."""
    values = np.asarray(values, np.int64)
    if "-" in name:
        front, back = name.split("-")
        cut = int(np.float32(len(values)) * DENSE_BUCKETS)
        (a, x), (b, y) = encode_values(front, values[:cut]), encode_values(back, values[cut:])
        return struct.pack("<II", cut, len(a)) + a + b, x + y + 64
    return CODECS[name][0](values)


def decode_values(name: str, data: bytes, n: int) -> np.ndarray:
    if "-" in name:
        front, back = name.split("-")
        cut, size = struct.unpack_from("<II", data)
        return np.concatenate([decode_values(front, data[8 : 8 + size], cut), decode_values(back, data[8 + size :], n - cut)])
    return CODECS[name][1](data, n)


def sequences(model: MphModel, encoder: str) -> DataFrame:
    """(seq, i, value): plain: a sequence per partition; dense: one, bucket by bucket; -int: a sequence per bucket over the partitions."""
    rows = chunks(model, encoder).select("seq", "chunk", F.posexplode("values").alias("k", "value"))
    return rows.select("seq", (F.col("chunk") * CHUNK + F.col("k")).alias("i"), "value")


def _layout(encoder: str) -> str:
    """How the encoder cuts the pilots of a dense function into sequences."""
    return "C-int" if encoder.endswith("-int") else "C"


def chunks(model: MphModel, encoder: str) -> DataFrame:
    """(seq, chunk, values): the sequences of an encoder, CHUNK decoded values a row; made once for each way of cutting and kept."""
    layout, config = _layout(encoder), model.config
    made = model._made
    if layout not in made:
        values = _decoded(model.encoded).select("seq", "chunk", "values")
        if _layout(config.encoder) != layout:  # both count the same values bucket by bucket, only cut elsewhere
            partitions, whole = model.num_partitions, _layout(config.encoder) == "C"

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for seq, chunk, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                        first = chunk * CHUNK + (0 if whole else seq * partitions)
                        yield _piece_batch(_pieces(first, values.values.to_numpy(), layout, partitions))

            values = _assembled(values.mapInArrow(run, PIECES))
        made[layout] = values.persist(StorageLevel.MEMORY_AND_DISK)
    return made[layout]


def _pieces(first: int, values: np.ndarray, layout: str, partitions: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(seq, chunk, at, values) of a run of dense pilots; bucket * partitions + pid is counted from ``first`` on."""
    done = 0
    while done < len(values):
        seq, i = divmod(first + done, partitions) if layout == "C-int" else (0, first + done)
        room = CHUNK - i % CHUNK if layout == "C" else min(CHUNK - i % CHUNK, partitions - i)
        part = values[done : done + room]
        yield seq, i // CHUNK, i % CHUNK, part
        done += len(part)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


def _piece_batch(pieces) -> pa.RecordBatch:
    seq, chunk, at, values = zip(*pieces, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(chunk, pa.int64()), pa.array(at, pa.int64()), _lists(list(values))], names=["seq", "chunk", "at", "values"])


def _assembled(pieces: DataFrame) -> DataFrame:
    """(seq, chunk, values) from the pieces of chunks; a partition without keys has zeros."""

    def run(group: pa.Table) -> pa.Table:
        parts = [x.values.to_numpy() for x in group.column("values")]
        at = group.column("at").to_pylist()
        full = np.zeros(max(a + len(x) for a, x in zip(at, parts, strict=True)), np.int64)
        for a, x in zip(at, parts, strict=True):
            full[a : a + len(x)] = x
        return pa.table({"seq": group.column("seq").slice(0, 1), "chunk": group.column("chunk").slice(0, 1), "values": _lists([full])})

    return pieces.groupBy("seq", "chunk").applyInArrow(run, CHUNKS)


def _packed(values: DataFrame, *names: str) -> DataFrame:
    """Chunks (seq, chunk, values) packed where they are, by each of the encoders in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x.values.to_numpy() for x in batch.column(2)]
            for name in names:
                done = [encode_values(name.removesuffix("-int"), x) for x in lists]
                columns = pa.array([len(x) for x in lists], pa.int64()), pa.array([name] * len(lists), pa.string()), pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["seq", "chunk", "n", "encoder", "data", "bits"])

    return values.mapInArrow(run, ENCODED)


def _decoded(encoded: DataFrame) -> DataFrame:
    """(seq, chunk, values, encoder) of encoded pilots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [decode_values(name.removesuffix("-int"), data, n) for n, name, data in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(values), batch.column(3)], names=["seq", "chunk", "values", "encoder"])

    return encoded.select("seq", "chunk", "n", "encoder", "data").mapInArrow(run, DECODED)


def encode(model: MphModel, encoder: str | None = None) -> DataFrame:
    """The encoded pilots: (seq, chunk, n, encoder, data, bits)."""
    name = encoder or model.config.encoder
    model.config.but(encoder=name)  # refuses encoders that the mode does not have
    return model.encoded if name == model.config.encoder else _packed(chunks(model, name), name)


def encode_each(model: MphModel, names: Iterable[str]) -> DataFrame:
    """The pilots encoded by some encoders, one pass over the chunks for each way of cutting: (seq, chunk, n, encoder, data, bits)."""
    names = list(dict.fromkeys(names))
    for name in names:
        model.config.but(encoder=name)  # refuses encoders that the mode does not have
    own = [n for n in names if n == model.config.encoder]  # as the model keeps it
    packed = [model.encoded for _ in own] + [_packed(chunks(model, x), *rest) for x in ("C", "C-int") if (rest := [n for n in names if _layout(n) == x and n not in own])]
    return reduce(DataFrame.union, packed)


def with_encoder(model: MphModel, encoder: str) -> MphModel:
    """The same function, its pilots packed by another encoder."""
    kept = ({"targets": model.targets} if model.beside else {"redirects": model.redirects}) if model.config.minimal else {}
    return replace(model, config=model.config.but(encoder=encoder), encoded=encode(model, encoder), _made=kept)


def encoded(found: DataFrame, config: MphConfig, partitions: int) -> DataFrame:
    """The pilots (pid, pilots array) as ``config.encoder`` packs them. Sequences of single partitions are packed where they are; dense ones travel as runs of neighbouring partitions."""
    name = config.encoder
    if config.mode == "dense":
        layout = _layout(name)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pid = batch.column(0).to_numpy()
                if not len(pid):
                    continue
                order = np.argsort(pid)
                table = np.array([x.values.to_numpy() for x in batch.column(1)])[order]
                pid = pid[order]
                runs = np.split(np.arange(len(pid)), np.flatnonzero(np.diff(pid) != 1) + 1)
                yield _piece_batch(piece for run in runs for bucket, line in enumerate(np.ascontiguousarray(table[run].T)) for piece in _pieces(bucket * partitions + int(pid[run[0]]), line, layout, partitions))

        return _packed(_assembled(found.mapInArrow(cut, PIECES)), name)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, pilots in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = pilots.values.to_numpy()
                parts = [values[at : at + CHUNK] for at in range(0, len(values), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), _lists(parts)], names=["seq", "chunk", "values"])

    return _packed(found.mapInArrow(whole, CHUNKS), name)


def pilot_arrays(encoded: DataFrame, config: MphConfig, partitions: int, names: list[str]) -> DataFrame:
    """(pid, part, pilots0, pilots1, ...): the pilots decoded from each of some encoders, RANGE of a partition in a row."""
    values, range_ = _decoded(encoded), RANGE
    columns = [f"pilots{k}" for k in range(len(names))]
    if config.mode != "dense":

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for seq, chunk, pilots, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                    pilots = pilots.values.to_numpy()
                    parts = [pilots[at : at + range_] for at in range(0, len(pilots), range_)]
                    first = chunk * (CHUNK // range_)
                    yield pa.RecordBatch.from_arrays([pa.array([seq] * len(parts), pa.int64()), pa.array(range(first, first + len(parts)), pa.int64()), _lists(parts), pa.array([name] * len(parts), pa.string())], names=["pid", "part", "pilots", "encoder"])

        rows = values.mapInArrow(run, "pid long, part long, pilots array<long>, encoder string")
        if len(names) == 1:
            return rows.select("pid", "part", F.col("pilots").alias("pilots0"))
        return rows.groupBy("pid", "part").agg(*[F.first(F.when(F.col("encoder") == name, F.col("pilots")), ignorenulls=True).alias(c) for name, c in zip(names, columns, strict=True)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most SIDE neighbouring partitions: (encoder, block of partitions, bucket, at, values)."""
        for batch in batches:
            out = []
            for seq, chunk, line, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                line, first, done = line.values.to_numpy(), chunk * CHUNK + (0 if _layout(name) == "C" else seq * partitions), 0
                which = names.index(name)
                while done < len(line):
                    bucket, pid = divmod(first + done, partitions)
                    part = line[done : done + min(SIDE - pid % SIDE, partitions - pid)]
                    out.append((which, pid // SIDE, bucket, pid % SIDE, part))
                    done += len(part)
            if out:
                *numbers, lines = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in numbers], _lists(list(lines))], names=["which", "block", "bucket", "at", "values"])

    def turn(group: pa.Table) -> pa.Table:
        which, bucket, at = (group.column(c).to_numpy() for c in ("which", "bucket", "at"))
        block, lines = group.column("block")[0].as_py(), group.column("values").combine_chunks()
        flat, ends = lines.values.to_numpy(), lines.offsets.to_numpy()
        full = np.zeros((len(names), min(SIDE, partitions - block * SIDE), int(bucket.max()) + 1), np.int64)
        for w, b, a, x, y in zip(which.tolist(), bucket.tolist(), at.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            full[w, a : a + y - x, b] = flat[x:y]
        parts = range(-(-full.shape[2] // range_))
        pid = np.repeat(block * SIDE + np.arange(full.shape[1]), len(parts))
        lists = [_lists([line[k * range_ : (k + 1) * range_] for line in one for k in parts]) for one in full]
        return pa.table({"pid": pa.array(pid, pa.int64()), "part": pa.array(list(parts) * full.shape[1], pa.int64()), **dict(zip(columns, lists, strict=True))})

    return values.mapInArrow(cut, TURNED).groupBy("block").applyInArrow(turn, "pid long, part long, " + ", ".join(f"{c} array<long>" for c in columns))


def decode(encoded: DataFrame) -> DataFrame:
    """(seq, i, value) of encoded pilots."""
    rows = _decoded(encoded).select("seq", "chunk", F.posexplode("values").alias("k", "value"))
    return rows.select("seq", (F.col("chunk") * CHUNK + F.col("k")).alias("i"), "value")


def lost(model: MphModel, names: Iterable[str]) -> DataFrame:
    """One row, lost: values of the sequences of some encoders that are not what comes back from their encoding, and values that come back instead.

    Whole chunks meet, once for all encoders; an encoding that is missing loses all its values.
    """
    names = tuple(names)
    layouts = sorted({_layout(n) for n in names})
    kept = reduce(DataFrame.union, [chunks(model, x).select(F.lit(x).alias("layout"), "*") for x in layouts])
    cut = F.when(F.col("encoder").endswith("-int"), "C-int").otherwise("C").alias("layout")
    coded = encode_each(model, names).select(cut, "seq", "chunk", F.struct("encoder", "n", "data").alias("one"))
    coded = coded.groupBy("layout", "seq", "chunk").agg(F.collect_list("one").alias("all"))  # one of each encoder
    met = kept.join(coded, ["layout", "seq", "chunk"], "full_outer").select("layout", "values", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = 0
            for layout, values, coded in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                values = values.values.to_numpy() if values.is_valid else np.zeros(0, np.int64)
                back = {n: [] for n in names if _layout(n) == layout}
                for x in coded or ():
                    back.setdefault(x["encoder"], []).append(decode_values(x["encoder"].removesuffix("-int"), x["data"], x["n"]))
                for found in back.values():
                    count += sum(len(x) for x in found[1:])
                    first = found[0] if found else np.zeros(0, np.int64)
                    both = min(len(first), len(values))
                    count += 2 * int((first[:both] != values[:both]).sum()) + len(first) + len(values) - 2 * both
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["lost"])

    return met.mapInArrow(run, "lost long").agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"))


def elias_fano_bits(n: int, top: int) -> int:
    return n * (2 + max(0, (top // n).bit_length())) if n else 0


def bits(model: MphModel, encoder: str | None = None) -> DataFrame:
    """One row: pilot_bits, mapper_bits, total_bits, and the same per key."""
    spare = model.table_size - model.num_keys if model.config.minimal else 0
    mapper = elias_fano_bits(spare, model.num_keys) + (0 if model.config.mode == "dense" else 128 * model.num_partitions)
    row = encode(model, encoder).agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("pilot_bits")).withColumn("mapper_bits", F.lit(mapper).cast("long"))
    row = row.withColumn("total_bits", F.col("pilot_bits") + F.col("mapper_bits"))
    n = max(1, model.num_keys)
    return row.select("*", *[(F.col(f"{c}_bits") / n).alias(f"{c}_bits_per_key") for c in ("pilot", "mapper", "total")])


def block_widths(values: DataFrame, index: str, value: str) -> DataFrame:
    """PC as SQL: (block, width, offset): the width of each block of 256 values and where its bits begin."""
    from .ranks import prefix_sums

    top = values.groupBy(F.floor(F.col(index) / BLOCK).cast("long").alias("block")).agg(F.max(value).alias("top"), F.count("*").alias("n"))
    width = F.when(F.col("top") == 0, 1).otherwise(F.ceil(F.log2(F.col("top") + 1))).cast("long")
    sized = top.select("block", width.alias("width"), (width * F.col("n")).alias("size"))
    return prefix_sums(sized, "block", {"offset": "size"}).select("block", "width", F.col("offset").cast("long").alias("offset"))


def dictionary_codes(values: DataFrame, value: str) -> DataFrame:
    """D as SQL: (value, n, code), frequent values first. Ranges of (count, value) are ranked each, so the many values of one count make no large group."""
    from .ranks import ranked_in_ranges

    counts = values.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return ranked_in_ranges(counts.withColumn("fall", -F.col("n")), ["fall", "value"], "code").select("value", "n", "code")


def entropy(values: DataFrame, value: str) -> DataFrame:
    """One row: the empirical entropy of a column in bits."""
    counts = values.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total)).agg(F.sum(-share * F.log2(share)).alias("entropy"))  # total is one row
