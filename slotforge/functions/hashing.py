"""Two independent 64-bit hashes of a key, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arith import signed

FAMILIES = ("xx64x2", "md5", "xx64", "xxh128")
#: Keys that one 64-bit hash may tell apart: beyond it a collision is likely.
MOST_64 = 1 << 30
SECOND_SEED = 0x9E3779B97F4A7C15


def canonical(df: DataFrame, columns: list[str]) -> list[Column]:
    """Key columns as strings, binaries or longs: integers of any width hash alike; other types hash as strings."""
    out = []
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            out.append(F.col(name).cast("long"))
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            out.append(F.col(name))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            out.append(F.to_json(F.col(name)))
        else:
            out.append(F.col(name).cast("string"))
    return out


def _hex_word(digest: Column, start: int) -> Column:
    """16 hex digits as the signed long with their bits."""
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def hash_columns(df: DataFrame, columns: list[str], seed: int, family: str) -> tuple[Column, Column]:
    """(first, second). xx64x2: two seeded XXH64; md5: the two words of the digest; xx64: one XXH64 used twice; xxh128: both words of XXH128."""
    keys = canonical(df, columns)
    if family == "xx64x2":
        return F.xxhash64(F.lit(signed(seed)), *keys), F.xxhash64(F.lit(signed(seed ^ SECOND_SEED)), *keys)
    if family == "xx64":
        one = F.xxhash64(F.lit(signed(seed)), *keys)
        return one, one
    if family == "md5":
        text = keys[0].cast("string") if len(keys) == 1 else F.concat(*[_framed(k) for k in keys])
        digest = F.md5(F.concat(F.lit(f"{seed}:"), text) if seed else text)
        return _hex_word(digest, 1), _hex_word(digest, 17)
    if family == "xxh128":
        if len(keys) != 1:
            raise ValueError("xxh128 takes one key column")
        kind = df.schema[columns[0]].dataType
        blank = F.lit(0).cast("long") if isinstance(kind, T.IntegralType) else F.lit(b"" if isinstance(kind, T.BinaryType) else "")
        words = _xxh128(seed)(F.coalesce(keys[0], blank))  # a null among integers would make floats of them
        known = keys[0].isNotNull()
        return F.when(known, words["high"]), F.when(known, words["low"])
    raise ValueError(f"hash family {family!r} is none of {FAMILIES}")


def _framed(key: Column) -> Column:
    """A key with its length before it, so that no two lists of keys look alike; null has a mark of its own."""
    text = key.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _xxh128(seed: int):
    @F.pandas_udf("high long, low long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for keys in parts:
            raw = [k.to_bytes(8, "little", signed=True) if isinstance(k, int) else k for k in keys.tolist()]
            found = [xxhash.xxh128_intdigest(r, seed) for r in raw]
            yield pd.DataFrame({"high": [signed(x >> 64) for x in found], "low": [signed(x) for x in found]})

    return run


def mixed(first: Column, second: Column, family: str) -> Column:
    """The word that deals keys to partitions."""
    from .arith import mix

    return mix(first) if family == "xx64" else first.bitwiseXOR(second)


def guard_collisions(family: str, n: int) -> None:
    if family == "xx64" and n > MOST_64:
        raise ValueError(f"{n} keys are too many for one 64-bit hash: take a family of two words")
