"""Unsigned 64-bit arithmetic: as column expressions on signed longs, and on numpy uint64.

The expressions split values into 32-bit limbs so that no intermediate
overflows, whatever ``spark.sql.ansi.enabled`` says.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the mixing function.
MIX = 0x517CC1B727220A95
M32 = 0xFFFFFFFF
SIGN = -(1 << 63)


def signed(value: int) -> int:
    """The signed long with the bits of an unsigned 64-bit value."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def let(x: Column, body) -> Column:
    """body(x) with x worked out once: long expressions would otherwise repeat their inputs at each use."""
    return F.transform(F.array(x), body)[0]


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(M32))


def high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def mix(x: Column) -> Column:
    """x * MIX modulo 2^64."""
    upper, lower = MIX >> 32, MIX & M32
    product = low(x) * F.lit(lower)
    top = low(low(high(x) * F.lit(lower)) + low(low(x) * F.lit(upper)) + high(product))
    return F.shiftleft(top, 32).bitwiseOR(low(product))


def remap(x: Column, n: Column | int) -> Column:
    """floor(x * n / 2^64) for unsigned x and n below 2^31: x's share of n slots."""
    n = F.lit(n) if isinstance(n, int) else n
    return high(high(x) * n + high(low(x) * n))


def unsigned_less(x: Column, bound: int) -> Column:
    return x.bitwiseXOR(F.lit(SIGN)) < F.lit(signed(bound) ^ SIGN)


def _wide(a: Column, b: Column) -> tuple[Column, Column]:
    """High and low 32 bits of the product of two 32-bit values."""
    upper = a * F.shiftrightunsigned(b, 16)
    lower = a * b.bitwiseAND(F.lit(0xFFFF))
    sums = upper + F.shiftrightunsigned(lower, 16)
    return F.shiftrightunsigned(sums, 16), F.shiftleft(sums.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(lower.bitwiseAND(F.lit(0xFFFF)))


def mul_high(x: Column, y: Column) -> Column:
    """High 64 bits of the unsigned product."""
    (hh, hl), (ah, al), (bh, bl), (lh, _) = _wide(high(x), high(y)), _wide(high(x), low(y)), _wide(low(x), high(y)), _wide(low(x), low(y))
    middle = lh + al + bl
    lower = hl + ah + bh + high(middle)
    return F.shiftleft(low(hh + high(lower)), 32).bitwiseOR(low(lower))


def xorshift(x: Column) -> Column:
    """One step of the xorshift generator with shifts 13, 7, 17."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def xorshift_below(x: Column, n: Column | int) -> tuple[Column, Column]:
    """(next state, a number below n) of the generator."""
    state = xorshift(x)
    return state, remap(state, n)


def np_mix(x: np.ndarray) -> np.ndarray:
    return x * np.uint64(MIX)


def np_remap(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    n, s = np.asarray(n, np.uint64), np.uint64(32)
    return ((x >> s) * n + (((x & np.uint64(M32)) * n) >> s)) >> s


def np_mul_high(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    s, m = np.uint64(32), np.uint64(M32)
    xh, xl, yh, yl = x >> s, x & m, y >> s, y & m
    middle = ((xl * yl) >> s) + ((xh * yl) & m) + ((xl * yh) & m)
    return xh * yh + ((xh * yl) >> s) + ((xl * yh) >> s) + (middle >> s)
