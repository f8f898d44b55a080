"""32-bit Murmur hashes of 32-bit keys with any seed, as column arithmetic.

The built-in ``hash`` has one seed only. BIGINT arithmetic that cannot overflow
keeps the expression in generated code and valid under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1
# The constants of MurmurHash3 (x86, 32 bits).
_C1, _C2, _ADD, _F1, _F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _times(a: Column, c: int) -> Column:
    """a * c modulo 2**32: the halves of c are multiplied apart."""
    low, high = c & 0xFFFF, c >> 16
    return (a * F.lit(low) + F.shiftleft((a * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _turned(a: Column, by: int) -> Column:
    return F.shiftleft(a, by).bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftrightunsigned(a, 32 - by))


def _folded(a: Column, by: int) -> Column:
    return a.bitwiseXOR(F.shiftrightunsigned(a, by))


def with_murmur3(df: DataFrame, key: Column, seed: Column, name: str) -> DataFrame:
    """``df`` with the unsigned 32-bit hash, as BIGINT, of a 4-byte key. A null key
    gives null.

    Each step is a column of its own: steps name what they work on twice, and as
    one expression the ten of them would grow to a thousand copies of the key.
    """
    k, h = f"_{name}_k", f"_{name}_h"
    for step in (
        lambda x: _times(x, _C1),
        lambda x: _turned(x, 15),
        lambda x: _times(x, _C2),
    ):
        df = df.withColumn(k, step(F.col(k) if k in df.columns else key.cast("long").bitwiseAND(F.lit(_MASK))))
    df = df.withColumn(h, seed.cast("long").bitwiseXOR(F.col(k)))
    for step in (
        lambda x: _turned(x, 13),
        lambda x: (x * F.lit(5) + F.lit(_ADD)).bitwiseAND(F.lit(_MASK)).bitwiseXOR(F.lit(4).cast("long")),
        lambda x: _folded(x, 16),
        lambda x: _times(x, _F1),
        lambda x: _folded(x, 13),
        lambda x: _times(x, _F2),
        lambda x: _folded(x, 16),
    ):
        df = df.withColumn(h, step(F.col(h)))
    return df.withColumn(name, F.col(h)).drop(k, h)
