"""Seeded draws as column arithmetic: the same numbers in any order, on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an odd multiplier of 27 bits, so that its product with 32 bits fits a long.
MULTIPLIER = 0x45D9F3B
MASK = 0xFFFFFFFF


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def mix32(x: Column) -> Column:
    """A 32-bit mixture of the low 32 bits of a long: shifts and multiplications by turns."""
    x = x.bitwiseAND(F.lit(MASK))
    for _ in range(2):
        x = _let(x, lambda v: (v.bitwiseXOR(F.shiftrightunsigned(v, 16)) * MULTIPLIER).bitwiseAND(F.lit(MASK)))
    return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 16)))


def draw(seed: int, *keys: Column) -> Column:
    """A draw from 0 to 2^32 - 1 for each combination of keys (longs)."""
    x = F.lit(seed).cast("long")
    for k in keys:
        x = mix32(x.bitwiseXOR(k.cast("long")) + F.lit(0x9E3779B9))
    return x


def below(seed: int, n: Column | int, *keys: Column) -> Column:
    """A draw from 0 to n - 1; n is below 2^31."""
    return F.shiftrightunsigned(draw(seed, *keys) * (F.lit(n) if isinstance(n, int) else n), 32)
