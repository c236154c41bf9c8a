"""Small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648


def lcg(c: Column, seed: int = 0) -> Column:
    """A draw from 0 to 2**31 - 1 for a small whole number: the same in every engine with 64-bit arithmetic."""
    once = (F.lit(LCG_A).cast("long") * F.pmod(c.cast("long") + F.lit(seed).cast("long"), F.lit(LCG_M).cast("long")) + F.lit(LCG_C).cast("long")) % F.lit(LCG_M).cast("long")
    return (F.lit(LCG_A).cast("long") * once + F.lit(LCG_C).cast("long")) % F.lit(LCG_M).cast("long")


def lcg_sql(c: str, seed: int = 0) -> str:
    once = f"(({LCG_A} * (({c} + {seed}) % {LCG_M}) + {LCG_C}) % {LCG_M})"
    return f"(({LCG_A} * {once} + {LCG_C}) % {LCG_M})"


MASK, GOLDEN, MIX_1, MIX_2 = 4294967295, 2654435769, 739982445, 695872825


def let(x: Column, f) -> Column:
    """f(x), with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def hash32(x: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 to one of these that looks unrelated: the same in every engine with 64-bit arithmetic."""
    x = let(x, lambda v: (v.bitwiseXOR(F.shiftright(v, 16)) * F.lit(MIX_1).cast("long")).bitwiseAND(F.lit(MASK)))
    x = let(x, lambda v: (v.bitwiseXOR(F.shiftright(v, 15)) * F.lit(MIX_2).cast("long")).bitwiseAND(F.lit(MASK)))
    return let(x, lambda v: v.bitwiseXOR(F.shiftright(v, 15)))


def hash32_sql(x: str) -> str:
    x = f"list_transform([{x}], lambda v: (xor(v, v >> 16) * {MIX_1}) & {MASK})[1]"
    x = f"list_transform([{x}], lambda v: (xor(v, v >> 15) * {MIX_2}) & {MASK})[1]"
    return f"list_transform([{x}], lambda v: xor(v, v >> 15))[1]"


def drawn(h: Column, n: Column | int) -> Column:
    """A number from 0 to n - 1 for one from 0 to 2**32 - 1."""
    return F.shiftright(h.cast("long") * n, 32)


def number_text(x: Column) -> Column:
    """A number with up to four decimals, one at least."""
    return F.regexp_replace(F.format_string("%.4f", x.cast("double")), r"(\.\d+?)0+$", "$1")


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)
