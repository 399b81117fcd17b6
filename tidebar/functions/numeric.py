"""Mathematical functions with NULL for what has no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .na import finite

PI, E, PHI, RPHI = 3.141592653589793, 2.718281828459045, 1.618033988749895, 0.618033988749895


def int_(x: Column) -> Column:
    """Truncates towards zero; text that is no number is NULL."""
    d = finite(x.try_cast("double"))
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("long")


def float_(x: Column) -> Column:
    return finite(x.try_cast("double"))


def bool_(x: Column, kind: str = "double") -> Column:
    """Numbers other than zero, and the texts true and 1."""
    return F.lower(x).isin("true", "1") if kind == "string" else F.coalesce(x != 0, F.lit(False))


def max_(*xs: Column) -> Column:
    """The greatest; NULL if any is NULL."""
    return F.when(_all(xs), F.greatest(*xs))


def min_(*xs: Column) -> Column:
    return F.when(_all(xs), F.least(*xs))


def _all(xs) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull()
    return out


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def pow_(x: Column, y: Column) -> Column:
    return finite(F.pow(x, y))


def sqrt(x: Column) -> Column:
    return finite(F.sqrt(x))


def log(x: Column) -> Column:
    return finite(F.when(x > 0, F.ln(x)))


def log10(x: Column) -> Column:
    return finite(F.when(x > 0, F.log10(x)))


def exp(x: Column) -> Column:
    return finite(F.exp(x))


def acos(x: Column) -> Column:
    return finite(F.acos(x))


def asin(x: Column) -> Column:
    return finite(F.asin(x))


def round_(x: Column, precision: int = 0) -> Column:
    """Halves go up, below zero too."""
    scale = 10.0**precision
    return F.floor(x * scale + 0.5) / scale


def round_to_tick(x: Column, tick: float = 0.01) -> Column:
    decimals = max(0, len(f"{tick:.10f}".rstrip("0").partition(".")[2]))
    return F.round(F.floor(x / tick + 0.5) * tick, decimals)


def avg(*xs: Column) -> Column:
    """The mean of those that are not NULL."""
    present = F.filter(F.array(*[x.cast("double") for x in xs]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, b: a + b), F.size(present))


def tonumber(x: Column, kind: str = "string") -> Column:
    """Text without its commas as a number; booleans as 0 and 1."""
    return x.cast("int").cast("double") if kind == "boolean" else finite(F.regexp_replace(F.trim(x), ",", "").try_cast("double"))


#: Results must equal those of the scripts' own generator.
_SEED_FACTOR, _BAR_FACTOR = 0x9E3779B1, 0x85EBCA6B


def xorshift(seed: Column, bar_index: Column) -> Column:
    """A 32-bit pseudo-random integer of a seed and a bar: three shifts, each folded back."""
    mask = F.lit(0xFFFFFFFF)
    low = lambda x: x.cast("long").bitwiseAND(mask)
    # products of 32-bit numbers, by halves so that they stay within 64 bits
    times = lambda x, k: low(low(x) * (k & 0xFFFF) + F.shiftleft(low(low(x) * (k >> 16)).bitwiseAND(F.lit(0xFFFF)), 16))
    x = times(int_(seed), _SEED_FACTOR).bitwiseXOR(times(bar_index + 1, _BAR_FACTOR))
    x = x.bitwiseXOR(low(F.shiftleft(x, 13)))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
    return x.bitwiseXOR(low(F.shiftleft(x, 5)))


def random(low: Column, high: Column, seed: Column, bar_index: Column) -> Column:
    return low + (high - low) * (xorshift(seed, bar_index) / 4294967296.0)
