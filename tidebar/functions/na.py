"""Missing values as the scripts know them: NULL spreads through arithmetic, comparisons with it are false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers nearer than this are equal.
TOLERANCE = 1e-10


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), x)


def na(x: Column) -> Column:
    return x.isNull()


def nz(x: Column, replacement=0) -> Column:
    return F.coalesce(x, F.lit(replacement))


def truthy(x: Column) -> Column:
    """NULL, 0 and false are false."""
    return F.coalesce(x.cast("boolean"), F.lit(False))


def div(a: Column, b: Column) -> Column:
    """Division of doubles; by zero it is NULL."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; by zero it is NULL."""
    return F.when(b != 0, a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double"))))


def _compare(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def eq(a: Column, b: Column) -> Column:
    return _compare(F.abs(a - b) <= TOLERANCE)


def ne(a: Column, b: Column) -> Column:
    return _compare(F.abs(a - b) > TOLERANCE)


def gt(a: Column, b: Column) -> Column:
    return _compare((a > b) & (F.abs(a - b) > TOLERANCE))


def lt(a: Column, b: Column) -> Column:
    return gt(b, a)


def ge(a: Column, b: Column) -> Column:
    return _compare((a > b) | (F.abs(a - b) <= TOLERANCE))


def le(a: Column, b: Column) -> Column:
    return ge(b, a)


def not_(a: Column) -> Column:
    return ~truthy(a)


def and_(a: Column, b: Column) -> Column:
    return truthy(a) & truthy(b)


def or_(a: Column, b: Column) -> Column:
    return truthy(a) | truthy(b)


def iff(condition: Column, then: Column, other: Column) -> Column:
    return F.when(truthy(condition), then).otherwise(other)


def switch(subject: Column, arms: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The first arm whose value equals the subject; a NULL subject meets a NULL arm."""
    out = default if default is not None else F.lit(None)
    for value, then in reversed(arms):
        out = F.when(subject.eqNullSafe(value), then).otherwise(out)
    return out


def check(condition: Column, value: Column, message: str) -> Column:
    """The value, or an error that ends the run where the condition doesn't hold or is NULL."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
