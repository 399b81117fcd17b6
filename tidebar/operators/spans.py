"""Windows of many ticks dealt by symbol and span of time, so that a symbol is many tasks and each row is passed once.

Times are whole numbers. Rows without one form a span of their own before all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a span.
SPAN = 3_600
_BEFORE_ALL = -(1 << 62)


def span_of(at: Column, width: int = SPAN) -> Column:
    """Where the span begins that a time lies in."""
    return F.coalesce((at - F.pmod(at, F.lit(width))).cast("long"), F.lit(_BEFORE_ALL))


def dealt(rows: DataFrame, by: list[str], at: Column, width: int = SPAN) -> DataFrame:
    """Adds _key, by whose value NULL keys meet, too, and _span."""
    return rows.withColumns({"_key": F.struct(*by), "_span": span_of(at, width)})


def with_carried(rows: DataFrame, ends: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Adds columns worked out of ``ends``, a row for each _key and _span, to the dealt rows of the span. Rows stay where they are."""
    own = ends.select("_key", "_span", *[c.alias(n) for n, c in carried.items()])
    return rows.join(own.hint("shuffle_merge"), ["_key", "_span"], "left")


def spans_before():
    """The spans of a key before a span."""
    return Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)


def recent(rows: DataFrame, values: dict[str, tuple[Callable, Column]], reach: int, key: str = "symbol", at: str = "t") -> DataFrame:
    """Adds sums, counts, least or greatest values (name: (F.sum, F.count, F.min or F.max, column)) over the rows of the key from ``reach`` before a row's time up to it.

    Such a frame is the end of one span of ``reach + 1`` and the beginning of the
    next. Both come of running aggregates, one from the span's end back and one from
    its beginning on, so time grows with the rows and not with those in a frame.
    """
    width, kept = reach + 1, [c for c in rows.columns if c != key]
    rows = rows.withColumns({"_span": span_of(F.col(at), width), **{f"_v_{n}": x for n, (_, x) in values.items()}})
    types, held = dict(rows.dtypes), [f"_v_{n}" for n in values]
    row = F.struct(*kept, *held)
    ours = rows.select(key, "_span", (F.col(at) - reach).alias("_k"), F.lit(1).alias("_side"), row.alias("_row"), *[F.lit(None).cast(types[h]).alias(h) for h in held])
    earlier = rows.where(F.col(at).isNotNull() & F.coalesce(*[F.when(F.col(h).isNotNull(), True) for h in held], F.lit(False)))
    earlier = earlier.select(key, (F.col("_span") + width).alias("_span"), F.col(at).alias("_k"), F.lit(0).alias("_side"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), *held)
    back = Window.partitionBy(key, "_span").orderBy(F.desc("_k"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.unionByName(earlier).withColumns({f"_old_{n}": f(f"_v_{n}").over(back) for n, (f, _) in values.items()})
    both = both.where("_side = 1").select(key, "_span", "_row.*", *[f"_old_{n}" for n in values])
    on = Window.partitionBy(key, "_span").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({f"_new_{n}": f(f"_v_{n}").over(on) for n, (f, _) in values.items()})

    def joined(name: str, f: Callable) -> Column:
        old, new = F.col(f"_old_{name}"), F.col(f"_new_{name}")
        if f in (F.min, F.max):
            return (F.least if f is F.min else F.greatest)(old, new)
        return F.coalesce(old + new, old, new)

    columns = [c for c in rows.columns if c == key or c in kept]
    return out.select(*columns, *[joined(n, f).alias(n) for n, (f, _) in values.items()])
