"""As-of and range alignment of series.

An as-of join is a union: both sides in one column of keys, sorted once, and
the last value carried forward. It shuffles each row once and never multiplies
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bars as B
from .spans import SPAN, span_of, with_carried


def asof(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, value: Column, name: str, by: list[str], forward: bool = False, times: tuple[Column, Column] | None = None, width: int = SPAN) -> DataFrame:
    """Adds to left the value of the last right row whose key is no later (``forward``: the first whose key is no earlier).

    Keys must be of one type. Rows of right with one key: any of them. NULL values
    inside ``value`` are kept if it is a struct. With ``times``, whole numbers of
    left and right rows that rise with their keys, a group is dealt by spans of
    time, and a row for each span tells the next ones its last value.
    """
    at, kept = times or (F.lit(0), F.lit(0)), [c for c in left.columns if c not in by]
    ours = left.select(*by, left_key.alias("_k"), span_of(at[0], width).alias("_span"), F.lit(1).alias("_side"), F.struct(*kept).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    theirs = right.select(*by, right_key.alias("_k"), span_of(at[1], width).alias("_span"), F.lit(0).alias("_side"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), value.alias("_v"))
    down = lambda c: F.desc(c) if forward else F.asc(c)
    both = ours.unionByName(theirs).select(F.struct(*by).alias("_key"), "_span", "_k", "_side", "_row", "_v")
    order = Window.partitionBy("_key", "_span").orderBy(down("_k"), "_side")
    both = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if times:
        ends = both.withColumn("_more", F.lead(F.lit(1)).over(order)).where("_more is null")
        before = Window.partitionBy("_key").orderBy(down("_span")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_was", F.last("_seen", ignorenulls=True).over(before))
        both = with_carried(both.where("_side = 1"), ends, {"_was": F.col("_was")}).withColumn("_seen", F.coalesce("_seen", "_was"))
    return both.where("_side = 1").select(*[F.col(f"_row.{c}" if c in kept else f"_key.{c}") for c in left.columns], F.col("_seen").alias(name))


def with_end(bars: DataFrame, tf: str) -> DataFrame:
    """Adds the second at which a bar is complete: the next bar's opening, or the nominal end of a symbol's last bar."""
    return bars.withColumn("end", F.coalesce(F.lead("t").over(Window.partitionBy("symbol").orderBy("t")), B.next_of(F.col("t"), tf)))


def security(chart: DataFrame, higher: DataFrame, tf: str, columns: list[str], chart_seconds: int, lookahead: bool = False, gaps: bool = False) -> DataFrame:
    """Columns of the bars of a longer timeframe at each chart bar, as a struct ``other``.

    Without lookahead a longer bar counts once it is complete; with it, from its
    opening on. With gaps only the first chart bar that sees a longer bar gets it.
    """
    value = F.struct(F.col("t").alias("t"), *[F.col(c) for c in columns])
    if lookahead:
        out = asof(chart, higher, F.col("t") + chart_seconds - 1, F.col("t"), value, "other", ["symbol"])
    else:
        higher = with_end(higher, tf)
        out = asof(chart, higher, F.col("t"), F.col("end"), value, "other", ["symbol"])
    if gaps:
        before = F.lag("other.t").over(Window.partitionBy("symbol").orderBy("t"))
        out = out.withColumn("_new", F.coalesce(F.col("other.t") != before, F.col("other.t").isNotNull()))
        out = out.withColumn("other", F.when(F.col("_new"), F.col("other"))).drop("_new")
    return out


def security_lower(chart: DataFrame, lower: DataFrame, tf: str, value: str, name: str = "values") -> DataFrame:
    """The values of the shorter bars that open within each chart bar, oldest first; empty if there are none."""
    inside = lower.groupBy("symbol", B.floor_to(F.col("t"), tf).alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", value))), lambda s: s[value]).alias(name))
    return chart.join(inside, ["symbol", "t"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<double>")))


def excursions(trades: DataFrame, bars: DataFrame, width: int = 64) -> DataFrame:
    """Adds to trades (trade, symbol, entry, exit, dir, price by bar place) the best and worst price move while open.

    A range join by buckets of ``width`` bars: a trade meets only the buckets it touches.
    """
    spans = trades.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("entry") / width), F.floor(F.col("exit") / width))))
    held = spans.join(bars.select("symbol", "i", "high", "low", F.floor(F.col("i") / width).alias("_bucket")), ["symbol", "_bucket"]).where("i between entry and exit")
    up, down = F.col("high") - F.col("price"), F.col("price") - F.col("low")
    long = F.col("dir") > 0
    best = held.groupBy(*trades.columns).agg(F.max(F.when(long, up).otherwise(down)).alias("runup"), F.max(F.when(long, down).otherwise(up)).alias("drawdown"))
    return best.withColumns({"runup": F.greatest("runup", F.lit(0.0)), "drawdown": F.greatest("drawdown", F.lit(0.0))})
