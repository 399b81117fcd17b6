"""Rankings of symbols: movers, leaders of themes, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def movers(bars: DataFrame, by: str, n: int) -> DataFrame:
    """The n first of each period: gainers, losers, volume or amount, against the period before."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("t"))
    ranked = bars.withColumns({"change": F.when(before > 0, 100 * (F.col("close") - before) / before).otherwise(0.0), "amount": F.col("close") * F.col("volume")})
    key = {"gainers": F.col("change").desc(), "losers": F.col("change"), "volume": F.col("volume").desc(), "amount": F.col("amount").desc()}[by]
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(key, "symbol"))).where(F.col("rank") <= n)


def latest_movers(bars: DataFrame, asked: DataFrame, by: str, n: int, most_back: int = 7) -> DataFrame:
    """The n first of the latest day with bars for each asked day: the day itself, or one at most ``most_back`` days earlier.

    ``asked`` has a column asked, and bars one t, both in days. A day that finds none has no rows. Each day with bars
    answers the days after it, so there is no order over all days.
    """
    answers = bars.select("t").distinct().select("t", F.explode(F.sequence(F.col("t"), F.col("t") + most_back)).alias("asked"))
    latest = answers.groupBy("asked").agg(F.max("t").alias("t")).join(asked.select("asked").distinct(), "asked")
    return latest.join(movers(bars, by, n), "t")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The n first rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def newest(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    return top_per_group(df, group, [F.col(order).desc()], n)


def with_missing(quotes: DataFrame, members: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Members with their quotes, and the members that have none."""
    return members.join(quotes, on, "left"), members.join(quotes, on, "left_anti")


def rating(values: list[Column]) -> Column:
    """The mean of votes of -1, 0 and 1; NULL votes don't count."""
    present = F.filter(F.array(*[v.cast("double") for v in values]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))


def rating_band(x: Column) -> Column:
    return F.when(x > 0.5, "strong buy").when(x > 0.1, "buy").when(x >= -0.1, "neutral").when(x >= -0.5, "sell").when(x.isNotNull(), "strong sell")
