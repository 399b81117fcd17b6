"""What a bar knows of itself: its place in the series, its symbol, its timeframe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import asof
from .bars import next_of, seconds, timeframe

#: Venues whose symbols are quoted in TWD; others are in USD.
TWD_VENUES = ("TWSE", "TPEx", "TPEX", "TAIFEX")
#: Copies of a series that other symbols' bars are aligned with.
SHARES = 64


def bar_state(bars: DataFrame) -> DataFrame:
    """Adds bar_index, last_bar_index and the flags of a finished series: isnew and isconfirmed always hold, isrealtime never."""
    by = Window.partitionBy("symbol")
    bars = bars.withColumns({"bar_index": F.row_number().over(by.orderBy("t")) - 1, "last_bar_index": F.count("*").over(by).cast("int") - 1})
    last = F.col("bar_index") == F.col("last_bar_index")
    return bars.withColumns({
        "isfirst": F.col("bar_index") == 0, "islast": last, "ishistory": ~last, "islastconfirmedhistory": last, "isnew": F.lit(True), "isconfirmed": F.lit(True), "isrealtime": F.lit(False),
    })


def symbol_info(symbol: Column) -> dict[str, Column]:
    """Columns of a symbol written VENUE:TICKER, or TICKER alone."""
    at = F.instr(symbol, F.lit(":"))
    prefix = F.when(at > 1, F.substring(symbol, F.lit(1), at - 1)).otherwise("")
    currency = F.when(prefix.isin(*TWD_VENUES), "TWD").otherwise("USD")
    ticker = F.when(at > 1, F.substring(symbol, at + 1, F.length(symbol))).otherwise(symbol)
    return {
        "ticker": ticker, "tickerid": symbol, "prefix": prefix, "description": ticker, "type": F.lit("stock"), "currency": currency, "basecurrency": currency, "timezone": F.lit("Asia/Taipei"),
        "session": F.lit("regular"), "mintick": F.lit(0.01), "pricescale": F.lit(100), "pointvalue": F.lit(1.0), "minmov": F.lit(1), "volumetype": F.lit("base"),
    }


def timeframe_info(tf: str) -> dict[str, Column]:
    """Columns of a timeframe: its period, count and kind."""
    n, unit = timeframe(tf)
    of_minutes = unit in ("", "H")
    return {
        "period": F.lit(tf), "main_period": F.lit(tf), "multiplier": F.lit(n), "isseconds": F.lit(unit == "S"), "isminutes": F.lit(of_minutes), "isdaily": F.lit(unit == "D"), "isweekly": F.lit(unit == "W"), "ismonthly": F.lit(unit == "M"),
        "isintraday": F.lit(of_minutes or unit == "S"), "isdwm": F.lit(unit in ("D", "W", "M")), "isticks": F.lit(False), "in_seconds": F.lit(seconds(tf)),
    }


def foreign(chart: DataFrame, other: DataFrame, symbol: str, columns: list[str], tf: str) -> DataFrame:
    """Columns of another symbol's last complete bar at each chart bar, as a struct ``foreign``.

    The chart's symbols are dealt to ``SHARES`` shares of the other series, so
    that it is copied so many times and not once for each symbol.
    """
    share = F.pmod(F.xxhash64("symbol"), F.lit(SHARES)).cast("int")
    series = other.where(F.col("symbol") == symbol).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return asof(chart.withColumn("_share", share), series, F.col("t"), next_of(F.col("t"), tf), F.struct("t", *columns), "foreign", ["_share"]).drop("_share")


def foreign_by(chart: DataFrame, other: DataFrame, symbol: Column, columns: list[str], tf: str) -> DataFrame:
    """As :func:`foreign`, but each chart bar names the symbol it asks for; a null or unknown one gets null.

    The bars that ask for one symbol are dealt to ``SHARES`` shares, of which each has the series of every symbol.
    """
    share = F.pmod(F.xxhash64("symbol", "t"), F.lit(SHARES)).cast("int")
    ours = chart.withColumns({"_asked": symbol, "_share": share})
    series = other.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).withColumn("_asked", F.col("symbol")).where("_asked is not null")
    return asof(ours, series, F.col("t"), next_of(F.col("t"), tf), F.struct("t", *columns), "foreign", ["_asked", "_share"]).drop("_asked", "_share")
