"""Bars from ticks, and bars of longer timeframes from shorter ones.

A bar is one row of (symbol, t, open, high, low, close, volume), t being the
epoch second at which it opens. All of these are one aggregation each, combined
on the map side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
_UNITS = {"S": 1, "": 60, "H": 3600}
TIMEFRAME = re.compile(r"(\d*)([SHDWM]?)$")


def timeframe(text: str) -> tuple[int, str]:
    """Count and unit: 15, 30S, 4H, D, 2W, M; without a unit it counts minutes."""
    m = TIMEFRAME.match(text)
    if not m or not text:
        raise ValueError(f"not a timeframe: {text!r}")
    return int(m[1] or 1), m[2]


def seconds(tf: str) -> int:
    """Nominal length; a month has 30 days and 10 hours and a half, a twelfth of a mean year."""
    n, unit = timeframe(tf)
    return n * {"D": DAY, "W": 7 * DAY, "M": 2_628_003}.get(unit, _UNITS.get(unit, 60))


def from_seconds(s: int) -> str:
    """The shortest timeframe that is at least so long."""
    if s < 60:
        return f"{next(n for n in (1, 5, 10, 15, 30, 60) if n >= s)}S" if s <= 30 else "1"
    if s < DAY:
        return str(-(-s // 60)) if s <= 1440 * 60 - 60 else "1D"
    if s < 7 * DAY:
        return f"{-(-s // DAY)}D"
    return f"{-(-s // (7 * DAY))}W" if s < 53 * 7 * DAY else "12M"


def epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp, with or without time zone."""
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {})".format(ts if isinstance(ts, str) else ts._jc.toString()))


def _month(t: Column) -> Column:
    d = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / DAY).cast("int"))
    return F.year(d) * 12 + F.month(d) - 1


def _month_start(total: Column) -> Column:
    return F.datediff(F.make_date(F.floor(total / 12).cast("int"), (total % 12 + 1).cast("int"), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long") * DAY


def floor_to(t: Column, tf: str) -> Column:
    """The opening of the bar that holds t: days count from the epoch, weeks begin on Monday, months are of the calendar."""
    n, unit = timeframe(tf)
    if unit == "M":
        return _month_start(F.floor(_month(t) / n).cast("long") * n)
    if unit == "W":
        return ((F.floor((F.floor(t / DAY) + 3) / (7 * n)) * (7 * n) - 3) * DAY).cast("long")
    step = n * DAY if unit == "D" else seconds(tf)
    return (F.floor(t / step) * step).cast("long")


def next_of(start: Column, tf: str) -> Column:
    """The opening of the next bar."""
    n, unit = timeframe(tf)
    return _month_start(_month(start) + n) if unit == "M" else start + seconds(tf)


def from_ticks(ticks: DataFrame, tf: str = "60") -> DataFrame:
    """Bars of ticks (symbol, t, seq, price, volume): the first and last price by (t, seq, price)."""
    at = F.struct("t", "seq", "price")
    return (
        ticks.where(F.col("price").isNotNull())
        .groupBy("symbol", floor_to(F.col("t"), tf).alias("bucket"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("bucket", "t")
    )


def resample(bars: DataFrame, tf: str, shift: int = 0) -> DataFrame:
    """Longer bars: first open, greatest high, least low, last close, summed volume. ``shift``: seconds that the venue's day starts before UTC's."""
    bucket = floor_to(F.col("t") + shift, tf) - shift
    return (
        bars.groupBy("symbol", bucket.alias("bucket"))
        .agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("bucket", "t")
    )


def dedup(ticks: DataFrame, keys: list[str], order: list[str], dated: str = "t") -> DataFrame:
    """The first row of each key; rows without a time stay as they are."""
    first = ticks.where(F.col(dated).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return first.where("_n = 1").drop("_n").unionByName(ticks.where(F.col(dated).isNull()))


def event_ticks(events: DataFrame) -> DataFrame:
    """The events table as ticks: a symbol for each event type, the value as price, one unit each."""
    return events.select(F.col("event_type").alias("symbol"), epoch("ts").cast("long").alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def lineitem_ticks(lineitem: DataFrame) -> DataFrame:
    """The lineitem table as trades: a symbol for each flag and status, price per unit, quantity as volume."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), epoch("l_shipdate").cast("long").alias("t"), seq.alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))


def indexed(bars: DataFrame) -> DataFrame:
    """Adds i, the bar's place from 0 in its symbol."""
    return bars.withColumn("i", (F.row_number().over(Window.partitionBy("symbol").orderBy("t")) - 1).cast("long"))


def with_prices(bars: DataFrame) -> DataFrame:
    """Adds hl2, hlc3, ohlc4 and hlcc4."""
    h, lo, c, o = (F.col(x) for x in ("high", "low", "close", "open"))
    return bars.withColumns({"hl2": (h + lo) / 2, "hlc3": (h + lo + c) / 3, "ohlc4": (o + h + lo + c) / 4, "hlcc4": (h + lo + 2 * c) / 4})
