"""Sources and sinks of bars and ticks.

All read through Spark with a given schema, so filters and columns reach the
scan and nothing is inferred from the data.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDLE = "time bigint, open double, high double, low double, close double, volume double"
TICK = "ts bigint, dt string, code string, price double, vol bigint, tick_type int, amount double, total_volume bigint"
KLINES = "s string, t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>"


def candles(spark: SparkSession, path: str, symbol: str | None = None, begin: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    """A JSON array of candles, or one candle a line: those from begin to end (both included), the newest ``limit`` of them.

    Without a symbol the path is a folder with a folder symbol=NAME for each, and all are one scan.
    """
    schema = CANDLE if symbol is not None else f"{CANDLE}, symbol string"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    out = df.select(F.lit(symbol).alias("symbol") if symbol is not None else F.col("symbol"), F.col("time").alias("t"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume")).where("t is not null")
    if begin is not None:
        out = out.where(F.col("t") >= begin)
    if end is not None:
        out = out.where(F.col("t") <= end)
    return out.orderBy(F.col("t").desc()).limit(limit) if limit else out


def shifted_to(bars: DataFrame, now: int, step: int) -> DataFrame:
    """Bars moved in time so that each symbol's last one is the current one."""
    last = F.max("t").over(Window.partitionBy("symbol"))
    return bars.withColumn("t", F.col("t") + (F.lit(now - now % step) - last))


def klines(payload: DataFrame) -> DataFrame:
    """Bars of a payload of parallel arrays: rows without a price are dropped, a missing volume is 0."""
    rows = payload.select(F.col("s").alias("symbol"), F.explode(F.arrays_zip("t", "o", "h", "l", "c", "v")).alias("x"))
    return rows.select("symbol", F.col("x.t").alias("t"), F.col("x.o").alias("open"), F.col("x.h").alias("high"), F.col("x.l").alias("low"), F.col("x.c").alias("close"), F.coalesce("x.v", F.lit(0.0)).alias("volume")).dropna(subset=["t", "open", "high", "low", "close"])


def opened_at(t: Column, stock: Column, auction: int = 13 * 3600 + 30 * 60, zone_shift: int = 8 * 3600) -> Column:
    """The opening of a minute bar stamped at its end; a stock's closing auction keeps its stamp."""
    return F.when(stock & ((t + zone_shift) % 86400 == auction), t).otherwise(t - 60)


#: Bytes of a ZIP member that become rows at a time.
PIECE = 1 << 20


def _members(encoding: str):
    """Lines of all members of ZIP archives, with their place; a member is read in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for name in sorted(n for n in archive.namelist() if not n.endswith("/")):
                        with archive.open(name) as raw:
                            lines, n = io.TextIOWrapper(raw, encoding=encoding, errors="replace"), 0
                            while own := lines.readlines(PIECE):
                                places = pa.array(range(n, n + len(own)), pa.int64())
                                n += len(own)
                                yield pa.RecordBatch.from_arrays([pa.array([path] * len(own)), pa.array([name] * len(own)), places, pa.array([x.rstrip("\r\n") for x in own])], names=["archive", "member", "place", "line"])

    return run


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the ZIP archives in a folder of any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")


def zipped_lines(files: DataFrame, encoding: str = "cp950") -> DataFrame:
    """(archive, member, place, line) of the texts in ZIP archives (path, content); an archive is one task's."""
    return files.select("path", "content").mapInArrow(_members(encoding), "archive string, member string, place bigint, line string")


def contract(code: Column) -> tuple[Column, Column]:
    """Product and month of delivery of a contract such as MXFK6, whose letter is the month and whose digit is the year of the 2020s."""
    # Products of the contracts' codes.
    products = F.create_map(*[F.lit(x) for pair in (("MXF", "MTX"), ("TMF", "TMF"), ("TXF", "TX")) for x in pair])
    month = F.lpad((F.ascii(F.substring(code, 4, 1)) - ord("A") + 1).cast("string"), 2, "0")
    return F.try_element_at(products, F.substring(code, 1, 3)), F.concat(F.lit("202"), F.substring(code, 5, 1), month)


def archive_bars(files: DataFrame, contracts: DataFrame, zone_shift: int = 8 * 3600) -> DataFrame:
    """Minute bars (symbol, t, open, high, low, close, volume) of contracts (symbol) straight from a venue's ZIP archives (path, content).

    A member's first line is its heading; a line is date, product, month, time
    (hhmmss), price, volume of both sides. Lines that are none, and other products
    and months, are left out. Lines of a minute count in the order of archives'
    names, members and places.
    """
    f = F.split("line", ",")
    cell = lambda k: F.trim(F.get(f, F.lit(k)))
    at = F.try_to_timestamp(F.concat(cell(0), F.substring(F.lpad(cell(3), 6, "0"), 1, 4)), F.lit("yyyyMMddHHmm"))
    rows = zipped_lines(files).where((F.col("place") > 0) & (F.size(f) >= 6)).select(
        cell(1).alias("product"), cell(2).alias("month"), (F.unix_seconds(at) - zone_shift).alias("t"), F.expr("try_cast(trim(get(split(line, ','), 4)) as double)").alias("price"), (F.expr("try_cast(trim(get(split(line, ','), 5)) as double)") / 2).alias("volume"), F.struct("archive", "member", "place").alias("at")
    )
    product, month = contract(F.col("symbol"))
    wanted = contracts.select("symbol", product.alias("product"), month.alias("month"))
    ticks = rows.dropna(subset=["t", "price", "volume"]).join(wanted, ["product", "month"])
    return ticks.groupBy("symbol", "t").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("volume").alias("volume"))


def replay(prices: DataFrame, tick_sizes: DataFrame, steps_per_batch: int = 1, key: str = "symbol") -> DataFrame:
    """A stream that cycles through each symbol's prices (symbol, place from 0, price), one a step: symbol, step, bid, ask.

    Spark's rate source deals its numbers to the symbols in turn; it is as far on
    after a restart as it was. A price is looked up by the rest of its step. The
    spread is the symbol's tick size (symbol, tick), or a ten-thousandth of its last
    price if that is more.
    """
    spark = prices.sparkSession
    size = prices.groupBy(key).agg(F.count("*").alias("_n"), F.max_by("price", "place").alias("_last")).join(tick_sizes, key)
    cursors = size.select(key, "_n", (F.greatest(F.col("tick"), F.col("_last") * 0.0001) / 2).alias("_half"), (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("_turn"))
    symbols = max(1, cursors.count())
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", symbols * steps_per_batch).load()
    turns = numbers.select((F.col("value") % symbols).alias("_turn"), F.floor(F.col("value") / symbols).alias("step"))
    met = turns.join(cursors, "_turn").withColumn("place", F.col("step") % F.col("_n")).join(prices.select(key, "place", "price"), [key, "place"])
    return met.select(key, "step", (F.col("price") - F.col("_half")).alias("bid"), (F.col("price") + F.col("_half")).alias("ask"))


def archive_trades(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A venue's CSV of trades (date, symbol, time hhmmss, price, volume of both sides): ticks with half the volume."""
    df = spark.read.schema("date string, code string, time string, price double, volume double").option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED").csv(path)
    at = F.to_timestamp_ntz(F.concat("date", F.lpad("time", 6, "0")), F.lit("yyyyMMddHHmmss"))
    seconds = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), at).cast("long")
    return df.select(F.trim("code").alias("symbol"), seconds.alias("t"), F.monotonically_increasing_id().alias("seq"), "price", (F.col("volume") / 2).alias("volume"))


def tick_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of ticks, one JSON object a line; lines that are none are left out."""
    return spark.read.schema(TICK).option("mode", "DROPMALFORMED").json(path).where("code is not null")


def tick_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """The same log as it grows."""
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", files_at_once).json(path).where("code is not null")


def append_log(ticks: DataFrame, path: str) -> None:
    ticks.write.mode("append").json(path)


def backfill(log: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """Fetched rows that the log doesn't have."""
    return fetched.join(log.select(*keys), keys, "left_anti")


def watchlist(quotes: DataFrame, n: int) -> DataFrame:
    """The n common stocks (four digits, no leading zero) of largest amount."""
    return quotes.where(F.col("code").rlike(r"^[1-9]\d{3}$")).orderBy(F.col("amount").desc(), "code").limit(n)


def verify_dedup(before: DataFrame, after: DataFrame, keys: list[str]) -> dict[str, Column | int]:
    """Rows that appeared, keys that vanished, and keys that are still double: all 0 if a dedup only removed copies."""
    counted = lambda df, n: df.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in before.columns]).agg(F.count("*").alias(n))
    more = counted(after, "_a").join(counted(before, "_b"), before.columns, "left").where("_a > coalesce(_b, 0)")
    double = after.groupBy(*keys).count().where("count > 1")
    return {"appeared": more.count(), "vanished": before.select(*keys).distinct().join(after, keys, "left_anti").count(), "double": double.count()}
