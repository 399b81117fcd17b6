"""Sources and sinks: tables are written in a source's format to the shared folder and read back through it."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import bars as B
from ..sources import files as S
from .common import BARS_SQL, hourly, new_path, shown, sql_shown, table

OHLCV = ("open", "high", "low", "close", "volume")


def src_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from JSON arrays of candles, a folder for each symbol and a file for each of its weeks, from the second day on."""
    bars = hourly(spark, sf_dir)
    path = new_path(spark, "candles")
    candle = F.struct(F.col("t").alias("time"), *OHLCV)
    week = F.floor(F.col("t") / (7 * B.DAY)).alias("week")
    bars.groupBy("symbol", week).agg(F.to_json(F.array_sort(F.collect_list(candle))).alias("value")).write.partitionBy("symbol", "week").text(path)
    begin = (bars.agg(F.min("t")).first()[0] or 0) + B.DAY
    return shown(S.candles(spark, path, begin=begin), ["symbol", "t"], {c: c for c in OHLCV})


def src_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from payloads of parallel arrays with holes, at the opening of their minutes; a bar without a price is dropped."""
    bars = hourly(spark, sf_dir)
    hole = F.when(F.col("close") > F.col("open"), F.col("volume"))
    rows = bars.select("symbol", F.struct("t", "open", "high", "low", F.when(F.col("close") != F.col("open"), F.col("close")).alias("close"), hole.alias("v")).alias("x"))
    payload = rows.groupBy("symbol").agg(F.array_sort(F.collect_list("x")).alias("x"))
    payload = payload.select(F.col("symbol").alias("s"), *[F.col(f"x.{c}").alias(n) for c, n in (("t", "t"), ("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("v", "v"))])
    path = new_path(spark, "klines")
    payload.write.json(path)
    out = S.klines(spark.read.schema(S.KLINES).json(path))
    return shown(out.withColumn("opened", S.opened_at(F.col("t"), F.col("symbol") != "click")), ["symbol", "t", "opened"], {c: c for c in OHLCV})


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = B.event_ticks(table(spark, sf_dir, "events"))
    return ticks.select(F.col("t").alias("ts"), F.from_unixtime("t").alias("dt"), F.col("symbol").alias("code"), "price", F.col("seq").alias("vol"), F.lit(1).alias("tick_type"), (F.col("price") * 2).alias("amount"), F.col("seq").alias("total_volume"))


def src_tick_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a log written in two appends, with lines that are none."""
    path = new_path(spark, "log")
    ticks = _log(spark, sf_dir)
    S.append_log(ticks.where("code < 'p'"), path)
    S.append_log(ticks.where("code >= 'p'"), path)
    spark.createDataFrame([("no tick",), ("{\"ts\": 1}",)], "value string").write.mode("append").text(path)
    return shown(S.tick_log(spark, path), ["ts", "code", "vol"], {"price": "price", "amount": "amount"})


def src_tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log followed as a stream, file by file, until all of it is read."""
    from .streams import result

    path = new_path(spark, "log")
    S.append_log(_log(spark, sf_dir).repartition(3), path)
    return shown(result(S.tick_stream(spark, path), "stream-log", "append"), ["ts", "code", "vol"], {"price": "price"})


#: Contracts that the symbols stand for.
CONTRACTS = {"click": "MXFA4", "view": "MXFB4", "purchase": "TXFA4", "signup": "TXFL3", "error": "TMFC4"}


def _zipped(pdf: pd.DataFrame) -> pd.DataFrame:
    """A day's archive."""
    day, lines = pdf["day"].iloc[0], pdf.sort_values("place")["line"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"Daily_{day}.csv", "\r\n".join(["成交日期,商品代號,到期月份,成交時間,成交價格,成交數量", *lines]).encode("cp950"))
    return pd.DataFrame([(f"Daily_{day}.zip", out.getvalue())], columns=["path", "content"])


def src_zip_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of contracts from a venue's daily ZIP archives of trades in cp950."""
    ticks = B.event_ticks(table(spark, sf_dir, "events"))
    codes = F.create_map(*[F.lit(x) for pair in CONTRACTS.items() for x in pair])
    product, month = S.contract(codes[F.col("symbol")])
    at = F.timestamp_seconds(F.col("t") + 8 * 3600)
    line = F.concat_ws(",", F.date_format(at, "yyyyMMdd"), F.rpad(product, 10, " "), F.rpad(month, 8, " "), F.date_format(at, "Hmmss"), F.col("price").cast("string"), (2 * F.col("volume")).cast("int").cast("string"))
    lines = ticks.select(F.date_format(at, "yyyy_MM_dd").alias("day"), F.struct("t", "seq").alias("o"), line.alias("line"))
    lines = lines.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("o"))).drop("o")
    path = new_path(spark, "archives")
    lines.groupBy("day").applyInPandas(_zipped, "path string, content binary").write.parquet(path)
    contracts = spark.createDataFrame([(c,) for c in CONTRACTS.values()], "symbol string")
    return shown(S.archive_bars(spark.read.schema("path string, content binary").parquet(path), contracts), ["symbol", "t"], {c: c for c in OHLCV})


def src_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly closes replayed as quotes in a cycle, one and a half times the longest series."""
    from .streams import result

    bars = hourly(spark, sf_dir)
    prices = bars.select("symbol", F.col("i").cast("long").alias("place"), F.col("close").alias("price"))
    path = new_path(spark, "replayed")
    prices.write.parquet(path)
    prices = spark.read.schema(prices.schema).parquet(path)
    ticks = prices.select("symbol").distinct().withColumn("tick", F.when(F.col("symbol") == "click", 0.5).otherwise(0.001))
    steps = (prices.agg(F.max("place")).first()[0] or 0) * 3 // 2 + 1
    return shown(result(S.replay(prices, ticks, steps), "stream-replay", "append"), ["symbol", "step"], {"bid": "bid", "ask": "ask"})


def src_archive_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a venue's CSV, whose volume counts both sides."""
    ticks = B.event_ticks(table(spark, sf_dir, "events"))
    at = F.timestamp_seconds("t")
    path = new_path(spark, "archive")
    ticks.select(F.date_format(at, "yyyyMMdd").alias("date"), F.concat("symbol", F.lit("  ")).alias("code"), F.date_format(at, "HHmmss").cast("int").cast("string").alias("time"), "price", (F.col("seq") * 2.0).alias("volume")).write.option("header", True).csv(path)
    return shown(S.archive_trades(spark, path), ["symbol", "t"], {"price": "price", "volume": "volume"})


def src_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars moved so that each symbol's last one is the current one."""
    return S.shifted_to(hourly(spark, sf_dir), 1_800_000_123, 3600).select("symbol", "t", "i")


def src_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 four-digit parts of largest stock."""
    quotes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("code")).agg(F.sum("l_quantity").alias("amount"))
    return S.watchlist(quotes, 25).select("code", F.col("amount").cast("double").alias("amount"))


def src_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched rows that a log lacks: customers without a pending order."""
    log = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return S.backfill(log, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"])


def src_verify_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What checking a dedup finds: on a right one nothing, on one that kept and lost rows what it did."""
    ticks = B.event_ticks(table(spark, sf_dir, "events")).select("symbol", "t", "price")
    once = ticks.dropDuplicates(["symbol", "t"])
    lost = once.where("symbol <> 'click'")
    rows = [(name, int(x["vanished"]), int(x["double"])) for name, x in (("right", S.verify_dedup(ticks, once, ["symbol", "t"])), ("none", S.verify_dedup(ticks, ticks, ["symbol", "t"])), ("lost", S.verify_dedup(ticks, lost, ["symbol", "t"])))]
    return spark.createDataFrame(rows, "dedup string, vanished long, double long")


def src_open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates that are neither a weekend nor a holiday; holidays are the days on which a month begins."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return T.open_days(days, days.where(F.dayofmonth("day") == 1)).select(F.col("day").cast("string").alias("day"))


_WITH = f"WITH {BARS_SQL}"
_V = {c: c for c in OHLCV}
_T = "SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, value AS price FROM events"

QUERIES = {f.__name__: f for f in (src_candles, src_klines, src_tick_log, src_tick_stream, src_archive_trades, src_zip_bars, src_replay, src_shifted, src_watchlist, src_backfill, src_verify_dedup, src_open_days)}
SQL = {
    "src_candles": f"{_WITH} SELECT symbol, t, {sql_shown(_V)} FROM bars WHERE t >= (SELECT min(t) FROM bars) + 86400",
    "src_klines": f"{_WITH}, k AS (SELECT symbol, t, CASE WHEN symbol <> 'click' AND (t + 28800) % 86400 = 48600 THEN t ELSE t - 60 END AS opened, open, high, low, close, CASE WHEN close > open THEN volume ELSE 0 END AS volume FROM bars WHERE close <> open) SELECT symbol, t, opened, {sql_shown(_V)} FROM k",
    "src_tick_log": f"WITH k AS ({_T}) SELECT t AS ts, symbol AS code, seq AS vol, {sql_shown({'price': 'price', 'amount': 'price * 2'})} FROM k",
    "src_tick_stream": f"WITH k AS ({_T}) SELECT t AS ts, symbol AS code, seq AS vol, {sql_shown({'price': 'price'})} FROM k",
    "src_archive_trades": f"WITH k AS ({_T}) SELECT symbol, t, {sql_shown({'price': 'price', 'volume': 'seq'})} FROM k",
    "src_zip_bars": f"SELECT CASE event_type {' '.join(f'WHEN $${a}$$ THEN $${b}$$' for a, b in CONTRACTS.items())} END AS symbol, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS t, {sql_shown({'open': 'first(value ORDER BY floor(epoch(ts)), event_id)', 'high': 'max(value)', 'low': 'min(value)', 'close': 'last(value ORDER BY floor(epoch(ts)), event_id)', 'volume': 'count(*)'})} FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
    "src_replay": f"{_WITH}, n AS (SELECT symbol, count(*) AS n, last(close ORDER BY t) AS last FROM bars GROUP BY 1), s AS (SELECT symbol, n, greatest(CASE WHEN symbol = 'click' THEN 0.5 ELSE 0.001 END, last * 0.0001) / 2 AS half, unnest(range(0, (SELECT (max(i) * 3) // 2 + 1 FROM b))) AS step FROM n) SELECT s.symbol, s.step, {sql_shown({'bid': 'close - half', 'ask': 'close + half'})} FROM s JOIN b ON b.symbol = s.symbol AND b.i = s.step % s.n",
    "src_shifted": f"{_WITH} SELECT symbol, t + 1800000000 - max(t) OVER (PARTITION BY symbol) AS t, i FROM b",
    "src_watchlist": "SELECT CAST(l_partkey AS VARCHAR) AS code, CAST(sum(l_quantity) AS DOUBLE) AS amount FROM lineitem WHERE l_partkey BETWEEN 1000 AND 9999 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "src_backfill": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')",
    "src_verify_dedup": f"WITH k AS ({_T}), g AS (SELECT symbol, t, count(*) AS n FROM k GROUP BY 1, 2) SELECT 'right' AS dedup, CAST(0 AS BIGINT) AS vanished, CAST(0 AS BIGINT) AS double UNION ALL SELECT 'none', 0, count(*) FROM g WHERE n > 1 UNION ALL SELECT 'lost', count(*), 0 FROM g WHERE symbol = 'click'",
    "src_open_days": "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE dayofweek(CAST(o_orderdate AS DATE)) NOT IN (0, 6) AND day(CAST(o_orderdate AS DATE)) <> 1",
}
