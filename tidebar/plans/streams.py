"""Queries that run as streams over the events until all of them are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from ..operators import bars as B
from ..operators import folds as K
from ..operators import rolling as R
from ..streaming import bars as S
from ..streaming import recorder as N
from ..streaming import state as T
from .alignment import SQL as _ALIGNMENT
from .common import BARS_SQL, hourly, new_path, shown, sql_shown, table
from .recurrences import SQL as _RECURRENCES


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def result(df: DataFrame, name: str, mode: str, keys: tuple[str, ...] = (), stops: int = 0) -> DataFrame:
    """Runs a stream over what there is and returns what it wrote.

    Each batch is a table of its own, named by its number and overwritten if it
    is run again, so a restart doubles nothing. In update mode the newest batch
    that has a key holds its row. With ``stops`` the stream is stopped after a
    batch so many times and started again on its checkpoint.
    """
    spark = df.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")
    writer = df.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")).outputMode(mode).option("checkpointLocation", checkpoint)
    for _ in range(stops):
        q = writer.trigger(processingTime="0 seconds").start()
        for _ in range(300):  # a minute at most
            if q.awaitTermination(0.2) or q.recentProgress:
                break
        q.stop()
    writer.trigger(availableNow=True).start().awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    if mode == "update":
        rest = [c for c in df.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
    return rows.select(*df.columns)


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.unix_seconds("ts"))


def stream_hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a stream of ticks."""
    out = result(S.minute_bars(_events(spark, sf_dir), "1 hour"), "stream-bars", "update", ("symbol", "ts"))
    return shown(_seconds(out), ["symbol", "t"], {c: c for c in ("open", "high", "low", "close", "volume")})


def stream_sliding_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume of 3-hour windows that begin every hour."""
    out = result(S.sliding_volume(_events(spark, sf_dir), "3 hours", "1 hour"), "stream-volume", "update", ("symbol", "ts"))
    return shown(_seconds(out), ["symbol", "t"], {"volume": "volume"})


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that a stream keeps when each comes twice."""
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return shown(result(S.dedup(twice, ["symbol", "seq"]), "stream-dedup", "append"), ["symbol", "seq"], {"price": "price"})


def stream_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential and Wilder averages of hourly closes, with state for each symbol."""
    bars = hourly(spark, sf_dir).select("symbol", F.timestamp_seconds("t").alias("ts"), "close")
    path = new_path(spark, "stream-input")
    bars.write.parquet(path)
    stream = spark.readStream.schema(bars.schema).parquet(path)
    out = result(S.averages(stream, 10), "stream-averages", "append")
    return shown(_seconds(out), ["symbol", "t"], {"ema": "ema", "rma": "rma"})


#: Slices of time in which a table is streamed, and files of a slice.
SLICES, FILES = 5, 4


def in_slices(rows: DataFrame, name: str, order: str = "t") -> DataFrame:
    """A stream of a table in slices of time, some files a batch. A symbol's rows of a slice are one file, so however batches are cut they come in order."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    width = (ends["b"] - ends["a"]) // SLICES + 1 if ends["a"] is not None else 1
    for k in range(SLICES):
        lower = (ends["a"] or 0) + k * width
        rows.where((F.col(order) >= lower) & (F.col(order) < lower + width)).repartition(FILES, "symbol").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)


_KERNELS = [(["ema"], lambda: K.Ema(10), ["close"]), (["rma"], lambda: K.Rma(10), ["close"]), (["rsi"], lambda: K.Rsi(14), ["close"]), (["atr"], lambda: K.Atr(14), ["high", "low", "close"])]
_FORMED = ["open", "high", "low", "close", "volume", "ema", "rma", "rsi", "atr"]


def stream_forming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a stream of ticks with recurrences over them, worked out again for the forming bar with each batch."""
    stream = in_slices(B.event_ticks(table(spark, sf_dir, "events")), "stream-ticks")
    out = result(T.forming_bars(stream, _KERNELS, 3600), "stream-forming", "update", ("symbol", "t"))
    return shown(out, ["symbol", "t"], {c: c for c in _FORMED})


def stream_seeded_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the first two weeks are a batch whose last state begins the stream."""
    ticks = B.event_ticks(table(spark, sf_dir, "events"))
    day = F.lit(1705276800 + 1800)  # in the middle of an hour, so that a bar is begun by the batch and ended by the stream
    early = B.from_ticks(ticks.where(F.col("t") < day), "60").select("symbol", "t", *T.BAR)
    stream = in_slices(ticks.where(F.col("t") >= day), "stream-later")
    later = result(T.forming_bars(stream, _KERNELS, 3600, T.committed(early, _KERNELS)), "stream-seeded", "update", ("symbol", "t"))
    known = K.fold(early, _KERNELS).select(*later.columns).join(later.select("symbol", "t"), ["symbol", "t"], "left_anti")
    return shown(later.unionAll(known.select(*later.columns)), ["symbol", "t"], {c: c for c in _FORMED})


def stream_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the price did 1, 4 and 24 hours after each second's lowest tick, filled as ticks arrive. The stream is stopped after its first batches and goes on from its checkpoint."""
    t = B.event_ticks(table(spark, sf_dir, "events")).groupBy("symbol", "t").agg(F.min("price").alias("price"))
    stream = in_slices(t.withColumn("ts", F.timestamp_seconds("t")), "stream-prices")
    minutes = (60, 240, 1440)
    filled = result(T.forward_returns(stream, minutes, 30 * 86_400), "stream-forward", "append", stops=1)
    by = filled.groupBy("symbol", "t").agg(*[F.max(F.when(F.col("m") == m, F.col("ret"))).alias(f"ret_{m}") for m in minutes])
    return shown(t.join(by, ["symbol", "t"], "left"), ["symbol", "t"], {f"ret_{m}": f"ret_{m}" for m in minutes})


def stream_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes and their mean at each hour, by a stream of hours and a stream of complete days."""
    chart = hourly(spark, sf_dir)
    day = B.resample(chart, "D").withColumn("mean3", R.sma("close", 3))
    ends = F.coalesce(F.lead("t").over(Window.partitionBy("symbol").orderBy("t")), F.col("t") + 86_400)
    days = in_slices(day.select("symbol", ends.alias("at"), F.col("close").alias("off"), F.col("mean3").alias("off_mean")), "stream-days", "at")
    hours = in_slices(chart.select("symbol", "t", "close"), "stream-hours")
    out = result(T.refreshed(hours, days, ["off", "off_mean"]), "stream-security", "update", ("symbol", "t"))
    return shown(out, ["symbol", "t"], {c: c for c in ("off", "off_mean")})


def stream_recorded_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars that a recorder stores while ticks arrive up to 14 hours late, some of them twice."""
    ticks = B.event_ticks(table(spark, sf_dir, "events"))
    arrives = F.explode(F.array(F.col("t") + (F.col("seq") % 3) * 25_200, F.when(F.col("seq") % 4 == 0, F.col("t") + 3_600))).alias("arrived")
    feed = ticks.select("symbol", "t", "seq", "price", "volume", F.timestamp_seconds("t").alias("ts"), arrives).where("arrived is not null")
    path = new_path(spark, "recorded")
    stream = S.dedup(N.valid(in_slices(feed, "stream-feed", "arrived")), ["symbol", "seq"], "2 days")
    N.record(stream, path).option("checkpointLocation", new_path(spark, "recorder-state")).trigger(availableNow=True).start().awaitTermination()
    return shown(N.recorded(spark, path), ["symbol", "t"], {c: c for c in ("open", "high", "low", "close", "volume")})


def _inner(name: str) -> str:
    return _RECURRENCES[name]


QUERIES = {f.__name__: f for f in (stream_hourly_bars, stream_sliding_volume, stream_dedup, stream_averages, stream_forming_bars, stream_seeded_bars, stream_forward_returns, stream_security, stream_recorded_bars)}
SQL = {
    "stream_hourly_bars": f"WITH {BARS_SQL} SELECT symbol, t, {sql_shown({c: c for c in ('open', 'high', 'low', 'close', 'volume')})} FROM bars",
    "stream_sliding_volume": f"WITH k AS (SELECT event_type AS symbol, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 3600 * unnest([0, 1, 2]) AS t FROM events) SELECT symbol, t, {sql_shown({'volume': 'count(*)'})} FROM k GROUP BY 1, 2",
    "stream_dedup": f"SELECT DISTINCT event_type AS symbol, event_id AS seq, {sql_shown({'price': 'value'})} FROM events",
    "stream_averages": f"SELECT e.symbol, e.t, e.ema, w.rma FROM ({_inner('ta_exponential')}) e JOIN ({_inner('ta_wilder')}) w USING (symbol, t)",
    "stream_forming_bars": f"SELECT b.*, e.ema, w.rma, w.rsi, w.atr FROM (WITH {BARS_SQL} SELECT symbol, t, {sql_shown({c: c for c in ('open', 'high', 'low', 'close', 'volume')})} FROM bars) b JOIN ({_inner('ta_exponential')}) e USING (symbol, t) JOIN ({_inner('ta_wilder')}) w USING (symbol, t)",
    "stream_forward_returns": _ALIGNMENT["flow_forward_returns"],
    "stream_recorded_bars": f"SELECT event_type AS symbol, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS t, {sql_shown({'open': 'first(value ORDER BY floor(epoch(ts)), event_id)', 'high': 'max(value)', 'low': 'min(value)', 'close': 'last(value ORDER BY floor(epoch(ts)), event_id)', 'volume': 'count(*)'})} FROM events WHERE value > 0 GROUP BY 1, 2",
    "stream_security": f"SELECT symbol, t, off, off_mean FROM ({_ALIGNMENT['mtf_security']})",
}
SQL["stream_seeded_bars"] = SQL["stream_forming_bars"]
