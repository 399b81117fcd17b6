"""A recorder of bars: micro-batches of ticks are merged into stored bars, day by day.

A day's bars are a version, named by the batch that made it: day=D/upto=N. Batch
N reads the newest version before N of the days that it has ticks of, merges its
partial bars into it, and writes them as version N. A batch that is run again
after a failure reads the same versions and overwrites its own, so nothing counts
twice; what is there of earlier versions stays until a later batch has succeeded.
Late ticks open their day again. A bar keeps the order of its first and last tick,
so that merged bars open and close as if all ticks had come in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
_AT = "struct<t:bigint,seq:bigint>"
SCHEMA = f"symbol string, t bigint, open double, high double, low double, close double, volume double, opened {_AT}, closed {_AT}, day bigint, upto bigint"


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def valid(ticks: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Ticks with a symbol (that begins with one of the prefixes), a time and a positive price; trial trades (simtrade) are left out if there is such a column."""
    ticks = ticks.where(F.col("symbol").isNotNull() & F.col("t").isNotNull() & (F.col("price") > 0) & (F.col("price") < float("inf")))
    if "simtrade" in ticks.columns:
        ticks = ticks.where(~F.coalesce(F.col("simtrade").cast("boolean"), F.lit(False)))
    return ticks.where(F.col("symbol").rlike("^(" + "|".join(prefixes) + ")")) if prefixes else ticks


def _partial(ticks: DataFrame, size: int) -> DataFrame:
    at = F.struct(F.col("t").cast("long").alias("t"), F.col("seq").cast("long").alias("seq"))
    rows = ticks.select("symbol", (F.floor(F.col("t") / size) * size).alias("bar"), F.col("price").cast("double").alias("price"), F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"), at.alias("at"))
    bars = rows.groupBy("symbol", F.col("bar").alias("t")).agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("volume").alias("volume"), F.min("at").alias("opened"), F.max("at").alias("closed"))
    return bars.withColumn("day", F.floor(F.col("t") / DAY))


def stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest version of each day, of those before a batch if one is given; with the order of first and last ticks."""
    at, files = _path(spark, path)
    if not files.exists(at):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    rows = rows if before is None else rows.where(F.col("upto") < before)
    newest = rows.groupBy("day").agg(F.max("upto").alias("upto"))
    return rows.join(newest, ["day", "upto"])


def merge(batch: DataFrame, number: int, path: str, size: int = 60) -> None:
    """Merges a batch of ticks (symbol, t, seq, price, volume) into the stored bars."""
    spark = batch.sparkSession
    new = _partial(batch, size)
    old = stored(spark, path, number).drop("upto").join(new.select("day").distinct(), "day", "left_semi")
    both = old.unionByName(new).groupBy("symbol", "t", "day").agg(F.min_by("open", "opened").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "closed").alias("close"), F.sum("volume").alias("volume"), F.min("opened").alias("opened"), F.max("closed").alias("closed"))
    rows = both.withColumn("upto", F.lit(number).cast("long")).repartition("day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "upto").parquet(path)


def prune(spark: SparkSession, path: str, keep_days: int | None = None) -> None:
    """Deletes versions but the two newest of each day, and days that lie ``keep_days`` or more before the newest."""
    at, files = _path(spark, path)
    days = sorted((int(d.getPath().getName()[4:]), d.getPath()) for d in files.listStatus(at) if d.getPath().getName().startswith("day="))
    for day, folder in days:
        if keep_days is not None and day <= days[-1][0] - keep_days:
            files.delete(folder, True)
            continue
        versions = sorted((int(v.getPath().getName()[5:]), v.getPath()) for v in files.listStatus(folder) if v.getPath().getName().startswith("upto="))
        for _, version in versions[:-2]:
            files.delete(version, True)


def record(ticks: DataFrame, path: str, size: int = 60, keep_days: int | None = None):
    """A writer of a stream of ticks; give it a checkpoint and start it."""

    def write(batch: DataFrame, number: int) -> None:
        merge(batch, number, path, size)
        prune(batch.sparkSession, path, keep_days)

    return ticks.writeStream.foreachBatch(write).outputMode("append")


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The stored bars."""
    return stored(spark, path).select("symbol", "t", "open", "high", "low", "close", "volume")
