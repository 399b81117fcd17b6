"""What the queries share: their inputs, and how they show doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..operators import bars as B
from ..store import new_path as new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events, with their place i."""
    return B.indexed(B.from_ticks(B.event_ticks(table(spark, sf_dir, "events")), "60"))


def six(x: Column | str) -> Column:
    """Six decimals. Cut where values on a decimal grid have no ties, so that two engines agree."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x.cast("double") * 1e6 + 0.3178912) / 1e6


def shown(df: DataFrame, keys: list[str], values: dict[str, Column | str]) -> DataFrame:
    return df.select(*keys, *[six(v).alias(k) for k, v in values.items()])


def sql6(x: str) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 1e6 + 0.3178912) / 1e6"


def sql_shown(values: dict[str, str]) -> str:
    return ", ".join(f"{sql6(v)} AS {k}" for k, v in values.items())


#: Common table expressions of the hourly bars: bars, and b with the place i.
BARS_SQL = """bars AS (SELECT event_type AS symbol, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t, first(value ORDER BY ts, event_id, value) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id, value) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM bars)"""


def frame(n: int, upto: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND {upto})"


def sql_full(n: int, value: str, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {value} END"


def sql_lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY t)" if k else x


def sql_weighted(x: str, weights: list[float]) -> str:
    return "(" + " + ".join(f"{sql_lag(x, k)} * {w!r}" for k, w in enumerate(weights)) + ")"
