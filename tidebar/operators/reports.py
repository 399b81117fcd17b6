"""Summaries of trades and decisions, live profit, pages of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed limits of the readiness gate.
LEAST_APPROVED, LEAST_FLAGGED = 20, 10


def live_profit(side: Column, entry: Column, snapshot: Column, profit: Column, bid: Column, ask: Column) -> Column:
    """A snapshot's profit scaled to the live price: bid for a long position, ask for a short one.

    Without a live price, or where the snapshot stands at the entry, the snapshot's profit stays.
    """
    live, moved = F.when(side == "LONG", bid).otherwise(ask), F.coalesce(snapshot, entry) - entry
    return F.when(live.isNull() | (F.abs(moved) < 1e-12), profit).otherwise(F.try_divide(profit, moved) * (live - entry))


def guard_readiness(decisions: DataFrame) -> DataFrame:
    """One row over decisions (verdict, pnl) whose profit is known: counts and loss rates of approved and flagged ones, and whether the guard may go live."""
    known = decisions.where("pnl is not null")
    approved, lost = F.col("verdict") == 0, (F.col("pnl") < 0).cast("double")
    out = known.agg(F.count(F.when(approved, 1)).alias("approved"), F.count(F.when(~approved, 1)).alias("flagged"), F.avg(F.when(approved, lost)).alias("approved_loss"), F.avg(F.when(~approved, lost)).alias("flagged_loss"))
    ready = (F.col("approved") >= LEAST_APPROVED) & (F.col("flagged") >= LEAST_FLAGGED) & (F.col("flagged_loss") > F.col("approved_loss"))
    return out.withColumn("ready", F.coalesce(ready, F.lit(False)))


def session_split(trades: DataFrame, session: Column, volatile: Column) -> DataFrame:
    """Trades (points, lots) by session and group: number, share of winners, mean points of one lot, and points as sized."""
    group = F.when(volatile, "volatile").otherwise("normal").alias("group")
    return trades.groupBy(session.alias("session"), group).agg(
        F.count("*").alias("n"), F.avg((F.col("points") > 0).cast("double")).alias("win_rate"), F.avg("points").alias("avg_points"), F.sum(F.col("points") * F.coalesce("lots", F.lit(1.0))).alias("sized_points")
    )


def measurement(rows: DataFrame, choice: str, confidence: str, outcome: str) -> DataFrame:
    """Per choice: how often, its share, mean confidence, how many have an outcome, and the outcomes' mean and sum."""
    total = F.sum(F.count("*")).over(Window.partitionBy(F.lit(1)))
    return rows.groupBy(F.col(choice).alias("choice")).agg(
        F.count("*").alias("n"), F.try_divide(F.count("*"), total).alias("share"), F.avg(confidence).alias("confidence"), F.count(outcome).alias("covered"), F.avg(outcome).alias("outcome"), F.sum(outcome).alias("total")
    )


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(field, changed, rows): in how many rows that both tables have each field differs, NULL being a value of its own."""
    both = old.select(*keys, *[F.col(f).alias(f"_old_{f}") for f in fields]).join(new.select(*keys, *fields), keys)
    counts = both.agg(F.count("*").alias("rows"), *[F.count(F.when(~F.col(f"_old_{f}").eqNullSafe(F.col(f)), 1)).alias(f) for f in fields])
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("changed")) for f in fields])).alias("x")
    return counts.select("rows", one).select("x.field", "x.changed", "rows")


def page(df: DataFrame, order: list[str], number: int, size: int) -> tuple[DataFrame, int]:
    """The rows of a page (from 1) in an order, and how many rows there are in all."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size), df.count()
