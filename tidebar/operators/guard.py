"""Rules on an order before it is placed, as columns; the most severe verdict holds.

An intent is a row with its account's state beside it: side (BUY or SELL), type
(LIMIT, STOP, MARKET), price, last, stop_loss, take_profit, quantity, whole
(lots are whole), day_pnl, loss_streak, minutes_since_loss, opposite_open,
same_losing. The account's state comes from :func:`account_state`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed limits.
LEAST_REWARD_RISK, DAILY_LOSS, MOST_LOSSES, COOLDOWN_MINUTES = 1.5, 500.0, 3, 5.0
APPROVE, REDUCE, VETO = 0, 1, 2
_c = F.col


def entry_price() -> Column:
    """Where the order would fill: a limit never worse than the market."""
    level, buy = F.coalesce(_c("price"), _c("last")), _c("side") == "BUY"
    better = F.when(buy, F.least(level, _c("last"))).otherwise(F.greatest(level, _c("last")))
    return F.when(_c("price").isNull(), _c("last")).when((_c("type") == "LIMIT") & (_c("last") > 0), better).otherwise(level)


def rules() -> dict[str, Column]:
    """Severity of each rule: 0, 1 or 2."""
    e, stop, target, buy = entry_price(), _c("stop_loss"), _c("take_profit"), _c("side") == "BUY"
    veto = lambda x: F.when(F.coalesce(x, F.lit(False)), VETO).otherwise(APPROVE)
    reward = F.when(buy, target - e).otherwise(e - target)
    known = stop.isNotNull() & (e > 0)
    return {
        "stop_required": veto(stop.isNull() | (stop <= 0)),
        "stop_side": veto(known & ~F.when(buy, stop < e).otherwise(stop > e)),
        "reward_risk": veto(known & target.isNotNull() & ((reward <= 0) | (F.try_divide(reward, F.abs(e - stop)) < LEAST_REWARD_RISK))),
        "daily_loss": veto(_c("day_pnl") <= -DAILY_LOSS),
        "loss_streak": F.when(_c("loss_streak") >= MOST_LOSSES, VETO).when(_c("loss_streak") == MOST_LOSSES - 1, REDUCE).otherwise(APPROVE),
        "cooldown_after_loss": veto(_c("minutes_since_loss") < COOLDOWN_MINUTES),
        "opposite_side": veto(_c("opposite_open")),
        "average_down": veto(_c("same_losing")),
    }


def check(intents: DataFrame) -> DataFrame:
    """Adds hits (names of rules), verdict and the quantity that may be traded."""
    found = rules()
    worst = F.greatest(*found.values())
    hits = F.filter(F.array(*[F.when(v > APPROVE, F.lit(k)) for k, v in found.items()]), lambda x: x.isNotNull())
    halved = F.when(_c("whole"), F.greatest(F.lit(1.0), F.floor(_c("quantity") / 2).cast("double"))).otherwise(_c("quantity") / 2)
    return intents.withColumns({"hits": hits, "verdict": worst, "allowed": F.when(worst == REDUCE, halved).otherwise(_c("quantity"))})


def stop_change(side: Column, old: Column, new: Column) -> Column:
    """Name of the broken rule for moving a stop: it may tighten or be set, not widen or vanish."""
    wider = F.when(side == "LONG", new < old).otherwise(new > old)
    return F.when(new <= 0, "stop_invalid").when(new.isNull() & old.isNotNull(), "stop_removed").when(wider, "stop_widen")


def loss_streaks(closed: DataFrame) -> DataFrame:
    """(account, day, loss_streak): losing trades in a row at the end of a day; partial closes of one opening are one trade."""
    trades = closed.groupBy("account", "day", "symbol", "opened").agg(F.sum("pnl").alias("pnl"), F.max("closed").alias("closed"))
    newest = Window.partitionBy("account", "day").orderBy(F.col("closed").desc(), "symbol", "opened")
    won = F.sum((F.col("pnl") >= 0).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return trades.withColumn("_won", won).groupBy("account", "day").agg(F.count(F.when(F.col("_won") == 0, 1)).alias("loss_streak"))


def summary(decisions: DataFrame) -> DataFrame:
    """Per rule: decisions it touched, share of losers among them, and their profit."""
    one = decisions.select(F.explode(F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array(F.lit("none")))).alias("rule"), "pnl")
    return one.groupBy("rule").agg(F.count("*").alias("n"), F.avg((F.col("pnl") < 0).cast("double")).alias("loss_rate"), F.sum("pnl").alias("pnl"))


def summary_by_group(decisions: DataFrame) -> DataFrame:
    """Per group of decisions (verdict, hits, pnl) whose profit is known: how many, their loss rate, their profit.

    A decision is in the group of approved (verdict 0) or flagged ones, and in one for each of its hits; a rule that hit
    twice counts twice. Null hits are none.
    """
    verdict = F.when(F.col("verdict") == 0, "approve").otherwise("flagged")
    rules = F.transform(F.filter(F.coalesce("hits", F.array().cast("array<string>")), lambda h: h.isNotNull() & (h != "")), lambda h: F.concat(F.lit("rule:"), h))
    one = decisions.where("pnl is not null and verdict is not null").select(F.explode(F.concat(F.array(verdict), rules)).alias("group"), "pnl")
    return one.groupBy("group").agg(F.count("*").alias("n"), F.avg((F.col("pnl") < 0).cast("double")).alias("loss_rate"), F.sum("pnl").alias("pnl"))
