"""Trades of a strategy that is always long or short, by windows over its signals.

A signal (dir 1 or -1 on a bar) is filled at the next bar's opening and ends the
trade before it. Everything is ``lead``, ``lag`` and running sums in the order
of a symbol's bars: no order book is walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.na import div
from .align import asof


def reversal_trades(signals: DataFrame, qty: float = 1.0, commission: float = 0.0) -> DataFrame:
    """(symbol, n, dir, qty, entry_bar, entry_price, exit_bar, exit_price, profit, commission) of bars with dir; the last trade of a symbol is open and has no exit.

    ``commission`` is charged for each contract of an order: one for the first
    entry, and both of a reversal to the trade that it closes.
    """
    by = Window.partitionBy("symbol").orderBy("i")
    filled = signals.withColumn("entry_price", F.lead("open").over(by)).where("dir is not null and entry_price is not null")
    turned = filled.withColumn("_before", F.lag("dir").over(by)).where(~F.col("_before").eqNullSafe(F.col("dir")))
    t = turned.select("symbol", "i", F.col("dir").cast("int").alias("dir"), F.lit(qty).alias("qty"), (F.col("i") + 1).alias("entry_bar"), "entry_price", F.row_number().over(by).alias("n"), (F.lead("i").over(by) + 1).alias("exit_bar"), F.lead("entry_price").over(by).alias("exit_price"))
    paid = commission * F.col("qty") * (2 + (F.col("n") == 1).cast("int"))
    gross = (F.col("exit_price") - F.col("entry_price")) * F.col("dir") * F.col("qty")
    return t.drop("i").withColumns({"commission": paid, "profit": gross - paid})


def reversal_equity(bars: DataFrame, trades: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Adds to bars equity, position, avg_price, open_profit, and what has been reached so far: max_drawdown, max_runup, max_held."""
    earlier = Window.partitionBy("symbol").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    held = trades.withColumn("_won", F.coalesce(F.sum("profit").over(earlier), F.lit(0.0)))
    b = asof(bars, held, F.col("i"), F.col("entry_bar"), F.struct("entry_price", "dir", "qty", "_won"), "_in", ["symbol"])
    position = F.coalesce(F.col("_in.dir") * F.col("_in.qty"), F.lit(0.0))
    b = b.withColumns({"position": position, "avg_price": F.col("_in.entry_price"), "open_profit": F.coalesce((F.col("close") - F.col("_in.entry_price")) * position, F.lit(0.0))})
    b = b.withColumn("equity", capital + F.coalesce(F.col("_in._won"), F.lit(0.0)) + F.col("open_profit")).drop("_in")
    upto = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({"_peak": F.greatest(F.lit(capital), F.max("equity").over(upto)), "_trough": F.least(F.lit(capital), F.min("equity").over(upto))})
    b = b.withColumns({"max_drawdown": F.max(F.col("_peak") - F.col("equity")).over(upto), "max_runup": F.max(F.col("equity") - F.col("_trough")).over(upto), "max_held": F.max(F.abs("position")).over(upto)})
    return b.drop("_peak", "_trough")


def statistics(trades: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Totals and means of each symbol's closed trades."""
    p, share = F.col("profit"), 100 * div(F.col("profit"), F.col("entry_price") * F.col("qty"))
    won, lost = p > 0, p < 0
    return trades.where("exit_bar is not null").groupBy("symbol").agg(
        F.count("*").alias("closedtrades"), F.count(F.when(won, 1)).alias("wintrades"), F.count(F.when(lost, 1)).alias("losstrades"), F.count(F.when(p == 0, 1)).alias("eventrades"),
        F.coalesce(F.sum(F.when(won, p)), F.lit(0.0)).alias("grossprofit"), F.coalesce(-F.sum(F.when(lost, p)), F.lit(0.0)).alias("grossloss"), F.sum(p).alias("netprofit"), (100 * F.sum(p) / capital).alias("netprofit_percent"),
        F.avg(p).alias("avg_trade"), F.avg(share).alias("avg_trade_percent"), F.avg(F.when(won, p)).alias("avg_winning_trade"), F.avg(F.when(lost, p)).alias("avg_losing_trade"), F.avg(F.when(won, share)).alias("avg_winning_trade_percent"), F.avg(F.when(lost, share)).alias("avg_losing_trade_percent"),
    )
