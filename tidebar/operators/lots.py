"""Trades and account of any strategy of market orders: long, short or flat, added to and reduced in parts.

Positions are closed first in, first out. Count a symbol's contracts in the
order in which they are opened, over its whole history, and count those that
are closed in the same way: the k-th contract closed is the k-th opened,
whatever was flat or turned in between. So both counts are marks on one line,
and what lies between two neighbouring marks was opened by one order and closed
by one. Matching is thus one sort and two running values; no order book is
walked and no order is paired with all others.

Quantities are decimals of eight places, so counts are exact. Orders without a
price or quantity, or of quantity 0, are left out. A symbol's orders are one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.na import div

QTY = "decimal(20,8)"
_ALL = Window.unboundedPreceding

#: What a commission is charged for: a share of the value, each contract, or each order.
COMMISSIONS = {
    "percent": lambda value, qty, price: F.abs(qty).cast("double") * price * value / 100,
    "cash_per_contract": lambda value, qty, price: F.abs(qty).cast("double") * value,
    "cash_per_order": lambda value, qty, price: F.lit(float(value)),
}


def to_targets(bars: DataFrame, target: Column, commission: float = 0.0, commission_type: str = "percent") -> DataFrame:
    """Fills (symbol, i, seq, price, qty, commission) that bring the position to ``target`` at the next bar's opening.

    A target is a signed quantity, known at a bar's close; NULL keeps the
    position. What has no next bar is not filled.
    """
    by = Window.partitionBy("symbol").orderBy("i")
    known = bars.select("symbol", (F.col("i") + 1).alias("i"), F.lead("open").over(by).alias("price"), target.cast(QTY).alias("_to")).where("_to is not null and price is not null")
    f = known.withColumn("qty", (F.col("_to") - F.coalesce(F.lag("_to").over(by), F.lit(0))).cast(QTY)).where("qty <> 0")
    return f.select("symbol", "i", F.lit(0).alias("seq"), "price", "qty", COMMISSIONS[commission_type](commission, F.col("qty"), F.col("price")).alias("commission"))


def _counted(fills: DataFrame) -> DataFrame:
    """Adds to fills the position after them, and how much was opened and closed by them and up to them."""
    upto = Window.partitionBy("symbol").orderBy("i", "seq").rowsBetween(_ALL, 0)
    f = fills.withColumn("qty", F.col("qty").cast(QTY)).where("qty <> 0 and price is not null").withColumn("_after", F.sum("qty").over(upto))
    before = F.col("_after") - F.col("qty")
    turns = F.signum(before) * F.signum("qty") < 0
    f = f.withColumn("_closing", F.when(turns, F.least(F.abs(before), F.abs("qty"))).otherwise(F.lit(0)).cast(QTY)).withColumn("_opening", (F.abs("qty") - F.col("_closing")).cast(QTY))
    return f.withColumns({"_opened": F.sum("_opening").over(upto), "_closed": F.sum("_closing").over(upto)})


def _matched(counted: DataFrame) -> DataFrame:
    """Pieces (symbol, at, size, entry, exit) that one fill opened and one closed; exit is NULL while a piece is open."""
    paid = F.coalesce("commission", F.lit(0.0))
    entry = F.struct(F.col("_opened").alias("at"), "i", "price", F.signum("qty").cast("int").alias("dir"), F.col("_opening").alias("qty"), F.when(F.col("_closing") > 0, 0.0).otherwise(paid).alias("commission"))
    exit_ = F.struct("i", "price", F.col("_closing").alias("qty"), paid.alias("commission"))
    marks = F.array(F.struct(F.col("_opened").alias("at"), F.when(F.col("_opening") > 0, entry).alias("entry"), F.lit(None).alias("exit")), F.struct(F.col("_closed").alias("at"), F.lit(None).alias("entry"), F.when(F.col("_closing") > 0, exit_).alias("exit")))
    m = counted.select("symbol", F.explode(marks).alias("m")).select("symbol", "m.*").where("entry is not null or exit is not null")
    down = Window.partitionBy("symbol").orderBy(F.col("at").desc())
    nearest = down.rangeBetween(_ALL, 0)
    m = m.withColumns({"size": F.col("at") - F.coalesce(F.lead("at").over(down), F.lit(0)), "entry": F.last("entry", ignorenulls=True).over(nearest), "exit": F.last("exit", ignorenulls=True).over(nearest)})
    return m.where("size > 0").withColumns({"size": F.col("size").cast("double"), "_last": F.col("at") == F.col("entry.at")})


def _profits(pieces: DataFrame) -> DataFrame:
    """Adds a piece's gross profit and its share of the closing order's commission."""
    share = F.col("size") / F.col("exit.qty").cast("double")
    return pieces.withColumns({"_gross": (F.col("exit.price") - F.col("entry.price")) * F.col("entry.dir") * F.col("size"), "_paid": F.col("exit.commission") * share})


def trades(fills: DataFrame) -> DataFrame:
    """(symbol, n, dir, qty, entry_bar, entry_price, closed_qty, exit_bar, exit_price, profit, commission, open): one row for each order that opened contracts.

    n numbers a symbol's openings from 0. A trade is open until its last contract
    is closed; until then exit_bar, exit_price and profit tell of what has been
    closed, NULL if nothing has. The exit's price is the mean over its parts. A
    commission goes to the trades that its order closes, by quantity, or else to
    the one that it opens.
    """
    known = F.col("exit").isNotNull()
    legs = _profits(_matched(_counted(fills))).groupBy("symbol", "entry").agg(
        F.sum(F.when(known, F.col("size"))).alias("closed_qty"), F.max("exit.i").alias("exit_bar"), F.sum(F.col("size") * F.col("exit.price")).alias("_value"), F.sum("_gross").alias("_gross"), F.coalesce(F.sum("_paid"), F.lit(0.0)).alias("_paid"), F.max((~known).cast("int")).alias("_open")
    )
    paid = F.col("entry.commission") + F.col("_paid")
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("entry.at")) - 1
    return legs.select(
        "symbol", n.alias("n"), "entry.dir", F.col("entry.qty").cast("double").alias("qty"), F.col("entry.i").alias("entry_bar"), F.col("entry.price").alias("entry_price"), F.coalesce("closed_qty", F.lit(0.0)).alias("closed_qty"), "exit_bar",
        div(F.col("_value"), F.col("closed_qty")).alias("exit_price"), (F.col("_gross") - paid).alias("profit"), paid.alias("commission"), (F.col("_open") == 1).alias("open"),
    )


def account(bars: DataFrame, fills: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """The account at each bar's close, in the columns ``ACCOUNT``, beside symbol and i.

    Commissions are paid as they fall due; profits count as contracts are closed,
    trades once their last contract is. A bar without a close shows no open profit.
    Percentages are of the capital; that of the open profit is of capital and what
    has been realised.
    """
    counted = _counted(fills)
    leg = Window.partitionBy("symbol", "entry.at")
    p = _profits(_matched(counted))
    p = p.withColumn("_profit", F.sum("_gross").over(leg) - F.col("entry.commission") - F.coalesce(F.sum("_paid").over(leg), F.lit(0.0)))
    last, signed = F.col("_last").cast("int"), F.col("entry.dir") * F.col("size")
    done = lambda cond, x=1: F.when(F.col("_last") & cond, x).otherwise(0)
    result = F.col("_profit")
    begins = {"realized": F.when(F.col("_last"), -F.col("entry.commission")).otherwise(0.0), "position": signed, "cost": signed * F.col("entry.price"), "opentrades": last}
    ends = {"realized": F.col("_gross") - F.col("_paid"), "position": -signed, "cost": -signed * F.col("entry.price"), "opentrades": -last, "wintrades": done(result > 0), "losstrades": done(result < 0), "eventrades": done(result == 0), "grossprofit": done(result > 0, result), "grossloss": done(result < 0, -result)}
    one = lambda i, values: F.struct(i.alias("i"), *[F.coalesce(values.get(k, F.lit(0)).cast("decimal(30,8)" if k == "position" else "double"), F.lit(0)).alias(k) for k in ends])
    steps = p.select("symbol", F.explode(F.array(one(F.col("entry.i"), begins), one(F.col("exit.i"), ends))).alias("e")).select("symbol", "e.*").where("i is not null")
    held = counted.select("symbol", "i", F.col("_after").cast("double").alias("_held"))
    rows = bars.select("symbol", "i", "close", F.lit(True).alias("_bar")).unionByName(steps, True).unionByName(held, True)
    upto = Window.partitionBy("symbol").orderBy("i").rangeBetween(_ALL, 0)
    sums = {k: F.coalesce(F.sum(k).over(upto), F.lit(0)).cast("double") for k in ends}
    most = lambda x: F.greatest(F.lit(0.0), F.max(x).over(upto))
    a = rows.withColumns({**sums, "max_held": most(F.abs("_held")), "max_held_long": most(F.col("_held")), "max_held_short": most(-F.col("_held"))}).where("_bar")
    flat = F.col("position") == 0
    a = a.withColumns({"avg_price": F.when(~flat, F.col("cost") / F.col("position")), "open_profit": F.when(flat, 0.0).otherwise(F.coalesce(F.col("close") * F.col("position") - F.col("cost"), F.lit(0.0))), "closedtrades": F.col("wintrades") + F.col("losstrades") + F.col("eventrades"), "netprofit": F.col("grossprofit") - F.col("grossloss")})
    a = a.withColumn("equity", capital + F.col("realized") + F.col("open_profit")).withColumn("open_profit_percent", 100 * div(F.col("open_profit"), capital + F.col("realized")))
    a = a.withColumns({"_peak": F.max("equity").over(upto), "_trough": F.min("equity").over(upto)})
    a = a.withColumns({"max_drawdown": F.max(F.col("_peak") - F.col("equity")).over(upto), "max_runup": F.max(F.col("equity") - F.col("_trough")).over(upto)})
    of_capital = {f"{k}_percent": 100 * F.col(k) / capital for k in ("grossprofit", "grossloss", "netprofit", "max_drawdown", "max_runup")}
    return a.withColumns(of_capital).select("symbol", "i", *ACCOUNT)


#: The columns of an account.
ACCOUNT = (
    "equity", "position", "avg_price", "open_profit", "open_profit_percent", "opentrades", "closedtrades", "wintrades", "losstrades", "eventrades", "grossprofit", "grossloss", "netprofit",
    "grossprofit_percent", "grossloss_percent", "netprofit_percent", "max_drawdown", "max_runup", "max_drawdown_percent", "max_runup_percent", "max_held", "max_held_long", "max_held_short",
)
