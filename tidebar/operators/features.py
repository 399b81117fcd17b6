"""Feature sets over bars: the chart's own indicators, pandas-like last values, order-flow features, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.na import div
from . import rolling as R
from . import scans as L


def chart(bars: DataFrame) -> DataFrame:
    """Adds the chart's variants: bands, a stochastic that is 50 when flat, a true range mean without the first bar, a volume-weighted mean that never resets and counts no volume as 1."""
    basis, upper, lower = R.bb("close", 20, 2.0)
    hh, ll = R.highest("high", 14), R.lowest("low", 14)
    h3, v = (F.col("high") + F.col("low") + F.col("close")) / 3, F.when(F.col("volume") > 0, F.col("volume")).otherwise(1.0)
    return bars.withColumns({
        "bb_basis": basis, "bb_upper": upper, "bb_lower": lower, "stoch_k": F.when(hh == ll, 50.0).otherwise(100 * div(F.col("close") - ll, hh - ll)),
        "tr_mean": F.when(F.count(F.lit(1)).over(R.back(15)) == 15, F.avg("true_range").over(R.back(14))),
        "vwap": F.sum(h3 * v).over(R.so_far()) / F.sum(v).over(R.so_far()),
    })


def last_values(bars: DataFrame) -> DataFrame:
    """(symbol, features) from windows, of each symbol's last bar: Ichimoku base, momentum, Williams %R, awesome and ultimate oscillators, bull and bear power against a plain mean. A short form that SQL checks; the pandas-like set is :func:`pandas_values`."""
    h, lo, c, c1 = F.col("high"), F.col("low"), F.col("close"), R.ago("close")
    mid = (h + lo) / 2
    pressed, span = c - F.least(lo, c1), F.greatest(h, c1) - F.least(lo, c1)
    bars = bars.withColumns({"_mid": mid, "_bp": F.when(c1.isNotNull(), pressed), "_tr": F.when(c1.isNotNull(), span)})
    share = lambda n: div(F.sum("_bp").over(R.back(n)), F.sum("_tr").over(R.back(n)))
    bars = bars.withColumns({
        "ichimoku_base": (R.highest("high", 26) + R.lowest("low", 26)) / 2, "momentum": R.mom("close", 10), "williams_r": R.wpr(14), "awesome": R.sma("_mid", 5) - R.sma("_mid", 34),
        "ultimate": R.full("_bp", 28, 100 * (4 * share(7) + 2 * share(14) + share(28)) / 7), "bull": h - R.sma("close", 13), "bear": lo - R.sma("close", 13), "sma_10": R.sma("close", 10), "sma_50": R.sma("close", 50),
    })
    names = ["ichimoku_base", "momentum", "williams_r", "awesome", "ultimate", "bull", "bear", "sma_10", "sma_50"]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*names), "t").alias("x")).select("symbol", "x.*")


#: Features of :func:`pandas_values`, by name.
PANDAS = [f"{kind}_{n}" for n in (10, 20, 30, 50, 100, 200) for kind in ("ema", "sma")] + [
    "ichimoku_base", "vwma_20", "hull_9", "rsi_14", "stoch_k", "cci_20", "atr_14", "adx_14", "macd", "signal", "stoch_rsi", "williams_r", "awesome", "momentum_10", "bull_bear_power", "ultimate",
]


def with_pandas_values(bars: DataFrame) -> DataFrame:
    """Adds the features of ``PANDAS`` at each bar, with ewm(adjust=False) and rolling(n) as pandas has them: exponential means begin with the first value, stay hidden for ``least`` values and are held by NULL."""
    h, lo, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    d, h1, l1, first = R.change("close"), R.ago("high"), R.ago("low"), R.ago("close").isNull()
    up, down = h - h1, l1 - lo
    low1 = F.when(first, lo).otherwise(F.least(lo, R.ago("close")))
    b = bars.withColumns({
        "_gain": F.greatest(d, F.lit(0.0)) + 0 * d, "_loss": F.greatest(-d, F.lit(0.0)) + 0 * d, "_true": R.tr(), "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "_bp": c - low1, "_mid": (h + lo) / 2, "_typical": (h + lo + c) / 3, "_v": F.coalesce(v, F.lit(0.0)),
    })
    b = b.withColumns({"_half": R.wma("close", 4), "_whole": R.wma("close", 9)}).withColumn("_hull", 2 * F.col("_half") - F.col("_whole"))
    hidden = {f"ema_{n}": (2 / (n + 1), n, "close") for n in (10, 20, 30, 50, 100, 200)} | {"_fast": (2 / 13, 26, "close"), "_slow": (2 / 27, 26, "close"), "_ema_13": (2 / 14, 13, "close")}
    hidden |= {f"_w{x}": (1 / 14, 14, x) for x in ("_gain", "_loss", "_true", "_plus", "_minus")}
    b = L.evaluate(b, [L.ewm(name, a, n, x) for name, (a, n, x) in hidden.items()])
    b = b.withColumns({"macd": F.col("_fast") - F.col("_slow"), "_pdi": div(100 * F.col("_w_plus"), F.col("_w_true")), "_mdi": div(100 * F.col("_w_minus"), F.col("_w_true")), "atr_14": F.col("_w_true")})
    gain, loss = F.col("_w_gain"), F.col("_w_loss")
    b = b.withColumns({"_dx": 100 * div(F.abs(F.col("_pdi") - F.col("_mdi")), F.col("_pdi") + F.col("_mdi")), "rsi_14": F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + div(gain, loss)))})
    b = L.evaluate(b, [L.ewm("signal", 2 / 10, 9, "macd"), L.ewm("adx_14", 1 / 14, 14, "_dx")])
    share = lambda n: div(R.sum_strict("_bp", n), R.sum_strict("_true", n))
    b = b.withColumns({
        **{f"sma_{n}": R.sma("close", n) for n in (10, 20, 30, 50, 100, 200)}, "ichimoku_base": (R.highest("high", 26) + R.lowest("low", 26)) / 2, "vwma_20": R.vwma("close", 20, "_v"), "hull_9": R.wma("_hull", 3),
        "_k": R.stoch("close", "high", "low", 14), "_rk": R.stoch("rsi_14", "rsi_14", "rsi_14", 14), "cci_20": R.cci("_typical", 20), "williams_r": R.wpr(14), "awesome": R.sma("_mid", 5) - R.sma("_mid", 34),
        "momentum_10": R.mom("close", 10), "bull_bear_power": h + lo - 2 * F.col("_ema_13"), "ultimate": 100 * (4 * share(7) + 2 * share(14) + share(28)) / 7,
    })
    b = b.withColumns({"stoch_k": R.sma("_k", 3), "stoch_rsi": R.sma("_rk", 3)})
    return b.select(*bars.columns, *PANDAS)


def pandas_values(bars: DataFrame) -> DataFrame:
    """(symbol, features of ``PANDAS``) of each symbol's last bar."""
    return with_pandas_values(bars).groupBy("symbol").agg(F.max_by(F.struct(*PANDAS), "t").alias("x")).select("symbol", "x.*")


def large_bars(bars: DataFrame, factor: float = 2.0, n: int = 30) -> DataFrame:
    """Adds large (volume over ``factor`` times the upper median of the 20 bars before), counts of the last n large bars by direction, the running streak and the last large direction."""
    before = F.array_sort(F.collect_list("volume").over(Window.partitionBy("symbol").orderBy("t").rowsBetween(-20, -1)))
    middle = F.get(before, F.floor(F.size(before) / 2).cast("int"))
    bars = bars.withColumn("large", F.coalesce(F.col("volume") > factor * middle, F.lit(False)))
    way = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0)
    bars = bars.withColumn("_way", F.when(F.col("large"), way)).withColumn("_breaks", F.sum((~F.col("large")).cast("int")).over(R.so_far()))
    run = Window.partitionBy("symbol", "_breaks").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumns({
        "n_large": F.sum(F.col("large").cast("int")).over(R.back(n)), "n_up": F.count(F.when(F.col("_way") > 0, 1)).over(R.back(n)), "n_down": F.count(F.when(F.col("_way") < 0, 1)).over(R.back(n)),
        "streak": F.sum(F.col("large").cast("int")).over(run), "last_way": F.last("_way", ignorenulls=True).over(R.so_far()),
    }).drop("_way", "_breaks")


def event_report(events: DataFrame, n: int = 20) -> DataFrame:
    """The n codes with most events: how many, buys, sells, net amount, mean forward return. What doesn't go up is a sale."""
    one = events.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(F.col("dir") > 0, 1)).alias("buys"), F.count(F.when(F.col("dir") > 0, None).otherwise(1)).alias("sells"), F.sum(F.when(F.col("dir") > 0, F.col("amount")).otherwise(-F.col("amount"))).alias("net"), F.avg("ret").alias("ret"))
    return one.orderBy(F.col("n").desc(), "symbol").limit(n)


def equity(positions: DataFrame, prices: DataFrame, leverage: float = 100.0) -> DataFrame:
    """Per account: balance of open positions (account, symbol, side, qty, entry) at last prices (symbol, price): unrealised profit, margin and notional."""
    both = positions.join(prices, "symbol")
    profit = F.when(F.col("side") == "LONG", F.col("price") - F.col("entry")).otherwise(F.col("entry") - F.col("price")) * F.col("qty")
    return both.groupBy("account").agg(F.sum(profit).alias("unrealized"), F.sum(F.col("price") * F.col("qty") / leverage).alias("margin"), F.sum(F.col("price") * F.col("qty")).alias("notional"))


def closed_summary(closed: DataFrame, begin=None, end=None) -> DataFrame:
    """Profit, commission and number of trades closed within [begin, end], by account, with share of winners and profit factor."""
    if begin is not None:
        closed = closed.where(F.col("closed") >= begin)
    if end is not None:
        closed = closed.where(F.col("closed") <= end)
    p = F.col("pnl")
    won, lost = F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))
    return closed.groupBy("account").agg(F.sum("pnl").alias("pnl"), F.sum("commission").alias("commission"), F.count("*").alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), div(won, lost).alias("profit_factor"))


def account_statistics(closed: DataFrame) -> DataFrame:
    """By account, over closed trades (account, closed, id, pnl): their number, win_rate, avg_win and avg_loss (without sign), profit_factor, best and worst, sharpe (mean over sample deviation of a trade, not annualised), max_drawdown and expectancy.

    The drawdown is the greatest fall of the sum of profits, which starts at 0, in the
    order of closed and id. A trade of 0 is neither won nor lost. What divides by
    nothing is NULL; so are means of no trades. Trades without a profit are left out.
    """
    p, order = F.col("pnl"), Window.partitionBy("account").orderBy("closed", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = closed.where("pnl is not null").withColumn("_sum", F.sum("pnl").over(order))
    run = run.withColumn("_fall", F.greatest(F.lit(0.0), F.max("_sum").over(order)) - F.col("_sum"))
    won, lost = F.when(p > 0, p), F.when(p < 0, -p)
    out = run.groupBy("account").agg(
        F.count("*").alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(won).alias("avg_win"), F.avg(lost).alias("avg_loss"), div(F.sum(won), F.sum(lost)).alias("profit_factor"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"),
        div(F.avg("pnl"), F.stddev_samp("pnl")).alias("sharpe"), F.max("_fall").alias("max_drawdown"), F.avg((p < 0).cast("double")).alias("_lost"),
    )
    expected = F.col("win_rate") * F.coalesce("avg_win", F.lit(0.0)) - F.col("_lost") * F.coalesce("avg_loss", F.lit(0.0))
    return out.withColumn("expectancy", expected).drop("_lost")


def decisions_with_outcomes(decisions: DataFrame, fills: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Guard decisions with the profit of what they opened: outcomes are summed by (symbol, opened); a decision knows its opening, or its order's fill does."""
    total = outcomes.groupBy("symbol", "opened").agg(F.sum("pnl").alias("pnl"))
    both = decisions.join(fills.select("order_id", F.col("opened").alias("_filled")), "order_id", "left").withColumn("opened", F.coalesce("opened", "_filled")).drop("_filled")
    return both.join(total, ["symbol", "opened"], "left")
