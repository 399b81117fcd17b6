"""The technical rating: 15 votes of moving averages and 11 of oscillators.

A vote is 1 (buy), 0 (neutral) or -1 (sell), and NULL while its inputs warm up.
Comparisons are those of the scripts (``functions/na.py``); crossings are exact.
A scan over blocks makes the recurrences; the rest are windows over bars of a symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.na import div, gt, lt, nz
from . import rolling as R
from . import scans as L
from .ranking import rating, rating_band

MEANS = (10, 20, 30, 50, 100, 200)
MA_VOTES = [f"vote_{kind}_{n}" for kind in ("sma", "ema") for n in MEANS] + ["vote_ichimoku", "vote_vwma", "vote_hma"]
OSC_VOTES = [f"vote_{x}" for x in ("rsi", "stoch", "cci", "adx", "ao", "mom", "macd", "stoch_rsi", "wpr", "bbp", "uo")]


def _vote(ready: Column, buy: Column, sell: Column) -> Column:
    return F.when(ready, F.when(buy, 1.0).when(sell, -1.0).otherwise(0.0))


def _known(*xs: Column) -> Column:
    return F.coalesce(*[F.when(x.isNull(), F.lit(False)) for x in xs], F.lit(True))


def with_inputs(bars: DataFrame) -> DataFrame:
    """Adds everything that the votes look at."""
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    b = L.evaluate(bars, [*(L.ema(f"ema_{n}", n) for n in (*MEANS, 13)), L.rsi("rsi", 14), L.dmi("di_plus", "di_minus", "adx", 14), L.macd("macd", "macd_signal", "_hist")]).drop("_hist")
    c1 = nz(R.ago("close"), c)
    b = b.withColumns({"_mid": (h + lo) / 2, "_hlc3": (h + lo + c) / 3, "_bp": c - F.least(lo, c1), "_tr": F.greatest(h, c1) - F.least(lo, c1)})
    middle = lambda n: (R.highest("high", n) + R.lowest("low", n)) / 2
    share = lambda n: div(R.sum_strict("_bp", n), R.sum_strict("_tr", n))
    b = R.with_hma(b, "close", 9, "hma").withColumns({
        **{f"sma_{n}": R.sma("close", n) for n in MEANS}, "vwma": R.vwma("close", 20), "conv": middle(9), "base": middle(26), "_lead2": middle(52),
        "_k0": R.stoch("close", "high", "low", 14), "_rk0": R.stoch("rsi", "rsi", "rsi", 14), "cci": R.cci("_hlc3", 20), "ao": R.sma("_mid", 5) - R.sma("_mid", 34), "mom": R.mom("close", 10),
        "wpr": R.wpr(14), "uo": 100 * (4 * share(7) + 2 * share(14) + share(28)) / 7, "bull": h - F.col("ema_13"), "bear": lo - F.col("ema_13"),
    })
    b = b.withColumns({"_lead1": (F.col("conv") + F.col("base")) / 2, "st_k": R.sma("_k0", 3), "sr_k": R.sma("_rk0", 3)})
    b = b.withColumns({"cloud_1": R.ago("_lead1", 25), "cloud_2": R.ago("_lead2", 25), "st_d": R.sma("st_k", 3), "sr_d": R.sma("sr_k", 3)})
    return b.drop("_mid", "_hlc3", "_bp", "_tr", "_lead1", "_lead2", "_k0", "_rk0")


def with_votes(bars: DataFrame) -> DataFrame:
    """Adds the 26 votes, their means ma and osc, the mean of both as all, and its band."""
    b = with_inputs(bars)
    x = {n: F.col(n) for n in b.columns}
    ago = {n: R.ago(n) for n in ("rsi", "st_d", "cci", "di_plus", "di_minus", "ao", "mom", "sr_d", "wpr", "bull", "bear")}
    c, trend = x["close"], x["sma_50"]
    up, down = gt(c, trend), lt(c, trend)
    votes = {f"vote_{m}": _vote(_known(x[m]), lt(x[m], c), gt(x[m], c)) for m in [v.removeprefix("vote_") for v in MA_VOTES] if m != "ichimoku"}
    votes["vote_ichimoku"] = _vote(
        _known(x["cloud_2"], x["base"]),
        lt(x["base"], c) & R.crossover("conv", "close") & gt(x["cloud_1"], c) & gt(x["cloud_1"], x["cloud_2"]),
        gt(x["base"], c) & R.crossunder("conv", "close") & lt(x["cloud_1"], c) & lt(x["cloud_1"], x["cloud_2"]),
    )

    def turns(n: str, low: float, high: float) -> Column:
        """Below low and rising, or above high and falling."""
        return _vote(_known(ago[n]), lt(x[n], F.lit(low)) & gt(x[n], ago[n]), gt(x[n], F.lit(high)) & lt(x[n], ago[n]))

    ao, ao1, ao2, zero = x["ao"], ago["ao"], R.ago("ao", 2), F.lit(0.0)
    votes |= {
        "vote_rsi": turns("rsi", 30.0, 70.0), "vote_cci": turns("cci", -100.0, 100.0), "vote_wpr": turns("wpr", -80.0, -20.0),
        "vote_stoch": _vote(_known(ago["st_d"]), lt(x["st_k"], F.lit(20.0)) & R.crossover("st_k", "st_d"), gt(x["st_k"], F.lit(80.0)) & R.crossunder("st_k", "st_d")),
        "vote_adx": _vote(
            _known(x["adx"], ago["di_plus"]),
            gt(x["adx"], F.lit(20.0)) & lt(ago["di_plus"], ago["di_minus"]) & gt(x["di_plus"], x["di_minus"]),
            gt(x["adx"], F.lit(20.0)) & gt(ago["di_plus"], ago["di_minus"]) & lt(x["di_plus"], x["di_minus"]),
        ),
        "vote_ao": _vote(
            _known(ao2),
            (gt(ao, zero) & gt(ao, ao1) & lt(ao1, ao2)) | F.coalesce((ao > 0) & (ao1 <= 0), F.lit(False)),
            (lt(ao, zero) & lt(ao, ao1) & gt(ao1, ao2)) | F.coalesce((ao < 0) & (ao1 >= 0), F.lit(False)),
        ),
        "vote_mom": _vote(_known(ago["mom"]), gt(x["mom"], ago["mom"]), lt(x["mom"], ago["mom"])),
        "vote_macd": _vote(_known(x["macd_signal"]), gt(x["macd"], x["macd_signal"]), lt(x["macd"], x["macd_signal"])),
        "vote_stoch_rsi": _vote(
            _known(ago["sr_d"], trend),
            down & lt(x["sr_k"], F.lit(20.0)) & lt(x["sr_d"], F.lit(20.0)) & R.crossover("sr_k", "sr_d"),
            up & gt(x["sr_k"], F.lit(80.0)) & gt(x["sr_d"], F.lit(80.0)) & R.crossunder("sr_k", "sr_d"),
        ),
        "vote_bbp": _vote(_known(ago["bear"], trend), up & lt(x["bear"], zero) & gt(x["bear"], ago["bear"]), down & gt(x["bull"], zero) & lt(x["bull"], ago["bull"])),
        "vote_uo": _vote(_known(x["uo"]), gt(x["uo"], F.lit(70.0)), lt(x["uo"], F.lit(30.0))),
    }
    b = b.select(*bars.columns, *[v.alias(n) for n, v in votes.items()])
    b = b.withColumns({"ma": rating([F.col(v) for v in MA_VOTES]), "osc": rating([F.col(v) for v in OSC_VOTES])})
    b = b.withColumn("all", (F.col("ma") + F.col("osc")) / 2)
    return b.withColumn("band", rating_band(F.col("all")))
