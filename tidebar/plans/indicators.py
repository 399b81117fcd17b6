"""Rolling and cumulative indicators over hourly bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.na import div
from ..operators import bars as B
from ..operators import rolling as R
from .common import BARS_SQL, frame, hourly, shown, sql6, sql_full, sql_lag, sql_shown, sql_weighted, table

KEYS = ["symbol", "t"]


def bars_from_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to hourly bars."""
    return shown(B.from_ticks(B.event_ticks(table(spark, sf_dir, "events")), "60"), KEYS, {c: c for c in ("open", "high", "low", "close", "volume")})


_OHLCV = {c: c for c in ("open", "high", "low", "close", "volume")}


def bars_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars to 4 hours, days, weeks, two weeks, months and quarters."""
    base = hourly(spark, sf_dir)
    out = None
    for tf in ("4H", "D", "W", "2W", "M", "3M"):
        one = shown(B.resample(base, tf).withColumn("tf", F.lit(tf)), ["tf", *KEYS], _OHLCV)
        out = one if out is None else out.unionAll(one)
    return out


_BUCKETS = {
    "4H": "t - t % 14400", "D": "t - t % 86400", "W": "((t // 86400 + 3) // 7 * 7 - 3) * 86400", "2W": "((t // 86400 + 3) // 14 * 14 - 3) * 86400",
    "M": "CAST(epoch(date_trunc('month', to_timestamp(t) AT TIME ZONE 'UTC')) AS BIGINT)", "3M": "CAST(epoch(date_trunc('quarter', to_timestamp(t) AT TIME ZONE 'UTC')) AS BIGINT)",
}
_RESAMPLE = " UNION ALL ".join(f"SELECT '{tf}' AS tf, symbol, {e} AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2, 3" for tf, e in _BUCKETS.items())


def bars_lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of line items to daily bars with real volume, and their volume-weighted price."""
    ticks = B.lineitem_ticks(table(spark, sf_dir, "lineitem"))
    return shown(B.from_ticks(ticks, "D"), KEYS, _OHLCV)


def ta_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sma wma hma vwma swma alma linreg."""
    b = R.with_hma(hourly(spark, sf_dir), "close", 9, "hma")
    return shown(b, KEYS, {"sma": R.sma("close", 10), "wma": R.wma("close", 10), "hma": "hma", "vwma": R.vwma("close", 10), "swma": R.swma("close"), "alma": R.alma("close", 9, 0.85, 6), "alma_floor": R.alma("close", 9, 0.85, 6, True), "linreg": R.linreg("close", 14), "linreg_2": R.linreg("close", 14, 2)})


def _alma(floored: bool) -> str:
    m = 0.85 * 8
    m = math.floor(m) if floored else m
    w = [math.exp(-((8 - k - m) ** 2) / (2 * 1.5**2)) for k in range(9)]
    return sql_weighted("close", [x / sum(w) for x in w])


def _wma_sql(x: str, n: int) -> str:
    return sql_weighted(x, [(n - k) / (n * (n + 1) / 2) for k in range(n)])


def _regression_sql(n: int, at: int) -> str:
    """Intercept and slope of the last n closes over 0 (newest) to n - 1."""
    y, mean = f"avg(close) OVER {frame(n)}", (n - 1) / 2
    sxy = "(" + " + ".join(f"{k - mean!r} * {sql_lag('close', k)}" for k in range(n)) + ")"
    return f"{y} + ({sxy}) / {sum((k - mean) ** 2 for k in range(n))!r} * ({at - mean!r})"


def ta_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stdev variance bb bbw highest lowest highestbars lowestbars."""
    basis, upper, lower = R.bb("close", 20, 2.0)
    return shown(hourly(spark, sf_dir), KEYS, {
        "stdev": R.stdev("close", 20), "stdev_sample": R.stdev("close", 20, False), "variance": R.variance("close", 20), "variance_sample": R.variance("close", 20, False),
        "bb_basis": basis, "bb_upper": upper, "bb_lower": lower, "bbw": R.bbw("close", 20, 2.0), "highest": R.highest("high", 12), "lowest": R.lowest("low", 12),
        "highestbars": R.highestbars("high", 12), "lowestbars": R.lowestbars("low", 12),
    })


_F20, _F12 = frame(20), frame(12)
_BANDS = {
    "stdev": sql_full(20, f"stddev_pop(close) OVER {_F20}"), "stdev_sample": sql_full(20, f"stddev_samp(close) OVER {_F20}"),
    "variance": sql_full(20, f"var_pop(close) OVER {_F20}"), "variance_sample": sql_full(20, f"var_samp(close) OVER {_F20}"),
    "bb_basis": sql_full(20, f"avg(close) OVER {_F20}"), "bb_upper": sql_full(20, f"avg(close) OVER {_F20} + 2 * stddev_pop(close) OVER {_F20}"), "bb_lower": sql_full(20, f"avg(close) OVER {_F20} - 2 * stddev_pop(close) OVER {_F20}"),
    "bbw": sql_full(20, f"4 * stddev_pop(close) OVER {_F20} / nullif(avg(close) OVER {_F20}, 0)"), "highest": sql_full(12, f"max(high) OVER {_F12}", "high"), "lowest": sql_full(12, f"min(low) OVER {_F12}", "low"),
    "highestbars": sql_full(12, f"struct_extract(max({{'x': high, 'i': i}}) OVER {_F12}, 'i') - i", "high"),
    "lowestbars": sql_full(12, f"struct_extract(max({{'x': -low, 'i': i}}) OVER {_F12}, 'i') - i", "low"),
}


def ta_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change mom roc cross crossover crossunder tr rising falling."""
    b = R.with_moves(hourly(spark, sf_dir)).withColumn("mean", R.sma("close", 5))
    flag = lambda c: c.cast("int")
    return shown(b, KEYS, {
        "change": R.change("close"), "change_5": R.change("close", 5), "mom": R.mom("close", 10), "roc": R.roc("close", 10), "cross": flag(R.cross("close", "mean")), "crossover": flag(R.crossover("close", "mean")),
        "crossunder": flag(R.crossunder("close", "mean")), "tr": R.tr(), "tr_bare": R.tr(False), "rising": flag(R.rising("moved", 2)), "falling": flag(R.falling("moved", 2)),
    })


_L = sql_lag
_TR = f"greatest(high - low, abs(high - {_L('close')}), abs(low - {_L('close')}))"
_MOVES = {
    "change": f"close - {_L('close')}", "change_5": f"close - {_L('close', 5)}", "mom": f"close - {_L('close', 10)}", "roc": f"100 * (close - {_L('close', 10)}) / nullif({_L('close', 10)}, 0)",
    "cross": f"coalesce(((close > mean AND {_L('close')} <= {_L('mean')}) OR (close < mean AND {_L('close')} >= {_L('mean')}))::INT, 0)", "crossover": f"coalesce((close > mean AND {_L('close')} <= {_L('mean')})::INT, 0)", "crossunder": f"coalesce((close < mean AND {_L('close')} >= {_L('mean')})::INT, 0)",
    "tr": f"CASE WHEN {_L('close')} IS NULL THEN high - low ELSE {_TR} END", "tr_bare": f"CASE WHEN {_L('close')} IS NOT NULL THEN {_TR} END",
    "rising": f"coalesce((close > {_L('close')} AND {_L('close')} > {_L('close', 2)})::INT, 0)", "falling": f"coalesce((close < {_L('close')} AND {_L('close')} < {_L('close', 2)})::INT, 0)",
}


def ta_oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cmo mfi vortex cci cog wpr stoch kcW nadarayaWatsonEnvelope."""
    b = R.with_moves(hourly(spark, sf_dir))
    vi_up, vi_down = R.vortex(14)
    kc = R.kc_wma("close", 10, 1.5)
    nw = R.nadaraya_watson("close", 8, 8, 10)
    return shown(b, KEYS, {
        "cmo": R.cmo(9), "mfi": R.mfi(14), "vi_up": vi_up, "vi_down": vi_down, "cci": R.cci("close", 10), "cog": R.cog("close", 10), "wpr": R.wpr(14), "stoch": R.stoch("close", "high", "low", 14),
        "kc_basis": kc[0], "kc_upper": kc[1], "kc_lower": kc[2], "nw_upper": nw[0], "nw_lower": nw[1],
    })


def _sum(x: str, n: int) -> str:
    return f"sum({x}) OVER {frame(n)}"


_F10, _F14 = frame(10), frame(14)
_P1 = f"({_L('high')} + {_L('low')} + {_L('close')}) / 3"
_NW = [(1 + k * k / (2 * 8 * 64)) ** -8 for k in range(10)]
_NW = [w / sum(_NW) for w in _NW]
_OSC_BASE = f"""m AS (SELECT *, close - {_L('close')} AS d, (high + low + close) / 3 AS p, {_P1} AS p1, abs(high - {_L('low')}) AS vu, abs(low - {_L('high')}) AS vd, {_MOVES['tr']} AS tr FROM b),
n AS (SELECT *, {sql_weighted('close', _NW)} AS nw FROM m)"""
_MAD = f"list_sum(list_transform(array_agg(close) OVER {_F10}, lambda x: abs(x - mean10))) / 10"
_OSC = {
    "cmo": f"CASE WHEN count(d) OVER {frame(9)} = 9 THEN coalesce(100 * (sum(greatest(d, 0)) OVER {frame(9)} - sum(greatest(-d, 0)) OVER {frame(9)}) / nullif(sum(abs(d)) OVER {frame(9)}, 0), 0) END",
    "mfi": f"CASE WHEN count(p1) OVER {_F14} = 14 THEN CASE WHEN sum(CASE WHEN p < p1 THEN p * volume ELSE 0 END) OVER {_F14} = 0 THEN CASE WHEN sum(CASE WHEN p > p1 THEN p * volume ELSE 0 END) OVER {_F14} <> 0 THEN 100 END ELSE 100 - 100 / (1 + sum(CASE WHEN p > p1 THEN p * volume ELSE 0 END) OVER {_F14} / sum(CASE WHEN p < p1 THEN p * volume ELSE 0 END) OVER {_F14}) END END",
    "vi_up": f"CASE WHEN count(vu) OVER {_F14} = 14 THEN {_sum('vu', 14)} / nullif({_sum('tr', 14)}, 0) END", "vi_down": f"CASE WHEN count(vu) OVER {_F14} = 14 THEN {_sum('vd', 14)} / nullif({_sum('tr', 14)}, 0) END",
    "cci": f"CASE WHEN count(close) OVER {_F10} = 10 THEN (close - mean10) / nullif(0.015 * ({_MAD}), 0) END", "cog": f"-{sql_weighted('close', [float(k + 1) for k in range(10)])} / nullif({sql_weighted('close', [1.0] * 10)}, 0)",
    "wpr": sql_full(14, f"-100 * (max(high) OVER {_F14} - close) / nullif(max(high) OVER {_F14} - min(low) OVER {_F14}, 0)"), "stoch": sql_full(14, f"100 * (close - min(low) OVER {_F14}) / nullif(max(high) OVER {_F14} - min(low) OVER {_F14}, 0)"),
    "kc_basis": _wma_sql("close", 10), "kc_upper": f"{_wma_sql('close', 10)} + 1.5 * {_wma_sql('tr', 10)}", "kc_lower": f"{_wma_sql('close', 10)} - 1.5 * {_wma_sql('tr', 10)}",
    "nw_upper": "nw + (" + " + ".join(f"abs({_L('close', k)} - nw)" for k in range(10)) + ") / 10", "nw_lower": "nw - (" + " + ".join(f"abs({_L('close', k)} - nw)" for k in range(10)) + ") / 10",
}


def ta_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dev median mode percentile_linear_interpolation percentile_nearest_rank percentrank range rci correlation."""
    b = hourly(spark, sf_dir).withColumn("whole", F.floor("close"))
    return shown(b, KEYS, {
        "dev": R.dev("close", 10), "median_9": R.median("close", 9), "median_10": R.median("close", 10), "mode": R.mode("whole", 10), "percentile_linear": R.percentile_linear_interpolation("close", 10, 30), "percentile_nearest": R.percentile_nearest_rank("close", 10, 30),
        "percentrank": R.percentrank("close", 10), "range": R.range_("close", 8), "rci": R.rci("close", 9), "correlation": R.correlation("close", "volume", 12),
    })


_F9 = frame(9)
_STATS = {
    "dev": sql_full(10, _MAD), "median_9": sql_full(9, f"list_sort(array_agg(close) OVER {_F9})[5]"), "median_10": sql_full(10, f"(list_sort(array_agg(close) OVER {_F10})[5] + list_sort(array_agg(close) OVER {_F10})[6]) / 2"),
    "mode": sql_full(10, f"list_reduce(list_transform(list_reverse(array_agg(floor(close)) OVER {_F10}), lambda v: {{'n': len(list_filter(array_agg(floor(close)) OVER {_F10}, lambda y: y = v)), 'v': v}}), lambda a, x: CASE WHEN x.n > a.n THEN x ELSE a END).v"),
    "percentile_linear": sql_full(10, f"list_sort(array_agg(close) OVER {_F10})[3] + (list_sort(array_agg(close) OVER {_F10})[4] - list_sort(array_agg(close) OVER {_F10})[3]) * 0.7"),
    "percentile_nearest": sql_full(10, f"list_sort(array_agg(close) OVER {_F10})[3]"), "percentrank": f"CASE WHEN i >= 10 THEN len(list_filter(array_agg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), lambda x: x <= close)) * 10.0 END",
    "range": sql_full(8, f"max(close) OVER {frame(8)} - min(close) OVER {frame(8)}"),
    "rci": "CASE WHEN i >= 9 THEN rci END", "correlation": sql_full(12, f"corr(close, volume) OVER {frame(12)}"),
}
_RCI = f"""r0 AS (SELECT *, avg(close) OVER {_F10} AS mean10, array_agg(close) OVER {_F9} AS w9 FROM b),
r1 AS (SELECT *, list_transform(w9, lambda v: len(list_filter(w9, lambda y: y < v)) + (len(list_filter(w9, lambda y: y = v)) + 1) / 2.0) AS ranks FROM r0),
r AS (SELECT *, 100 * list_sum(list_transform(range(1, len(ranks) + 1), lambda k: (k - 5) * (ranks[k] - 5))) / nullif(sqrt(60.0 * list_sum(list_transform(ranks, lambda x: (x - 5) * (x - 5)))), 0) AS rci FROM r1)"""


def ta_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cum sum math.sum obv pvt wad accdist iii wvad max min barssince valuewhen fixnan."""
    h, lo, c, o, v = (F.col(x) for x in ("high", "low", "close", "open", "volume"))
    b = R.with_moves(hourly(spark, sf_dir)).withColumn("holed", F.when(F.col("i") % 7 != 3, c))
    b = R.with_cum(b, "holed", "cum")
    big = F.coalesce(F.col("volume") > 3, F.lit(False))
    return shown(b, KEYS, {
        "cum": "cum", "sum_loose": R.sum_loose("holed", 10), "sum_strict": R.sum_strict("holed", 5), "obv": R.running("obv_step"), "pvt": R.running("pvt_step"), "wad": R.running("wad_step"), "accdist": R.running("accdist_step"),
        "iii": F.when(h == lo, 0.0).otherwise(div(2 * c - h - lo, h - lo) * v), "wvad": F.when(h == lo, 0.0).otherwise(div(c - o, h - lo) * v), "max": R.running_max("close"), "min": R.running_min("close"),
        "barssince": R.barssince(big), "valuewhen_0": R.valuewhen(big, "close"), "valuewhen_2": R.valuewhen(big, "close", 2), "fixnan": R.fixnan("holed"),
    })


_UP = "(PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
_RUN_BASE = f"""m AS (SELECT *, {_L('close')} AS c1, {_L('volume')} AS v1, CASE WHEN i % 7 <> 3 THEN close END AS holed FROM b),
n AS (SELECT *, sum((holed IS NULL)::INT) OVER {_UP} AS gap, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END AS ad,
  CASE WHEN c1 IS NULL THEN 0 WHEN close > c1 THEN close - least(low, c1) WHEN close < c1 THEN close - greatest(high, c1) ELSE 0 END AS wd, CASE WHEN volume > 3 THEN close END AS big FROM m)"""
_RUN = {
    "cum": "CASE WHEN holed IS NOT NULL THEN sum(holed) OVER (PARTITION BY symbol, gap ORDER BY t ROWS UNBOUNDED PRECEDING) END", "sum_loose": f"sum(coalesce(holed, 0)) OVER {_F10}", "sum_strict": sql_full(5, f"sum(holed) OVER {frame(5)}", "holed"),
    "obv": f"sum(sign(close - c1) * volume) OVER {_UP}", "pvt": f"sum((close - c1) / nullif(c1, 0) * volume) OVER {_UP}", "wad": f"sum(wd) OVER {_UP}", "accdist": f"sum(ad) OVER {_UP}",
    "iii": "CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) * volume END", "wvad": "CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) * volume END", "max": f"max(close) OVER {_UP}", "min": f"min(close) OVER {_UP}",
    "barssince": f"i - max(CASE WHEN volume > 3 THEN i END) OVER {_UP}", "valuewhen_0": f"last_value(big IGNORE NULLS) OVER {_UP}", "valuewhen_2": f"list_filter(array_agg(big) OVER {_UP}, lambda x: x IS NOT NULL)[-3]", "fixnan": f"last_value(holed IGNORE NULLS) OVER {_UP}",
}


def ta_pivots_and_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pivothigh pivotlow vwap with bands, anchored to the day."""
    b = B.with_prices(hourly(spark, sf_dir))
    day = F.floor(F.col("t") / 86400)
    b = R.with_segment(b, F.coalesce(day != F.lag(day).over(R.by()), F.lit(True)))
    mean, upper, lower = R.vwap("hlc3", mult=2.0)
    return shown(b, KEYS, {"pivothigh": R.pivot("high", 3, 2), "pivotlow": R.pivot("low", 3, 2, False), "vwap": mean, "vwap_upper": upper, "vwap_lower": lower})


_DAY = "(PARTITION BY symbol, t // 86400 ORDER BY t ROWS UNBOUNDED PRECEDING)"
_VW = f"(sum(p * volume) OVER {_DAY} / sum(volume) OVER {_DAY})"
_VSD = f"sqrt(greatest(0, sum(p * p * volume) OVER {_DAY} / sum(volume) OVER {_DAY} - {_VW} * {_VW}))"


def _pivot_sql(x: str, f: str, sign: str) -> str:
    c = _L(x, 2)
    side = lambda a, z: f"{f}({x}) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {a} PRECEDING AND {z})"
    return f"CASE WHEN count({x}) OVER {frame(6)} = 6 AND {c} {sign} {side(5, '3 PRECEDING')} AND {c} {sign} {side(1, 'CURRENT ROW')} THEN {c} END"


_PIV = {"pivothigh": _pivot_sql("high", "max", ">"), "pivotlow": _pivot_sql("low", "min", "<"), "vwap": _VW, "vwap_upper": f"{_VW} + 2 * {_VSD}", "vwap_lower": f"{_VW} - 2 * {_VSD}"}


def ta_pivot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven pivot levels of six kinds for each day, from the day before."""
    b, out = hourly(spark, sf_dir), None
    for kind in ("Traditional", "Fibonacci", "Woodie", "Classic", "DM", "Camarilla"):
        one = R.pivot_point_levels(b, kind, "D").select(F.lit(kind).alias("kind"), "symbol", "period", F.posexplode("levels").alias("level", "value"))
        out = one if out is None else out.unionAll(one)
    return shown(out.where("value is not null"), ["kind", "symbol", "period", "level"], {"value": "value"})


_LEVELS = {
    "Traditional": ["p", "2 * p - l", "2 * p - h", "p + s", "p - s", *[e for k in (2, 3, 4) for e in (f"p * {k} + (h - {k} * l)", f"p * {k} - ({k} * h - l)")]],
    "Fibonacci": ["p", *[f"p {o} {k} * s" for k in (0.382, 0.618, 1) for o in "+-"]],
    "Woodie": ["w", "2 * w - l", "2 * w - h", "w + s", "w - s", "h + 2 * (w - l)", "l - 2 * (h - w)", "h + 2 * (w - l) + s", "l - 2 * (h - w) - s"],
    "Classic": ["p", "2 * p - l", "2 * p - h", *[f"p {o} {k} * s" for k in (1, 2, 3) for o in "+-"]],
    "DM": ["x / 4", "x / 2 - l", "x / 2 - h"],
    "Camarilla": ["p", *[f"c {o} s * 1.1 / {k}" for k in (12, 6, 4, 2) for o in "+-"], "h / nullif(l, 0) * c", "c - (h / nullif(l, 0) * c - c)"],
}
_LEVEL_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, symbol, period, {i} AS level, {sql6(e)} AS value FROM q WHERE {e} IS NOT NULL" for kind, es in _LEVELS.items() for i, e in enumerate(es))

_WITH = f"WITH {BARS_SQL}"
QUERIES = {f.__name__: f for f in (bars_from_ticks, bars_resample, bars_lineitem_daily, ta_averages, ta_bands, ta_moves, ta_oscillators, ta_order_statistics, ta_running, ta_pivots_and_vwap, ta_pivot_levels)}
SQL = {
    "bars_from_ticks": f"{_WITH} SELECT symbol, t, {sql_shown(_OHLCV)} FROM bars",
    "bars_resample": f"{_WITH} SELECT tf, symbol, t, {sql_shown(_OHLCV)} FROM ({_RESAMPLE})",
    "bars_lineitem_daily": f"SELECT symbol, t, {sql_shown(_OHLCV)} FROM (SELECT l_returnflag || l_linestatus AS symbol, CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) AS t, first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber, l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber, l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)",
    "ta_averages": f"{_WITH}, h AS (SELECT *, 2 * {_wma_sql('close', 4)} - {_wma_sql('close', 9)} AS raw FROM b) SELECT symbol, t, " + sql_shown({"sma": sql_full(10, f"avg(close) OVER {_F10}"), "wma": _wma_sql("close", 10), "hma": _wma_sql("raw", 3), "vwma": sql_full(10, f"sum(close * volume) OVER {_F10} / nullif(sum(volume) OVER {_F10}, 0)"), "swma": sql_weighted("close", [1 / 6, 2 / 6, 2 / 6, 1 / 6]), "alma": _alma(False), "alma_floor": _alma(True), "linreg": sql_full(14, _regression_sql(14, 0)), "linreg_2": sql_full(14, _regression_sql(14, 2))}) + " FROM h",
    "ta_bands": f"{_WITH} SELECT symbol, t, {sql_shown(_BANDS)} FROM b",
    "ta_moves": f"{_WITH}, m AS (SELECT *, {sql_full(5, f'avg(close) OVER {frame(5)}')} AS mean FROM b) SELECT symbol, t, {sql_shown(_MOVES)} FROM m",
    "ta_oscillators": f"{_WITH}, {_OSC_BASE}, o AS (SELECT *, avg(close) OVER {_F10} AS mean10 FROM n) SELECT symbol, t, {sql_shown(_OSC)} FROM o",
    "ta_order_statistics": f"{_WITH}, {_RCI} SELECT symbol, t, {sql_shown(_STATS)} FROM r",
    "ta_running": f"{_WITH}, {_RUN_BASE} SELECT symbol, t, {sql_shown(_RUN)} FROM n",
    "ta_pivots_and_vwap": f"{_WITH}, n AS (SELECT *, (high + low + close) / 3 AS p FROM b) SELECT symbol, t, {sql_shown(_PIV)} FROM n",
    "ta_pivot_levels": f"{_WITH}, d AS (SELECT symbol, t - t % 86400 AS period, first(open ORDER BY t) AS o, max(high) AS hh, min(low) AS ll, last(close ORDER BY t) AS cc FROM bars GROUP BY 1, 2), e AS (SELECT symbol, period, lag(hh) OVER y AS h, lag(ll) OVER y AS l, lag(cc) OVER y AS c, lag(o) OVER y AS o1, o FROM d WINDOW y AS (PARTITION BY symbol ORDER BY period)), q AS (SELECT *, h - l AS s, (h + l + c) / 3 AS p, (h + l + 2 * o) / 4 AS w, CASE WHEN c < o1 THEN h + 2 * l + c WHEN c > o1 THEN 2 * h + l + c ELSE h + l + 2 * c END AS x FROM e) {_LEVEL_SQL}",
}
