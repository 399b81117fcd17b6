"""Recurrences over hourly bars. Their SQL walks the bars of each symbol in a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import folds as K
from ..operators import scans as L
from ..store import written
from .common import BARS_SQL, hourly, shown, sql_shown, table

KEYS = ["symbol", "t"]
_SINCE = 1705276800
_HLC = ("high", "low", "close")


def _shown(df: DataFrame, names: list[str]) -> DataFrame:
    return shown(df, KEYS, {n: n for n in names})


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_ticks(B.event_ticks(table(spark, sf_dir, "events")), "60")


def ta_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ema macd tsi kc kcw."""
    names = ["ema", "macd", "macd_signal", "macd_hist", "tsi", "kc_basis", "kc_upper", "kc_lower", "kcw"]
    return _shown(L.evaluate(_bars(spark, sf_dir), [L.ema(names[0], 10), L.macd(*names[1:4], 12, 26, 9), L.tsi(names[4], 13, 25), L.keltner(*names[5:], 20, 2.0)]), names)


def ta_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rma rsi atr dmi."""
    names = ["rma", "rsi", "atr", "plus_di", "minus_di", "adx"]
    return _shown(L.evaluate(_bars(spark, sf_dir), [L.rma(names[0], 10), L.rsi(names[1], 14), L.atr(names[2], 14), L.dmi(*names[3:], 14, 10)]), names)


def ta_state_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supertrend sar fisher, and the logarithms of nvi and pvi."""
    kernels = [
        (["supertrend", "direction"], lambda: K.Supertrend(3.0, 10), list(_HLC)),
        (["sar"], lambda: K.Sar(), ["high", "low"]),
        (["fisher", "fisher_before"], lambda: K.Fisher(9), ["close"]),
        (["nvi"], lambda: K.VolumeIndex(True), ["close", "volume"]),
        (["pvi"], lambda: K.VolumeIndex(False), ["close", "volume"]),
    ]
    out = K.fold(hourly(spark, sf_dir), kernels, keep=KEYS)
    out = out.withColumns({n: F.ln(n) for n in ("nvi", "pvi")})
    return _shown(out, [n for names, _, _ in kernels for n in names])


def ta_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last confirmed zigzag pivot."""
    return _shown(K.fold(hourly(spark, sf_dir), [(["pivot", "pivot_direction"], lambda: K.ZigZag(20.0, 3), ["high", "low"])], keep=KEYS), ["pivot", "pivot_direction"])


def chart_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart's exponential average, which starts with a mean, and pandas-like exponential means."""
    names = ["chart_ema", "ewm_span", "ewm_wilder"]
    return _shown(L.evaluate(_bars(spark, sf_dir), [L.seeded_ema(names[0], 10), L.ewm(names[1], 2 / 21, 20), L.ewm(names[2], 1 / 14, 14)]), names)


def ta_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages stored for an earlier version of the bars, mended where late and rewritten ticks have changed them; recomputed tells which bars were worked out anew."""
    ticks = B.event_ticks(table(spark, sf_dir, "events"))
    recurrences = [r for x in (L.ema("ema", 10), L.rma("rma", 10)) for r in x.first]
    # of one symbol some ticks had not come yet, of another one some prices were others
    late = (F.col("symbol") == "click") & (F.col("t") > _SINCE) & (F.col("seq") % 97 == 0)
    wrong = (F.col("symbol") == "view") & (F.col("t") > _SINCE + 86_400) & (F.col("seq") % 89 == 0)
    before = B.from_ticks(ticks.where(~late).withColumn("price", F.when(wrong, F.col("price") + 1000).otherwise(F.col("price"))), "60")
    stored = written(L.scan(before, recurrences), "stored-averages")
    out = L.corrected(stored, B.from_ticks(ticks, "60"), recurrences, ["open", "high", "low", "close", "volume"])
    return shown(out, [*KEYS, "recomputed"], {"ema": "ema", "rma": "rma"})


def _walk(source: str, first: dict[str, str], step: dict[str, str]) -> str:
    """A recursive query r over ``source`` x with place i: columns start as ``first`` and go on as ``step`` of the row before, p."""
    names = ", ".join(first)
    return f"r(symbol, t, i, {names}) AS (SELECT symbol, t, i, {', '.join(f'CAST({e} AS DOUBLE)' for e in first.values())} FROM {source} x WHERE i = 0 UNION ALL SELECT x.symbol, x.t, x.i, {', '.join(f'CAST({e} AS DOUBLE)' for e in step.values())} FROM r p JOIN {source} x ON x.symbol = p.symbol AND x.i = p.i + 1)"


def _ema(name: str, n: int, x: str) -> str:
    a = 2 / (n + 1)
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN p.{name} IS NULL THEN {x} ELSE {a!r} * ({x}) + {1 - a!r} * p.{name} END"


def _rma(name: str, n: int, x: str, mean: str) -> str:
    return f"CASE WHEN ({x}) IS NULL OR x.i < {n - 1} THEN NULL WHEN p.{name} IS NULL THEN {mean} ELSE ({x}) / {n}.0 + {1 - 1 / n!r} * p.{name} END"


_Y = "OVER (PARTITION BY symbol ORDER BY t)"
_SRC = f"""s0 AS (SELECT *, lag(close) {_Y} AS c1, lag(high) {_Y} AS h1, lag(low) {_Y} AS l1, lag(high, 2) {_Y} AS h2, lag(low, 2) {_Y} AS l2, lag(volume) {_Y} AS v1 FROM b),
s1 AS (SELECT *, close - c1 AS d, CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS g, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS l, CASE WHEN c1 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr,
  CASE WHEN h1 IS NOT NULL THEN CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0 END END AS dp, CASE WHEN h1 IS NOT NULL THEN CASE WHEN l1 - low > high - h1 AND l1 > low THEN l1 - low ELSE 0 END END AS dm FROM s0)"""


def _mean(x: str, n: int) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {n} THEN avg({x}) {f} END"


_MEANS = f"s AS (SELECT *, {_mean('close', 10)} AS m10, {_mean('g', 14)} AS mg, {_mean('l', 14)} AS ml, {_mean('tr', 14)} AS mtr, {_mean('tr', 10)} AS mtr10, {_mean('dp', 14)} AS mdp, {_mean('dm', 14)} AS mdm, max(close) OVER f9 AS hi9, min(close) OVER f9 AS lo9, {_mean('close', 9)} IS NOT NULL AS has9 FROM s1 WINDOW f9 AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)), sm AS MATERIALIZED (SELECT * FROM s)"
_WITH = f"WITH RECURSIVE {BARS_SQL}, {_SRC}, {_MEANS}"

_EXP_FIRST = {"ema": "close", "f": "close", "s": "close", "g": "0", "n1": "NULL", "n2": "NULL", "d1": "NULL", "d2": "NULL", "kb": "close", "kr": "tr"}
_F, _S = _ema("f", 12, "x.close"), _ema("s", 26, "x.close")
_N1, _D1 = _ema("n1", 25, "x.d"), _ema("d1", 25, "abs(x.d)")
_EXP_STEP = {"ema": _ema("ema", 10, "x.close"), "f": _F, "s": _S, "g": _ema("g", 9, f"({_F}) - ({_S})"), "n1": _N1, "n2": _ema("n2", 13, _N1), "d1": _D1, "d2": _ema("d2", 13, _D1), "kb": _ema("kb", 20, "x.close"), "kr": _ema("kr", 20, "x.tr")}
_EXP_OUT = {"ema": "ema", "macd": "f - s", "macd_signal": "g", "macd_hist": "f - s - g", "tsi": "100 * n2 / nullif(d2, 0)", "kc_basis": "kb", "kc_upper": "kb + 2 * kr", "kc_lower": "kb - 2 * kr", "kcw": "CASE WHEN kb = 0 THEN 0 ELSE 4 * kr / kb END"}

_T, _P, _M = (_rma(a, 14, f"x.{b}", f"x.m{b}") for a, b in (("t_", "tr"), ("p_", "dp"), ("m_", "dm")))
_W_FIRST = {"rma": "NULL", "gg": "NULL", "ll": "NULL", "t_": "NULL", "p_": "NULL", "m_": "NULL"}
_W_STEP = {"rma": _rma("rma", 10, "x.close", "x.m10"), "gg": _rma("gg", 14, "x.g", "x.mg"), "ll": _rma("ll", 14, "x.l", "x.ml"), "t_": _T, "p_": _P, "m_": _M}
_DX = "dx AS (SELECT *, CASE WHEN t_ IS NOT NULL AND p_ IS NOT NULL AND m_ IS NOT NULL THEN CASE WHEN t_ = 0 OR p_ + m_ = 0 THEN 0 ELSE 100 * abs(p_ - m_) / (p_ + m_) END END AS dx FROM r), dy AS MATERIALIZED (SELECT *, " + _mean("dx", 10) + " AS mdx FROM dx)"
_ADX = f"a(symbol, t, i, rma, gg, ll, t_, p_, m_, adx) AS (SELECT symbol, t, i, rma, gg, ll, t_, p_, m_, CAST(NULL AS DOUBLE) FROM dy WHERE i = 0 UNION ALL SELECT x.symbol, x.t, x.i, x.rma, x.gg, x.ll, x.t_, x.p_, x.m_, {_rma('adx', 10, 'x.dx', 'x.mdx')} FROM a p JOIN dy x ON x.symbol = p.symbol AND x.i = p.i + 1)"
_W_OUT = {"rma": "rma", "rsi": "CASE WHEN gg = 0 AND ll = 0 THEN NULL WHEN ll = 0 THEN 100 ELSE 100 - 100 / (1 + gg / ll) END", "atr": "t_", "plus_di": "CASE WHEN m_ IS NOT NULL THEN CASE WHEN t_ = 0 THEN 0 ELSE 100 * p_ / t_ END END", "minus_di": "CASE WHEN m_ IS NOT NULL THEN CASE WHEN t_ = 0 THEN 0 ELSE 100 * m_ / t_ END END", "adx": "adx"}

# One state at a time: later ones read what earlier common tables have made.
_ATR10 = _rma("atr", 10, "x.tr", "x.mtr10")
_ST1 = _walk("sm", {"atr": "NULL"}, {"atr": _ATR10}).replace("r(symbol", "ra(symbol").replace("FROM r p", "FROM ra p")
_SMA = "sa AS MATERIALIZED (SELECT sm.*, ra.atr, lag(ra.atr) OVER (PARTITION BY sm.symbol ORDER BY sm.t) AS atr1 FROM sm JOIN ra USING (symbol, t))"
_UP = "CASE WHEN x.atr IS NULL THEN p.up WHEN p.up IS NOT NULL AND x.c1 >= p.up THEN greatest((x.high + x.low) / 2 - 3 * x.atr, p.up) ELSE (x.high + x.low) / 2 - 3 * x.atr END"
_DN = "CASE WHEN x.atr IS NULL THEN p.dn WHEN p.dn IS NOT NULL AND x.c1 <= p.dn THEN least((x.high + x.low) / 2 + 3 * x.atr, p.dn) ELSE (x.high + x.low) / 2 + 3 * x.atr END"
_DIR = f"CASE WHEN x.atr IS NULL THEN p.dir WHEN x.atr1 IS NULL OR p.dir IS NULL THEN 1 WHEN p.dir = 1 THEN CASE WHEN x.close > ({_DN}) THEN -1 ELSE 1 END ELSE CASE WHEN x.close < ({_UP}) THEN 1 ELSE -1 END END"
_RAW = "(p.sar + p.af * (p.ep - p.sar))"
_CAP = f"CASE WHEN p.rise = 1 THEN least({_RAW}, x.l1, coalesce(x.l2, x.l1)) ELSE greatest({_RAW}, x.h1, coalesce(x.h2, x.h1)) END"
_TURN = f"CASE WHEN p.rise = 1 THEN x.low < ({_CAP}) ELSE x.high > ({_CAP}) END"
_NEWEXT = "CASE WHEN p.rise = 1 THEN x.high > p.ep ELSE x.low < p.ep END"
_V = "CASE WHEN NOT x.has9 THEN p.v WHEN x.hi9 = x.lo9 THEN 0 ELSE 0.66 * ((x.close - x.lo9) / (x.hi9 - x.lo9) - 0.5) + 0.67 * p.v END"
_VC = f"CASE WHEN ({_V}) > 0.99 THEN 0.999 WHEN ({_V}) < -0.99 THEN -0.999 ELSE {_V} END"
_SM_FIRST = {"up": "NULL", "dn": "NULL", "dir": "NULL", "sar": "low", "ep": "high", "af": "0.02", "rise": "1", "v": "0", "f": "0", "fb": "NULL", "nvi": "NULL", "pvi": "NULL"}
_SM_STEP = {
    "up": _UP, "dn": _DN, "dir": _DIR, "sar": f"CASE WHEN {_TURN} THEN p.ep ELSE {_CAP} END", "ep": f"CASE WHEN {_TURN} THEN CASE WHEN p.rise = 1 THEN x.low ELSE x.high END WHEN {_NEWEXT} THEN CASE WHEN p.rise = 1 THEN x.high ELSE x.low END ELSE p.ep END",
    "af": f"CASE WHEN {_TURN} THEN 0.02 WHEN {_NEWEXT} THEN least(p.af + 0.02, 0.2) ELSE p.af END", "rise": f"CASE WHEN {_TURN} THEN 1 - p.rise ELSE p.rise END",
    "v": _VC, "f": f"CASE WHEN x.has9 THEN 0.5 * ln((1 + ({_VC})) / (1 - ({_VC}))) + 0.5 * p.f ELSE p.f END", "fb": "CASE WHEN x.has9 THEN p.f END",
    "nvi": "CASE WHEN x.c1 = 0 THEN p.nvi WHEN x.volume < x.v1 THEN coalesce(p.nvi, 1000) * (1 + (x.close - x.c1) / x.c1) ELSE coalesce(p.nvi, 1000) END", "pvi": "CASE WHEN x.c1 = 0 THEN p.pvi WHEN x.volume > x.v1 THEN coalesce(p.pvi, 1000) * (1 + (x.close - x.c1) / x.c1) ELSE coalesce(p.pvi, 1000) END",
}
_SM_OUT = {"supertrend": "CASE WHEN atr IS NOT NULL THEN CASE WHEN dir = -1 THEN up ELSE dn END END", "direction": "CASE WHEN atr IS NOT NULL THEN dir END", "sar": "sar", "fisher": "CASE WHEN has9 THEN f END", "fisher_before": "fb", "nvi": "ln(nvi)", "pvi": "ln(pvi)"}

_CH_FIRST = {"seeded": "NULL", "e1": "close", "e2": "close"}
_CH_STEP = {"seeded": f"CASE WHEN x.i < 9 THEN NULL WHEN x.i = 9 THEN x.m10 ELSE x.close * {2 / 11!r} + p.seeded * {1 - 2 / 11!r} END", "e1": f"{2 / 21!r} * x.close + {1 - 2 / 21!r} * p.e1", "e2": f"{1 / 14!r} * x.close + {1 - 1 / 14!r} * p.e2"}

# The running high and the lowest low since it (ls), the running low and the highest high since it (hs), each with its bar.
_ZF = {"dir": "0", "hi": "high", "hib": "0", "lo": "low", "lob": "0", "ls": "low", "lsb": "0", "hs": "high", "hsb": "0", "pv": "NULL", "pd": "NULL"}
_ZZ = """z1 AS (SELECT x.symbol, x.t, x.i, x.high, x.low, p.* EXCLUDE (symbol, t, i), p.dir >= 0 AND x.high > p.hi AS newhi, p.dir <= 0 AND x.low < p.lo AS newlo FROM r p JOIN b x ON x.symbol = p.symbol AND x.i = p.i + 1),
z2 AS (SELECT *, CASE WHEN newhi THEN high ELSE hi END AS hi2, CASE WHEN newhi THEN i ELSE hib END AS hib2, CASE WHEN newlo THEN low ELSE lo END AS lo2, CASE WHEN newlo THEN i ELSE lob END AS lob2,
  newhi OR (dir >= 0 AND low < ls) AS setls, newlo OR (dir <= 0 AND high > hs) AS seths FROM z1),
z3 AS (SELECT *, CASE WHEN setls THEN low ELSE ls END AS ls2, CASE WHEN setls THEN i ELSE lsb END AS lsb2, CASE WHEN seths THEN high ELSE hs END AS hs2, CASE WHEN seths THEN i ELSE hsb END AS hsb2 FROM z2),
z4 AS (SELECT *, CASE WHEN dir = 0 AND hib2 <> lob2 AND lo2 > 0 AND (hi2 - lo2) / lo2 * 100 >= 20 THEN CASE WHEN lob2 < hib2 THEN 'start up' ELSE 'start down' END
  WHEN dir = 1 AND NOT newhi AND hi2 > 0 AND (hi2 - ls2) / hi2 * 100 >= 20 AND i - hib2 >= 3 THEN 'down' WHEN dir = -1 AND NOT newlo AND lo2 > 0 AND (hs2 - lo2) / lo2 * 100 >= 20 AND i - lob2 >= 3 THEN 'up' ELSE '' END AS turn FROM z3)
SELECT symbol, t, i, CASE WHEN turn IN ('start up', 'up') THEN 1.0 WHEN turn IN ('start down', 'down') THEN -1.0 ELSE dir END, CASE turn WHEN 'up' THEN hs2 ELSE hi2 END, CASE turn WHEN 'up' THEN hsb2 ELSE hib2 END, CASE turn WHEN 'down' THEN ls2 ELSE lo2 END, CASE turn WHEN 'down' THEN lsb2 ELSE lob2 END,
  CASE turn WHEN 'up' THEN low ELSE ls2 END, CASE turn WHEN 'up' THEN i ELSE lsb2 END, CASE turn WHEN 'down' THEN high ELSE hs2 END, CASE turn WHEN 'down' THEN i ELSE hsb2 END, CASE WHEN turn IN ('start up', 'up') THEN lo2 WHEN turn IN ('start down', 'down') THEN hi2 ELSE pv END, CASE WHEN turn IN ('start up', 'up') THEN -1.0 WHEN turn IN ('start down', 'down') THEN 1.0 ELSE pd END FROM z4"""
_ZR = f"r(symbol, t, i, {', '.join(_ZF)}) AS (SELECT symbol, t, i, {', '.join(f'CAST({e} AS DOUBLE)' for e in _ZF.values())} FROM b x WHERE i = 0 UNION ALL (WITH {_ZZ}))"

QUERIES = {f.__name__: f for f in (ta_exponential, ta_wilder, ta_state_machines, ta_zigzag, ta_corrected, chart_indicators)}
SQL = {
    "ta_exponential": f"{_WITH}, {_walk('sm', _EXP_FIRST, _EXP_STEP)} SELECT symbol, t, {sql_shown(_EXP_OUT)} FROM r",
    "ta_wilder": f"{_WITH}, {_walk('sm', _W_FIRST, _W_STEP)}, {_DX}, {_ADX} SELECT symbol, t, {sql_shown(_W_OUT)} FROM a",
    "ta_state_machines": f"{_WITH}, {_ST1}, {_SMA}, {_walk('sa', _SM_FIRST, _SM_STEP)} SELECT r.symbol, r.t, {sql_shown(_SM_OUT)} FROM r JOIN (SELECT symbol, t, atr, has9 FROM sa) USING (symbol, t)",
    "ta_zigzag": f"WITH RECURSIVE {BARS_SQL}, {_ZR} SELECT symbol, t, {sql_shown({chr(34) + 'pivot' + chr(34): 'pv', 'pivot_direction': 'pd'})} FROM r",
    "chart_indicators": f"{_WITH}, {_walk('sm', _CH_FIRST, _CH_STEP)} SELECT symbol, t, {sql_shown({'chart_ema': 'seeded', 'ewm_span': 'CASE WHEN i >= 19 THEN e1 END', 'ewm_wilder': 'CASE WHEN i >= 13 THEN e2 END'})} FROM r",
}
SQL["ta_corrected"] = f"""WITH c AS (SELECT event_type AS symbol, min(date_trunc('hour', ts)) AS since FROM events WHERE (event_type = 'click' AND epoch(ts) >= {_SINCE} + 1 AND event_id % 97 = 0) OR (event_type = 'view' AND epoch(ts) >= {_SINCE} + 86401 AND event_id % 89 = 0) GROUP BY 1)
SELECT e.symbol, e.t, coalesce(e.t >= epoch(c.since), false) AS recomputed, e.ema, w.rma FROM ({SQL["ta_exponential"]}) e JOIN ({SQL["ta_wilder"]}) w USING (symbol, t) LEFT JOIN c ON c.symbol = e.symbol"""
