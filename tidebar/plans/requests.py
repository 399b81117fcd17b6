"""Levels by anchor, statistics at ticks, groups of a guard's decisions, latest days, symbols by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import flow as W
from ..operators import guard as G
from ..operators import ranking as K
from ..operators import rolling as R
from ..operators import state as S
from .alignment import _TICKS, _ticks
from .common import BARS_SQL, hourly, shown, sql6, sql_shown, table
from .indicators import _LEVELS

KEYS = ["symbol", "t"]
_DEVELOPING = [k for k in _LEVELS if k != "Woodie"]
#: An anchor that isn't a day: every 17th bar of a symbol, and bars of volume 1 in their 5th place of ten.
_ANCHOR = "(i % 17 = 0 OR (i % 10 = 5 AND volume = 1))"


def _each_level(levels_of, kinds) -> DataFrame:
    out = None
    for kind in kinds:
        one = levels_of(kind).select(F.lit(kind).alias("kind"), *KEYS, F.posexplode("levels").alias("level", "value"))
        out = one if out is None else out.unionAll(one)
    return shown(out.where("value is not null"), ["kind", *KEYS, "level"], {"value": "value"})


def ta_pivot_developing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot levels of five kinds at each hour, from the period so far."""
    b = hourly(spark, sf_dir)
    return _each_level(lambda kind: R.pivot_levels_by_anchor(b, kind, F.expr(_ANCHOR), developing=True), _DEVELOPING)


def ta_pivot_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot levels of six kinds at each hour, from the period that the last anchor ended."""
    b = hourly(spark, sf_dir)
    return _each_level(lambda kind: R.pivot_levels_by_anchor(b, kind, F.expr(_ANCHOR)), _LEVELS)


_ROLL_NAMES = ("volume", "buy", "sell", "buy_amount", "sell_amount", "large_buy", "large_sell", "change")


def flow_rolling_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each tick, volumes, amounts and large bars of the complete bars before it."""
    ticks = _ticks(spark, sf_dir)
    bars = W.with_large(hourly(spark, sf_dir).drop("i"), ticks, 60.0, 3600)
    out = W.rolling_at(ticks.select("symbol", "t", "seq", "price"), bars, (5, 24), 3600)
    return shown(out, [*KEYS, "seq"], {f"{n}_{w}": f"{n}_{w}" for w in (5, 24) for n in _ROLL_NAMES})


def report_guard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guard's decisions by verdict and by rule, with what came of them."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    pnl = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity") - 25).alias("pnl"))
    hits = F.array_compact(F.array(F.when(k % 4 == 1, "size"), F.when(k % 6 < 2, "spread"), F.when(k % 12 == 1, "size")))
    return shown(G.summary_by_group(orders.join(pnl, "o_orderkey", "left").select((k % 3).alias("verdict"), hits.alias("hits"), "pnl")), ["group", "n"], {"loss_rate": "loss_rate", "pnl": "pnl"})


def rank_latest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three greatest of the latest day with trade for each calendar day; there is none on week-ends and in July."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    day = F.unix_date("d")
    trade = o.where("dayofweek(d) not in (1, 7) and month(d) <> 7")
    bars = trade.groupBy(F.col("o_orderpriority").alias("symbol"), day.alias("t")).agg(F.max("o_totalprice").cast("double").alias("close"), F.count("*").cast("double").alias("volume"))
    return shown(K.latest_movers(bars, o.select(day.alias("asked")), "amount", 3), ["asked", "t", "symbol", "rank"], {"change": "change", "amount": "amount"})


def mtf_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last complete day of the symbol that each hour asks for."""
    chart = hourly(spark, sf_dir)
    asked = F.when(F.col("i") % 4 == 0, "click").when(F.col("i") % 4 == 1, "view").when(F.col("i") % 4 == 2, "nowhere").otherwise(F.col("symbol"))
    out = S.foreign_by(chart, B.resample(chart, "D"), asked, ["close", "volume"], "D")
    return shown(out, KEYS, {"close": "close", "other": "foreign.close", "other_volume": "foreign.volume"})


_WITH = f"WITH {BARS_SQL}"
# n numbers the periods of a symbol, whose first opens without an anchor too
_PERIODS = f"g AS (SELECT *, {_ANCHOR} AS a, sum({_ANCHOR}::INT) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM b)"
_IN = "(PARTITION BY symbol, n ORDER BY t ROWS UNBOUNDED PRECEDING)"


def _levels_sql(kinds) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, symbol, t, {j} AS level, {sql6(e)} AS value FROM q WHERE {e} IS NOT NULL" for k in kinds for j, e in enumerate(_LEVELS[k]))


_Q = "q AS (SELECT *, h - l AS s, (h + l + c) / 3 AS p, (h + l + 2 * o) / 4 AS w, CASE WHEN c < o1 THEN h + 2 * l + c WHEN c > o1 THEN 2 * h + l + c ELSE h + l + 2 * c END AS x FROM e)"
_UNIT, _ROLL = 3600, {}
for _w in (5, 24):
    _sum = lambda e, where="true", w=_w: f"coalesce(list_sum(list_transform(list_filter(w{w}, lambda z: {where}), lambda z: {e})), 0)"
    _up, _down = "z.close > z.open", "z.close < z.open"
    _ROLL |= {
        f"volume_{_w}": _sum("z.volume"), f"buy_{_w}": _sum("z.volume", _up), f"sell_{_w}": _sum("z.volume", _down), f"buy_amount_{_w}": _sum("z.volume * z.close * 1000", _up), f"sell_amount_{_w}": _sum("z.volume * z.close * 1000", _down),
        f"large_buy_{_w}": f"len(list_filter(w{_w}, lambda z: z.large AND {_up}))", f"large_sell_{_w}": f"len(list_filter(w{_w}, lambda z: z.large AND NOT {_up}))", f"change_{_w}": f"coalesce(100 * (price - w{_w}[-1].open) / nullif(w{_w}[-1].open, 0), 0)",
    }
# each tick's bars of the last day and an hour, oldest first; the windows are cut from them
_AROUND = f"lb AS (SELECT bars.*, bars.t IN (SELECT y.t - y.t % {_UNIT} FROM k y WHERE y.symbol = bars.symbol AND y.amount >= 60) AS large FROM bars), a AS (SELECT k.symbol, k.t, k.seq, any_value(k.price) AS price, list({{'t': lb.t, 'open': lb.open, 'close': lb.close, 'volume': lb.volume, 'large': lb.large}} ORDER BY lb.t) FILTER (WHERE lb.t IS NOT NULL) AS bs FROM k LEFT JOIN lb ON lb.symbol = k.symbol AND lb.t >= k.t - {24 * _UNIT} AND lb.t < k.t - k.t % {_UNIT} GROUP BY 1, 2, 3), v AS (SELECT symbol, t, seq, price, coalesce(list_filter(bs, lambda z: z.t >= t - {5 * _UNIT}), []) AS w5, coalesce(bs, []) AS w24 FROM a)"
_TRADED = "dayofweek(o_orderdate) NOT IN (0, 6) AND month(o_orderdate) <> 7"

QUERIES = {f.__name__: f for f in (ta_pivot_developing, ta_pivot_anchored, flow_rolling_amounts, report_guard_rules, rank_latest_day, mtf_symbols)}
SQL = {
    "ta_pivot_developing": f"{_WITH}, {_PERIODS}, e AS (SELECT symbol, t, first_value(open) OVER {_IN} AS o, first_value(open) OVER {_IN} AS o1, max(high) OVER {_IN} AS h, min(low) OVER {_IN} AS l, close AS c FROM g), {_Q} {_levels_sql(_DEVELOPING)}",
    "ta_pivot_anchored": f"{_WITH}, {_PERIODS}, d AS (SELECT symbol, n, first(open ORDER BY t) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY t) AS c FROM g GROUP BY 1, 2), f AS (SELECT symbol, n, o, lag(o) OVER y AS o1, lag(h) OVER y AS h, lag(l) OVER y AS l, lag(c) OVER y AS c FROM d WINDOW y AS (PARTITION BY symbol ORDER BY n)), e AS (SELECT g.symbol, g.t, f.* EXCLUDE (symbol, n) FROM g JOIN f USING (symbol, n)), {_Q} {_levels_sql(_LEVELS)}",
    "flow_rolling_amounts": f"{_WITH}, {_TICKS}, {_AROUND} SELECT symbol, t, seq, {sql_shown(_ROLL)} FROM v",
    "report_guard_rules": f"WITH p AS (SELECT l_orderkey AS k, sum(l_quantity - 25) AS pnl FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'approve' ELSE 'flagged' END AS v, pnl FROM orders JOIN p ON k = o_orderkey), g AS (SELECT v AS \"group\", pnl FROM d UNION ALL SELECT 'rule:size', pnl FROM d WHERE k % 4 = 1 UNION ALL SELECT 'rule:spread', pnl FROM d WHERE k % 6 < 2 UNION ALL SELECT 'rule:size', pnl FROM d WHERE k % 12 = 1) SELECT \"group\", count(*) AS n, {sql_shown({'loss_rate': 'avg((pnl < 0)::INT)', 'pnl': 'sum(pnl)'})} FROM g GROUP BY 1",
    "rank_latest_day": f"WITH o AS (SELECT *, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS d FROM orders), b AS (SELECT o_orderpriority AS symbol, d AS t, CAST(max(o_totalprice) AS DOUBLE) AS close, CAST(count(*) AS DOUBLE) AS volume FROM o WHERE {_TRADED} GROUP BY 1, 2), c AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS before, close * volume AS amount FROM b), r AS (SELECT *, CASE WHEN before > 0 THEN 100 * (close - before) / before ELSE 0 END AS change, CAST(row_number() OVER (PARTITION BY t ORDER BY amount DESC, symbol) AS INTEGER) AS rank FROM c), "
    f"q AS (SELECT a.d AS asked, max(b.t) AS t FROM (SELECT DISTINCT d FROM o) a JOIN (SELECT DISTINCT t FROM b) b ON b.t BETWEEN a.d - 7 AND a.d GROUP BY 1) SELECT CAST(asked AS INTEGER) AS asked, CAST(t AS INTEGER) AS t, symbol, rank, {sql_shown({'change': 'change', 'amount': 'amount'})} FROM q JOIN r USING (t) WHERE rank <= 3",
    "mtf_symbols": f"{_WITH}, d AS (SELECT symbol, t - t % 86400 + 86400 AS e, last(close ORDER BY t) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2), c AS (SELECT *, CASE i % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'nowhere' ELSE symbol END AS asked FROM b) SELECT c.symbol, c.t, {sql_shown({'close': 'c.close', 'other': 'd.close', 'other_volume': 'd.volume'})} FROM c ASOF LEFT JOIN d ON c.asked = d.symbol AND c.t >= d.e",
}
