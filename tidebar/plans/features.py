"""Feature sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import features as X
from ..operators import risk as K
from ..operators import rolling as R
from .alignment import _TICKS, _ticks
from .common import BARS_SQL, frame, hourly, shown, sql_full, sql_lag, sql_shown, table
from .indicators import _TR


def feature_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart's own bands, stochastic, range mean and volume-weighted mean."""
    b = X.chart(R.with_moves(hourly(spark, sf_dir)))
    return shown(b, ["symbol", "t"], {c: c for c in ("bb_basis", "bb_upper", "bb_lower", "stoch_k", "tr_mean", "vwap")})


_LAST = ["ichimoku_base", "momentum", "williams_r", "awesome", "ultimate", "bull", "bear", "sma_10", "sma_50"]


def feature_last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each symbol's last bar."""
    return shown(X.last_values(hourly(spark, sf_dir)), ["symbol"], {c: c for c in _LAST})


def feature_pandas_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pandas-like feature set of each symbol's last bar."""
    return shown(X.pandas_values(hourly(spark, sf_dir)), ["symbol"], {c: c for c in X.PANDAS})


def feature_large_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of unusual volume, and how they have come."""
    b = X.large_bars(hourly(spark, sf_dir))
    return b.select("symbol", "t", "large", *[F.col(c).cast("long").alias(c) for c in ("n_large", "n_up", "n_down", "streak")], F.coalesce(F.col("last_way"), F.lit(9)).cast("int").alias("last_way"))


def report_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large ticks by symbol: how many, by side, net amount and mean price step after them."""
    from ..operators.flow import in_order

    t = _ticks(spark, sf_dir).withColumn("ret", F.lead("price").over(in_order()) - F.col("price")).where("amount >= 100")
    return shown(X.event_report(t), ["symbol", "n", "buys", "sells"], {"net": "net", "ret": "ret"})


def account_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrealised profit and margin of positions made of line items, at each part's retail price."""
    li = table(spark, sf_dir, "lineitem")
    positions = li.select((F.col("l_suppkey") % 50).alias("account"), F.col("l_partkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SHORT").otherwise("LONG").alias("side"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry"))
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"))
    return X.equity(positions, prices).select("account", *[F.round(c, 2).alias(c) for c in ("unrealized", "margin", "notional")])


def account_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades made of orders, by customer's nation: profit, share of winners, profit factor."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    closed = o.select(F.col("c_nationkey").alias("account"), F.year("o_orderdate").alias("closed"), (F.col("o_totalprice") % 1000 - 450).alias("pnl"), (F.col("o_totalprice") / 1000).alias("commission"))
    s = X.closed_summary(closed, 1994, 1996)
    return s.select("account", "trades", *[F.round(c, 4).alias(c) for c in ("pnl", "commission", "win_rate", "profit_factor")])


def account_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of each customer's closed trades, made of orders."""
    o = table(spark, sf_dir, "orders")
    closed = o.select(F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("closed"), F.col("o_orderkey").alias("id"), (F.floor(F.col("o_totalprice").cast("double")) % 1000 - 450).cast("double").alias("pnl"))
    s = X.account_statistics(closed)
    return shown(s, ["account", "trades"], {c: c for c in s.columns if c not in ("account", "trades")})


def report_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with what came of them, by verdict."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    decisions = o.select(k.alias("order_id"), (k % 5).cast("int").alias("symbol"), F.when(k % 3 == 0, k * 7).alias("opened"), (k % 3).cast("int").alias("verdict"))
    fills = o.where(k % 3 == 1).select(k.alias("order_id"), (k * 7).alias("opened"))
    outcomes = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("symbol"), (F.col("l_orderkey") * 7).alias("opened"), (F.col("l_quantity") - 25).alias("pnl"))
    both = X.decisions_with_outcomes(decisions, fills, outcomes)
    return shown(both.groupBy("verdict").agg(F.count("*").alias("n"), F.count("pnl").alias("known"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") < 0).cast("double")).alias("loss_rate")), ["verdict", "n", "known"], {"pnl": "pnl", "loss_rate": "loss_rate"})


_WITH = f"WITH {BARS_SQL}"
_F20, _F14, _UP = frame(20), frame(14), "(PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
_CHART = {
    "bb_basis": sql_full(20, f"avg(close) OVER {_F20}"), "bb_upper": sql_full(20, f"avg(close) OVER {_F20} + 2 * stddev_pop(close) OVER {_F20}"), "bb_lower": sql_full(20, f"avg(close) OVER {_F20} - 2 * stddev_pop(close) OVER {_F20}"),
    "stoch_k": sql_full(14, f"CASE WHEN max(high) OVER {_F14} = min(low) OVER {_F14} THEN 50 ELSE 100 * (close - min(low) OVER {_F14}) / (max(high) OVER {_F14} - min(low) OVER {_F14}) END"), "tr_mean": f"CASE WHEN i >= 14 THEN avg(tr) OVER {_F14} END",
    "vwap": f"sum((high + low + close) / 3 * volume) OVER {_UP} / sum(volume) OVER {_UP}",
}
_LV = {
    "ichimoku_base": sql_full(26, f"(max(high) OVER {frame(26)} + min(low) OVER {frame(26)}) / 2"), "momentum": f"close - {sql_lag('close', 10)}", "williams_r": sql_full(14, f"-100 * (max(high) OVER {_F14} - close) / nullif(max(high) OVER {_F14} - min(low) OVER {_F14}, 0)"), "awesome": f"CASE WHEN i >= 33 THEN avg((high + low) / 2) OVER {frame(5)} - avg((high + low) / 2) OVER {frame(34)} END",
    "ultimate": "CASE WHEN i >= 28 THEN 100 * (4 * " + " + ".join(f"{k}sum(bp) OVER {frame(n)} / nullif(sum(sp) OVER {frame(n)}, 0)" for n, k in ((7, ""), (14, "2 * "), (28, ""))) + ") / 7 END",
    "bull": f"high - {sql_full(13, f'avg(close) OVER {frame(13)}')}", "bear": f"low - {sql_full(13, f'avg(close) OVER {frame(13)}')}", "sma_10": sql_full(10, f"avg(close) OVER {frame(10)}"), "sma_50": sql_full(50, f"avg(close) OVER {frame(50)}"),
}
_BEFORE = "list_sort(array_agg(volume) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"
_LARGE = f"a AS (SELECT *, {_BEFORE} AS w FROM b), l AS (SELECT *, coalesce(volume > 2 * w[len(w) // 2 + 1], false) AS large FROM a), m AS (SELECT *, CASE WHEN large THEN CAST(sign(close - open) AS INT) END AS way, sum((NOT large)::INT) OVER {_UP} AS br FROM l)"

def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    i, way = F.col("i"), F.signum(F.col("close") - F.col("open"))
    day = T.in_session(F.col("t"), "0845-1346")
    return b.select("symbol", "t", "close", F.when(i % 11 != 0, way).alias("choice"), (0.5 + (i % 10) * 0.05).alias("confidence"), (F.col("high") - F.col("low") > 60).alias("volatile"), F.when(day, "day").otherwise("night").alias("part"))


def report_risk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on hourly decisions, each hanging on what the ones before made in their trading day."""
    d = _decisions(spark, sf_dir)
    out = K.gate(d, T.trading_day(F.col("t")), F.col("part") == "day", 5, 120.0)
    return shown(out, ["symbol", "t", "verdict", "reason", "rule"], {"lots": "lots", "outcome": "outcome"})


def report_risk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes when counters that ran by the date are worked out anew by trading day: by field, and by session."""
    d = _decisions(spark, sf_dir)
    old, new = (K.gate(d, key, F.col("part") == "day", 5, 120.0) for key in (F.to_date(T.local(F.col("t"))), T.trading_day(F.col("t"))))
    return K.differences(old, new, ["symbol", "t"], "part")


QUERIES = {f.__name__: f for f in (feature_chart, feature_last_values, feature_pandas_values, feature_large_bars, report_events, account_equity, account_closed, account_statistics, report_guard, report_risk_gate, report_risk_changes)}
SQL = {
    "feature_chart": f"{_WITH}, m AS (SELECT *, CASE WHEN {sql_lag('close')} IS NULL THEN high - low ELSE {_TR} END AS tr FROM b) SELECT symbol, t, {sql_shown(_CHART)} FROM m",
    "feature_last_values": f"{_WITH}, m AS (SELECT *, close - least(low, {sql_lag('close')}) AS bp0, greatest(high, {sql_lag('close')}) - least(low, {sql_lag('close')}) AS sp0 FROM b), n AS (SELECT *, CASE WHEN i > 0 THEN bp0 END AS bp, CASE WHEN i > 0 THEN sp0 END AS sp FROM m), z AS (SELECT symbol, t, {', '.join(f'{e} AS {k}' for k, e in _LV.items())} FROM n) SELECT symbol, {sql_shown({k: k for k in _LV})} FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1",
    "feature_large_bars": f"{_WITH}, {_LARGE} SELECT symbol, t, large, CAST(sum(large::INT) OVER {frame(30)} AS BIGINT) AS n_large, count(CASE WHEN way > 0 THEN 1 END) OVER {frame(30)} AS n_up, count(CASE WHEN way < 0 THEN 1 END) OVER {frame(30)} AS n_down, CAST(sum(large::INT) OVER (PARTITION BY symbol, br ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak, coalesce(last_value(way IGNORE NULLS) OVER {_UP}, 9) AS last_way FROM m",
    "report_events": f"WITH {_TICKS}, r AS (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY t, seq) - price AS ret FROM k) SELECT symbol, count(*) AS n, count(CASE WHEN dir > 0 THEN 1 END) AS buys, count(*) - count(CASE WHEN dir > 0 THEN 1 END) AS sells, {sql_shown({'net': 'sum(CASE WHEN dir > 0 THEN amount ELSE -amount END)', 'ret': 'avg(ret)'})} FROM r WHERE amount >= 100 GROUP BY symbol ORDER BY n DESC, symbol LIMIT 20",
    "account_equity": "SELECT l_suppkey % 50 AS account, round(sum((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * (p_retailprice - l_extendedprice / l_quantity) * l_quantity), 2) AS unrealized, round(sum(p_retailprice * l_quantity / 100), 2) AS margin, round(sum(p_retailprice * l_quantity), 2) AS notional FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "account_statistics": f"WITH c AS (SELECT o_custkey AS account, o_orderdate AS d, o_orderkey AS id, CAST(CAST(floor(CAST(o_totalprice AS DOUBLE)) AS BIGINT) % 1000 - 450 AS DOUBLE) AS p FROM orders), r AS (SELECT *, sum(p) OVER w AS run FROM c WINDOW w AS (PARTITION BY account ORDER BY d, id)), f AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY account ORDER BY d, id)) - run AS fall FROM r) SELECT account, count(*) AS trades, {sql_shown({'win_rate': 'avg((p > 0)::INT)', 'avg_win': 'avg(p) FILTER (p > 0)', 'avg_loss': '-avg(p) FILTER (p < 0)', 'profit_factor': 'sum(p) FILTER (p > 0) / -sum(p) FILTER (p < 0)', 'best': 'max(p)', 'worst': 'min(p)', 'sharpe': 'avg(p) / nullif(stddev_samp(p), 0)', 'max_drawdown': 'max(fall)', 'expectancy': 'avg(p)'})} FROM f GROUP BY account",
    "account_closed": "WITH c AS (SELECT c_nationkey AS account, o_totalprice % 1000 - 450 AS p, o_totalprice / 1000 AS f FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1994 AND 1996) SELECT account, count(*) AS trades, round(sum(p), 4) AS pnl, round(sum(f), 4) AS commission, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(sum(CASE WHEN p > 0 THEN p END) / -sum(CASE WHEN p < 0 THEN p END), 4) AS profit_factor FROM c GROUP BY account",
    "report_guard": f"WITH d AS (SELECT o_orderkey AS k, o_orderkey % 3 AS verdict FROM orders), s AS (SELECT l_orderkey AS k, sum(l_quantity - 25) AS pnl FROM lineitem GROUP BY 1) SELECT CAST(verdict AS INT) AS verdict, count(*) AS n, count(s.pnl) AS known, {sql_shown({'pnl': 'sum(s.pnl)', 'loss_rate': 'avg(CASE WHEN s.pnl < 0 THEN 1.0 WHEN s.pnl >= 0 THEN 0.0 END)'})} FROM d LEFT JOIN s ON d.k = s.k AND d.verdict < 2 GROUP BY 1",
}


def _gates(name: str, key: str) -> str:
    """A recursive query ``name`` over decisions; counters begin anew where the key changes."""
    names = "part_day, part_night, realized, losses, protected, way, entry, size"
    fresh = {"part_day": "0", "part_night": "0", "realized": "0::DOUBLE", "losses": "0", "protected": "false", "way": "NULL", "entry": "NULL", "size": "NULL"}
    carry = ", ".join(f"CASE WHEN p.k = x.k THEN p.{n} ELSE {v} END AS {n}" for n, v in fresh.items())
    walk = lambda source: f"""(SELECT symbol, t, i, k, part, close, choice, CASE WHEN follow AND part = 'day' THEN part_day + 1 ELSE part_day END AS part_day, CASE WHEN follow AND part = 'night' THEN part_night + 1 ELSE part_night END AS part_night, realized, losses, protected,
  CASE WHEN follow THEN choice END AS way, CASE WHEN follow THEN close END AS entry, CASE WHEN follow THEN lots END AS size, rule, lots, points FROM (
  SELECT *, CASE WHEN rule < 4 THEN 0 WHEN rule < 7 THEN 0.5 ELSE 1 END::DOUBLE AS lots, rule >= 4 AND choice IS NOT NULL AS follow FROM (
  SELECT *, CASE WHEN choice = 0 THEN 0 WHEN CASE part WHEN 'day' THEN part_day ELSE part_night END >= 5 THEN 1 WHEN protected AND choice IS NOT NULL THEN 2 WHEN losses >= 3 THEN 3 WHEN volatile THEN 4 WHEN confidence < 0.85 THEN 5 WHEN losses = 2 THEN 6 ELSE 7 END AS rule FROM (
  SELECT * EXCLUDE (realized, losses, protected), realized + coalesce(points * size, 0) AS realized, CASE WHEN points IS NULL THEN losses WHEN points >= 0 THEN 0 ELSE losses + 1 END AS losses, protected OR (points IS NOT NULL AND realized + points * size >= 120) AS protected FROM (
  SELECT *, CASE WHEN way IS NOT NULL THEN way * (close - entry) END AS points FROM ({source}))))))"""  # noqa: E731
    first = ", ".join(f"CAST({v} AS {t}) AS {n}" for (n, v), t in zip(fresh.items(), ("INT", "INT", "DOUBLE", "INT", "BOOLEAN", "DOUBLE", "DOUBLE", "DOUBLE"), strict=True))
    columns = f"symbol, t, i, k, part, close, choice, {names}, rule, lots, points"
    return f"""{name}d AS MATERIALIZED (SELECT *, {key} AS k FROM d), {name}({columns}) AS (SELECT {columns} FROM {walk(f"SELECT *, {first} FROM {name}d WHERE i = 0")} UNION ALL SELECT {columns} FROM {walk(f"SELECT x.*, {carry} FROM {name} p JOIN {name}d x ON x.symbol = p.symbol AND x.i = p.i + 1")})"""


_LOCAL = "make_timestamp((t + 28800) * 1000000)"
_DECIDED = f"d0 AS (SELECT *, {_LOCAL} AS l FROM b), d AS MATERIALIZED (SELECT symbol, t, i, l, close, CASE WHEN i % 11 <> 0 THEN CAST(sign(close - open) AS DOUBLE) END AS choice, 0.5 + (i % 10) * 0.05::DOUBLE AS confidence, high - low > 60 AS volatile, CASE WHEN hour(l) * 60 + minute(l) BETWEEN 525 AND 825 THEN 'day' ELSE 'night' END AS part FROM d0)"
_BY_DAY, _BY_DATE = "CAST(l + INTERVAL 9 HOUR AS DATE)", "CAST(l AS DATE)"
_RULE = {n: "[" + ", ".join(f"'{r[k]}'" for r in K.RULES) + "][rule + 1]" for n, k in (("rule", 0), ("verdict", 1), ("reason", 2))}
_NAMED = lambda r: f"SELECT symbol, t, part, {', '.join(f'{e} AS {n}' for n, e in _RULE.items())}, lots, points AS outcome FROM {r}"
_PAIR = ", ".join(f"o.{f} IS DISTINCT FROM n.{f} AS {f}" for f in K.FIELDS)
SQL |= {
    "report_risk_gate": f"WITH RECURSIVE {BARS_SQL}, {_DECIDED}, {_gates('g', _BY_DAY)} SELECT symbol, t, verdict, reason, rule, {sql_shown({'lots': 'lots', 'outcome': 'outcome'})} FROM ({_NAMED('g')})",
    "report_risk_changes": f"WITH RECURSIVE {BARS_SQL}, {_DECIDED}, {_gates('o', _BY_DATE)}, {_gates('n', _BY_DAY)}, c AS (SELECT n.part, {_PAIR} FROM ({_NAMED('o')}) o JOIN ({_NAMED('n')}) n USING (symbol, t)) "
    + " UNION ALL ".join(f"SELECT 'field' AS kind, '{f}' AS name, count(*) FILTER ({f}) AS changed, count(*) AS rows FROM c" for f in K.FIELDS)
    + f" UNION ALL SELECT 'group', part, count(*) FILTER ({' OR '.join(K.FIELDS)}), count(*) FROM c GROUP BY part",
}
