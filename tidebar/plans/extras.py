"""State of bars, clock and session functions, tick checks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numeric as M
from ..functions import text as X
from ..functions import times as T
from ..operators import bars as B
from ..operators import flow as W
from ..operators import ranking as K
from ..operators import reports as R
from ..operators import state as S
from .alignment import _TICKS, _ticks
from .common import BARS_SQL, hourly, shown, sql6, sql_shown, table

KEYS = ["symbol", "t"]
FLAGS = ["isfirst", "islast", "ishistory", "islastconfirmedhistory", "isnew", "isconfirmed", "isrealtime"]


def bar_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bar_index, last_bar_index, barstate flags, symbol and timeframe fields of hourly bars."""
    b = S.bar_state(hourly(spark, sf_dir))
    info, tf = S.symbol_info(F.concat(F.when(F.col("symbol") == "click", "TWSE:").otherwise(""), "symbol")), S.timeframe_info("60")
    return b.select(*KEYS, "bar_index", "last_bar_index", *FLAGS, info["ticker"].alias("ticker"), info["tickerid"].alias("tickerid"), info["prefix"].alias("prefix"), info["currency"].alias("currency"), *[tf[k].alias(k) for k in ("period", "main_period", "multiplier", "isminutes", "isintraday", "isdwm", "isticks", "in_seconds")])


def mtf_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last complete day of the symbol click at each hour of all symbols."""
    chart = hourly(spark, sf_dir)
    out = S.foreign(chart, B.resample(chart, "D"), "click", ["close", "volume"], "D")
    return shown(out, KEYS, {"close": "close", "other": "foreign.close", "other_volume": "foreign.volume"})


def fn_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the clock, timestamp and format_time, session flags, trading day, lengths of timeframes."""
    b = hourly(spark, sf_dir)
    t = F.col("t")
    f = T.fields(t)
    flags = T.session_flags(t, "0845-1345", 3600)
    back = T.timestamp(f["year"], f["month"], f["dayofmonth"], f["hour"], f["minute"], f["second"])
    return b.select(*KEYS, *[c.alias(k) for k, c in f.items()], back.alias("stamp"), X.format_time(t * 1000, "yyyy-MM-dd HH:mm", "Asia/Taipei").alias("text"), *[c.alias(k) for k, c in flags.items()], T.trading_day(t).cast("string").alias("day"), (T.now_ms() > t * 1000).alias("past"), F.lit(B.seconds("4H")).alias("seconds"), F.lit(B.from_seconds(14_400)).alias("timeframe"))


def fn_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """float and bool of numbers and texts; new, copy, clear and the leftmost search of arrays; copy and clear of maps."""
    p = table(spark, sf_dir, "part")
    n, k = F.col("p_name"), F.col("p_partkey")
    a = A.new(3, k % 5)
    m = F.create_map(F.lit("k"), k)
    return p.select(
        "p_partkey", M.float_(F.concat(k.cast("string"), F.lit(".5"))).alias("float"), M.float_(n).alias("float_of_text"), M.bool_(k % 3).alias("bool"), M.bool_(F.lit("true"), "string").alias("bool_of_text"), F.size(a).alias("size"), A.sum_(a).alias("sum"),
        F.size(F.slice(a, 1, 0)).alias("cleared"), A.binary_search_leftmost(F.array(F.lit(0), F.lit(2), F.lit(2), F.lit(4)), k % 6).alias("leftmost"), F.size(F.map_filter(m, lambda _, v: v < 0)).alias("map_cleared"), A.map_get(m, F.lit("k")).alias("copied"),
    )


def flow_true_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume of each tick from a running total that stands still for a while, and then from the tick's own counter."""
    t = _ticks(spark, sf_dir)
    run = F.sum(F.floor("price")).over(W.in_order().rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("_run", run).select("symbol", "t", "seq", (F.floor(F.col("_run") / 100) * 100).alias("total_volume"), F.floor(F.col("_run") / 7).alias("volume"))
    return t.select("symbol", "t", "seq", W.true_volume(t).cast("long").alias("volume"))


def flow_sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks within a share of the last tick that was let through."""
    return W.sane(_ticks(spark, sf_dir), 0.5).select("symbol", "t", "seq")


def flow_tiered_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large prints by the price tier of their symbol."""
    tiers = [(60.0, 90.0, 0.0, 40.0, 0.0), (20.0, 95.0, 80.0, 70.0, 0.0), (0.0, 99.0, 60.0, 50.0, 0.0)]
    out = W.tiered_prints(_ticks(spark, sf_dir), tiers, 3, 20_000)
    return out.select("symbol", "t", "seq", "is_l1", "is_l1_lite", "is_l2", "l2_cluster")


def flow_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that cross a level or a trend line of their symbol, each line at most once in two hours."""
    t = _ticks(spark, sf_dir)
    quotes = t.select("symbol", "t", "seq", F.lag("price").over(W.in_order()).alias("before"), F.col("price").alias("mid"))
    none = F.lit(None)
    drawn = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("level"), at.cast("long").alias("time"), b.cast("double").alias("level2"), to.cast("long").alias("time2")) for n, a, at, b, to in (("low", 10.0, none, none, none), ("high", 50.0, none, none, none), ("trend", 20.0, F.lit(1704067200), F.lit(80.0), F.lit(1706659200)))])
    lines = t.select("symbol").distinct().select("symbol", F.explode(drawn).alias("d")).select("symbol", F.concat_ws("-", "symbol", "d.n").alias("line"), "d.level", "d.time", "d.level2", "d.time2")
    return W.crossings(quotes, lines, 7_200).select("symbol", "line", "t", "seq", F.col("crossed").cast("int").alias("crossed"))


def rank_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 newest orders of each customer."""
    return K.newest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3).select("o_custkey", "o_orderkey", F.col("rank").cast("int").alias("rank"))


def account_live_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit of positions scaled to a live price; some have no live price, some stand at their entry."""
    li = table(spark, sf_dir, "lineitem")
    q, d = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100
    live = F.when(F.col("l_linenumber") > 1, q + 2)
    side = F.when(F.col("l_returnflag") == "R", "SHORT").otherwise("LONG")
    return shown(li.select("l_orderkey", "l_linenumber", R.live_profit(side, q, q + F.floor(d / 2), d, live, live + 1).alias("p")), ["l_orderkey", "l_linenumber"], {"profit": "p"})


def report_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a guard may go live: orders are decisions, what their lines made is the outcome."""
    pnl = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("double") - 25).alias("pnl"))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).alias("verdict")).join(pnl, "k", "left")
    out = R.guard_readiness(d)
    return shown(out, ["approved", "flagged", "ready"], {"approved_loss": "approved_loss", "flagged_loss": "flagged_loss"})


def report_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of hourly bars by trading session, wide bars apart from the others."""
    b = hourly(spark, sf_dir)
    trades = b.select("t", (F.col("close") - F.col("open")).alias("points"), F.when(F.col("volume") > 2, F.lit(0.5)).alias("lots"), (F.col("high") - F.col("low") > 60).alias("wide"))
    night = F.when(T.in_session(F.col("t"), "1500-0500"), "night").otherwise("day")
    return shown(R.session_split(trades, night, F.col("wide")), ["session", "group", "n"], {c: c for c in ("win_rate", "avg_points", "sized_points")})


def report_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share, confidence and outcome by choice: order states, with what each line of an order took off; a line that may still come back has no outcome."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", F.col("l_discount").cast("double")).alias("off"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price")).join(line, "o_orderkey", "left")
    return shown(R.measurement(rows, "o_orderstatus", "price", "off"), ["choice", "n", "covered"], {c: c for c in ("share", "confidence", "outcome", "total")})


def report_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a recompute changes: rounded averages against the averages themselves."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") > 0, F.lit(1)).alias("flag"))
    new = c.select("c_custkey", F.floor("balance").cast("double").alias("balance"), "nation", F.when(F.col("balance") > 1000, F.lit(1)).alias("flag"))
    return R.changed_fields(c, new, ["c_custkey"], ["balance", "nation", "flag"])


def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20 customers by name."""
    rows, total = R.page(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 3, 20)
    return rows.withColumn("total", F.lit(total).cast("long"))


_WITH = f"WITH {BARS_SQL}"
_LOCAL = "to_timestamp(t) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR"
_IN = "(hour(l) * 60 + minute(l) >= 525 AND hour(l) * 60 + minute(l) < 825)"
_BEFORE, _AFTER = _IN.replace("(l)", "(l - INTERVAL 1 HOUR)"), _IN.replace("(l)", "(l + INTERVAL 1 HOUR)")
_ORDER = "(PARTITION BY symbol ORDER BY t, seq)"
_TIER = "CASE WHEN p0 >= 60 THEN {} WHEN p0 >= 20 THEN {} ELSE {} END"
_L1, _LITE, _L2 = _TIER.format(90, 95, 99), _TIER.format(0, 80, 60), _TIER.format(40, 70, 50)
_RECENT = "(PARTITION BY symbol ORDER BY pt RANGE BETWEEN 20000999999 PRECEDING AND CURRENT ROW)"

QUERIES = {f.__name__: f for f in (bar_states, mtf_foreign, fn_clock, fn_casts, flow_true_volume, flow_sane, flow_tiered_prints, flow_crossings, rank_newest, account_live_profit, report_readiness, report_sessions, report_measurement, report_changed_fields, report_page)}
SQL = {
    "bar_states": f"{_WITH}, c AS (SELECT symbol, t, CAST(i AS INT) AS bar_index, CAST(count(*) OVER (PARTITION BY symbol) AS INT) - 1 AS last_bar_index FROM b) SELECT symbol, t, bar_index, last_bar_index, bar_index = 0 AS isfirst, bar_index = last_bar_index AS islast, bar_index < last_bar_index AS ishistory, bar_index = last_bar_index AS islastconfirmedhistory, true AS isnew, true AS isconfirmed, false AS isrealtime, symbol AS ticker, "
    "CASE WHEN symbol = 'click' THEN 'TWSE:' ELSE '' END || symbol AS tickerid, CASE WHEN symbol = 'click' THEN 'TWSE' ELSE '' END AS prefix, CASE WHEN symbol = 'click' THEN 'TWD' ELSE 'USD' END AS currency, '60' AS period, '60' AS main_period, 60 AS multiplier, true AS isminutes, true AS isintraday, false AS isdwm, false AS isticks, 3600 AS in_seconds FROM c",
    "mtf_foreign": f"{_WITH}, d AS (SELECT t - t % 86400 + 86400 AS e, last(close ORDER BY t) AS close, sum(volume) AS volume FROM bars WHERE symbol = 'click' GROUP BY 1) SELECT b.symbol, b.t, {sql_shown({'close': 'b.close', 'other': 'd.close', 'other_volume': 'd.volume'})} FROM b ASOF LEFT JOIN d ON b.t >= d.e",
    "fn_clock": f"{_WITH}, x AS (SELECT symbol, t, make_timestamp((t + 28800) * 1000000) AS l FROM bars) SELECT symbol, t, CAST(year(l) AS INT) AS year, CAST(month(l) AS INT) AS month, CAST(day(l) AS INT) AS dayofmonth, CAST(hour(l) AS INT) AS hour, CAST(minute(l) AS INT) AS minute, CAST(second(l) AS INT) AS second, CAST(dayofweek(l) + 1 AS INT) AS dayofweek, CAST(weekofyear(l) AS INT) AS weekofyear, t * 1000 AS stamp, strftime(l, '%Y-%m-%d %H:%M') AS text, "
    f"{_IN} AS ismarket, {_IN} AND NOT {_BEFORE} AS isfirstbar, {_IN} AND NOT {_AFTER} AS islastbar, {_IN} AND NOT {_BEFORE} AS isfirstbar_regular, {_IN} AND NOT {_AFTER} AS islastbar_regular, false AS ispremarket, false AS ispostmarket, CAST(CAST(l + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, true AS past, 14400 AS seconds, '240' AS timeframe FROM x",
    "fn_casts": "SELECT p_partkey, p_partkey + 0.5::DOUBLE AS float, CAST(NULL AS DOUBLE) AS float_of_text, p_partkey % 3 <> 0 AS bool, true AS bool_of_text, 3 AS size, CAST(3 * (p_partkey % 5) AS DOUBLE) AS sum, 0 AS cleared, CAST([0, -2, 1, -4, 3, -5][p_partkey % 6 + 1] AS INT) AS leftmost, 0 AS map_cleared, p_partkey AS copied FROM part",
    "flow_true_volume": f"WITH {_TICKS}, r AS (SELECT symbol, t, seq, CAST(sum(floor(price)) OVER (PARTITION BY symbol ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM k), v AS (SELECT *, run // 100 * 100 AS total, run // 7 AS own FROM r), s AS (SELECT *, total - lag(total) OVER {_ORDER} AS step, own - lag(own) OVER {_ORDER} AS mine FROM v) SELECT symbol, t, seq, CASE WHEN step IS NULL THEN own WHEN step > 0 THEN step ELSE greatest(coalesce(mine, 0), 0) END AS volume FROM s",
    "flow_sane": f"WITH RECURSIVE {_TICKS}, n AS MATERIALIZED (SELECT symbol, t, seq, price, row_number() OVER {_ORDER} AS i FROM k), r(symbol, t, seq, i, kept, ref) AS (SELECT symbol, t, seq, i, price > 0, CASE WHEN price > 0 THEN price END FROM n WHERE i = 1 UNION ALL SELECT symbol, t, seq, i, ok, CASE WHEN ok THEN price ELSE ref END FROM ("
    "SELECT n.*, p.ref, n.price > 0 AND (p.ref IS NULL OR abs(n.price - p.ref) / p.ref <= 0.5) AS ok FROM r p JOIN n ON n.symbol = p.symbol AND n.i = p.i + 1)) SELECT symbol, t, seq FROM r WHERE kept",
    "flow_tiered_prints": f"WITH {_TICKS}, q AS (SELECT *, first_value(price) OVER {_ORDER} AS p0, t * 1000000 + row_number() OVER (PARTITION BY symbol, t ORDER BY seq) AS pt FROM k), x AS (SELECT *, CASE WHEN amount >= {_L2} THEN dir END AS way FROM q), y AS (SELECT *, count(way) OVER {_RECENT} AS n, min(way) OVER {_RECENT} AS lo, max(way) OVER {_RECENT} AS hi FROM x) "
    f"SELECT symbol, t, seq, amount >= {_L1} AS is_l1, {_LITE} > 0 AND amount >= {_LITE} AND amount < {_L1} AS is_l1_lite, amount >= {_L2} AS is_l2, amount >= {_L2} AND n >= 3 AND (lo >= 0 OR hi <= 0) AS l2_cluster FROM y",
    "flow_crossings": f"WITH RECURSIVE {_TICKS}, q AS (SELECT symbol, t, seq, price, lag(price) OVER {_ORDER} AS was FROM k), p AS (SELECT *, unnest([{{'n': 'low', 'at': 10.0::DOUBLE}}, {{'n': 'high', 'at': 50.0::DOUBLE}}, {{'n': 'trend', 'at': 20.0 + (80.0 - 20.0) / 2592000.0::DOUBLE * (t - 1704067200)}}]) AS l FROM q), "
    "c AS MATERIALIZED (SELECT symbol, symbol || '-' || l.n AS line, t, seq, CASE WHEN was < l.at THEN 1 ELSE -1 END AS crossed, row_number() OVER (PARTITION BY symbol, l.n ORDER BY t, seq) AS i FROM p WHERE (was < l.at) <> (price < l.at)), "
    "r(symbol, line, t, seq, i, crossed, kept, fired) AS (SELECT symbol, line, t, seq, i, crossed, true, t FROM c WHERE i = 1 UNION ALL SELECT c.symbol, c.line, c.t, c.seq, c.i, c.crossed, c.t - p.fired >= 7200, CASE WHEN c.t - p.fired >= 7200 THEN c.t ELSE p.fired END FROM r p JOIN c ON c.line = p.line AND c.i = p.i + 1) SELECT symbol, line, t, seq, crossed FROM r WHERE kept",
    "rank_newest": "SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3",
    "account_live_profit": f"WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) * 100 AS d FROM lineitem) SELECT l_orderkey, l_linenumber, {sql6('CASE WHEN l_linenumber = 1 OR floor(d / 2) = 0 THEN d ELSE d / floor(d / 2) * CASE WHEN l_returnflag = $$R$$ THEN 3 ELSE 2 END END')} AS profit FROM p",
    "report_readiness": f"WITH s AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS DOUBLE) - 25) AS pnl FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey % 3 AS verdict, pnl FROM orders JOIN s ON o_orderkey = k), r AS (SELECT count(*) FILTER (verdict = 0) AS approved, count(*) FILTER (verdict <> 0) AS flagged, avg((pnl < 0)::INT) FILTER (verdict = 0) AS al, avg((pnl < 0)::INT) FILTER (verdict <> 0) AS fl FROM d) SELECT approved, flagged, approved >= 20 AND flagged >= 10 AND fl > al AS ready, {sql_shown({'approved_loss': 'al', 'flagged_loss': 'fl'})} FROM r",
    "report_sessions": f"{_WITH}, x AS (SELECT close - open AS points, CASE WHEN volume > 2 THEN 0.5 ELSE 1.0 END AS lots, high - low > 60 AS wide, hour(make_timestamp((t + 28800) * 1000000)) AS h FROM bars) SELECT CASE WHEN h >= 15 OR h < 5 THEN 'night' ELSE 'day' END AS session, CASE WHEN wide THEN 'volatile' ELSE 'normal' END AS \"group\", count(*) AS n, {sql_shown({'win_rate': 'avg((points > 0)::INT)', 'avg_points': 'avg(points)', 'sized_points': 'sum(points * lots)'})} FROM x GROUP BY 1, 2",
    "report_measurement": f"WITH r AS (SELECT o_orderstatus AS choice, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN l_returnflag <> 'N' THEN CAST(l_discount AS DOUBLE) END AS off FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) SELECT choice, count(*) AS n, count(off) AS covered, {sql_shown({'share': 'count(*) / sum(count(*)) OVER ()', 'confidence': 'avg(price)', 'outcome': 'avg(off)', 'total': 'sum(off)'})} FROM r GROUP BY choice",
    "report_changed_fields": "SELECT 'balance' AS field, count(*) FILTER (floor(CAST(c_acctbal AS DOUBLE)) <> CAST(c_acctbal AS DOUBLE)) AS changed, count(*) AS rows FROM customer UNION ALL SELECT 'nation', 0, count(*) FROM customer UNION ALL SELECT 'flag', count(*) FILTER (c_acctbal > 0 AND c_acctbal <= 1000), count(*) FROM customer",
    "report_page": "SELECT c_custkey, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40",
}
