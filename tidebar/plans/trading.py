"""Strategies, order rules and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import align as A
from ..operators import bars as B
from ..operators import broker as K
from ..operators import guard as G
from ..operators import lots as L
from ..operators import ranking as N
from ..operators import rating as V
from ..operators import rolling as R
from ..operators import trades as H
from .common import BARS_SQL, frame, hourly, shown, sql6, sql_full, sql_lag, sql_shown, table

_NO = lambda kind: F.lit(None).cast(kind)


def _signals(b: DataFrame) -> DataFrame:
    """Long where the fast mean crosses over the slow one, short where it crosses under."""
    b = b.withColumns({"fast": R.sma("close", 3), "slow": R.sma("close", 8)})
    return b.withColumn("dir", F.when(R.crossover("fast", "slow"), 1).when(R.crossunder("fast", "slow"), -1))


def _entries(b: DataFrame, qty: float | None = None) -> DataFrame:
    s = _signals(b).where("dir is not null")
    return s.select("symbol", "i", F.lit(0).alias("seq"), F.lit("entry").alias("kind"), F.when(F.col("dir") > 0, "long").otherwise("short").alias("id"), "dir", F.lit(qty).cast("double").alias("qty"), _NO("double").alias("limit"), _NO("double").alias("stop"), _NO("string").alias("oca"), F.lit("").alias("comment"))


def strategy_reversal_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a strategy that is always long or short, by crossings of two means."""
    closed = H.reversal_trades(_signals(hourly(spark, sf_dir)), commission=0.1).where("exit_bar is not null")
    return shown(closed, ["symbol", "entry_bar", "exit_bar", "dir"], {c: c for c in ("qty", "entry_price", "exit_price", "profit", "commission")})


def strategy_reversal_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its account at each bar: equity, position, open profit, greatest drawdown and runup."""
    b = hourly(spark, sf_dir)
    account = H.reversal_equity(b, H.reversal_trades(_signals(b)))
    return shown(account, ["symbol", "i"], {c: c for c in ("equity", "position", "avg_price", "open_profit", "max_drawdown", "max_runup", "max_held")})


def strategy_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and means of its closed trades."""
    s = H.statistics(H.reversal_trades(_signals(hourly(spark, sf_dir))))
    return shown(s, ["symbol"], {c: c for c in s.columns if c != "symbol"})


def _ladder(b: DataFrame) -> DataFrame:
    """Orders of a strategy that is long by up to three contracts above its mean, short by as many below it, flat near it, and goes there in steps."""
    mean, span = R.sma("close", 8), R.highest("high", 8) - R.lowest("low", 8)
    step = F.floor(6 * F.try_divide(F.col("close") - mean, span) + 0.3178912)
    return L.to_targets(b, F.when(step.isNotNull(), F.greatest(F.lit(-3), F.least(F.lit(3), step))), commission=0.2)


def strategy_ladder_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All its trades with what they reached on their way; an exit_bar of -1 where nothing is closed yet."""
    b = hourly(spark, sf_dir)
    t = L.trades(_ladder(b))
    last = b.groupBy("symbol").agg(F.max("i").alias("_end"))
    way = t.join(last, "symbol").select("symbol", F.col("n").alias("trade"), F.col("entry_bar").alias("entry"), F.when(F.col("open"), F.col("_end")).otherwise(F.col("exit_bar")).alias("exit"), "dir", F.col("entry_price").alias("price"))
    reached = A.excursions(way, b).select("symbol", F.col("trade").alias("n"), "runup", "drawdown")
    t = t.join(reached, ["symbol", "n"], "left").withColumns({"max_runup": F.col("runup") * F.col("qty"), "max_drawdown": F.col("drawdown") * F.col("qty"), "profit_percent": 100 * F.try_divide("profit", F.col("entry_price") * F.col("qty")), "exit_bar": F.coalesce("exit_bar", F.lit(-1))})
    return shown(t, ["symbol", "n", "dir", "entry_bar", "exit_bar", "open"], {c: c for c in ("qty", "closed_qty", "entry_price", "exit_price", "profit", "profit_percent", "commission", "max_runup", "max_drawdown")})


def strategy_ladder_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its account at each bar: position, mean price, profits, counts of trades, greatest drawdown, runup and holdings."""
    b = hourly(spark, sf_dir)
    return shown(L.account(b, _ladder(b)), ["symbol", "i"], {c: c for c in L.ACCOUNT})


def strategy_ladder_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and means of its closed trades."""
    s = H.statistics(L.trades(_ladder(hourly(spark, sf_dir))).where("not open"))
    return shown(s, ["symbol"], {c: c for c in s.columns if c != "symbol"})


def strategy_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries in half the equity, left by a target or a stop of one group."""
    b = hourly(spark, sf_dir)
    s = _signals(b).where("dir is not null")
    level = lambda share: F.col("close") * (1 + F.col("dir") * share)
    leave = s.select("symbol", F.col("i"), F.lit(1).alias("seq"), F.lit("exit").alias("kind"), F.lit("bracket").alias("id"), "dir", _NO("double").alias("qty"), level(0.3).alias("limit"), level(-0.2).alias("stop"), _NO("string").alias("oca"), F.lit("").alias("comment"))
    account = K.replay(b, _entries(b).unionByName(leave), K.Config(qty=50.0, qty_type="percent_of_equity", slippage=0.01, commission=0.05, commission_type="percent", pyramiding=1))
    return shown(account.select("*", F.size("executions").alias("fills")), ["symbol", "i", "fills"], {c: c for c in ("equity", "position")})


def guard_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the entry rules on intents made of orders."""
    o = table(spark, sf_dir, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    intents = o.select(
        k.alias("intent"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.when(k % 3 == 0, "LIMIT").when(k % 3 == 1, "STOP").otherwise("MARKET").alias("type"), F.when(k % 3 != 2, p).alias("price"), (p * (1 + (k % 7 - 3) / 100.0)).alias("last"),
        F.when(k % 11 != 0, p * (1 - (k % 5 - 2) / 50.0)).alias("stop_loss"), F.when(k % 4 != 0, p * (1 + (k % 9 - 3) / 25.0)).alias("take_profit"), (k % 6 + 1).cast("double").alias("quantity"), (k % 5 != 0).alias("whole"), (p % 2000 - 1200).alias("day_pnl"),
        (k % 4).alias("loss_streak"), (k % 17).cast("double").alias("minutes_since_loss"), (k % 13 == 0).alias("opposite_open"), (k % 19 == 0).alias("same_losing"),
    )
    out = G.check(intents)
    return out.select("intent", F.array_join("hits", ",").alias("hits"), "verdict", "allowed")


_INTENTS = """n AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), i AS (SELECT k, k % 2 = 0 AS buy, CASE WHEN k % 3 <> 2 THEN p END AS price, k % 3 = 0 AS lim, p * (1 + (k % 7 - 3) / 100.0) AS last, CASE WHEN k % 11 <> 0 THEN p * (1 - (k % 5 - 2) / 50.0) END AS stop, CASE WHEN k % 4 <> 0 THEN p * (1 + (k % 9 - 3) / 25.0) END AS target, CAST(k % 6 + 1 AS DOUBLE) AS q, p % 2000 - 1200 AS pnl FROM n),
e AS (SELECT *, CASE WHEN price IS NULL THEN last WHEN lim AND last > 0 THEN CASE WHEN buy THEN least(price, last) ELSE greatest(price, last) END ELSE price END AS e FROM i),
r AS (SELECT *, CASE WHEN buy THEN target - e ELSE e - target END AS reward FROM e),
h AS (SELECT k, q, [CASE WHEN stop IS NULL OR stop <= 0 THEN 'stop_required' END, CASE WHEN stop IS NOT NULL AND e > 0 AND NOT (CASE WHEN buy THEN stop < e ELSE stop > e END) THEN 'stop_side' END, CASE WHEN stop IS NOT NULL AND e > 0 AND (reward <= 0 OR reward / nullif(abs(e - stop), 0) < 1.5) THEN 'reward_risk' END,
 CASE WHEN pnl <= -500 THEN 'daily_loss' END, CASE WHEN k % 4 >= 2 THEN 'loss_streak' END, CASE WHEN k % 17 < 5 THEN 'cooldown_after_loss' END, CASE WHEN k % 13 = 0 THEN 'opposite_side' END, CASE WHEN k % 19 = 0 THEN 'average_down' END] AS hs FROM r),
v AS (SELECT k, q, list_filter(hs, lambda x: x IS NOT NULL) AS hs, k % 4 = 2 AS halves FROM h), w AS (SELECT k, q, hs, CASE WHEN len(hs) = 0 THEN 0 WHEN halves AND len(hs) = 1 THEN 1 ELSE 2 END AS verdict FROM v)"""


def rank_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three first symbols of each day by gain, loss, volume and amount."""
    day, out = B.resample(hourly(spark, sf_dir), "D"), None
    for by in ("gainers", "losers", "volume", "amount"):
        one = shown(N.movers(day, by, 3).withColumn("list", F.lit(by)), ["list", "t", "rank", "symbol"], {"change": "change", "amount": "amount"})
        out = one if out is None else out.unionAll(one)
    return out


def rank_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of each brand."""
    top = N.top_per_group(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3)
    return top.select("p_brand", "rank", "p_partkey", "p_retailprice")


def rank_missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order, by segment."""
    _, missing = N.with_missing(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer"), "c_custkey")
    return missing.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def technical_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of five means and two oscillators, their rating and its band: a short form that SQL checks. The whole rating is technical_rating_full."""
    b = hourly(spark, sf_dir)
    c = F.col("close")
    vote = lambda x, y: F.when(x > y, 1).when(x < y, -1).when(x == y, 0)
    means = N.rating([vote(c, R.sma("close", n)) for n in (3, 5, 8, 13, 21)])
    st, wr = R.stoch("close", "high", "low", 14), R.wpr(14)
    osc = N.rating([F.when(st < 20, 1).when(st > 80, -1).when(st.isNotNull(), 0), F.when(wr < -80, 1).when(wr > -20, -1).when(wr.isNotNull(), 0)])
    b = b.withColumns({"ma": means, "osc": osc})
    return shown(b.withColumn("band", N.rating_band((F.col("ma") + F.col("osc")) / 2)), ["symbol", "t", "band"], {"ma": "ma", "osc": "osc"})


def technical_rating_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole technical rating: 15 votes of averages and 11 of oscillators, their means, the mean of both and its band."""
    b = V.with_votes(hourly(spark, sf_dir))
    return shown(b, ["symbol", "t", "band"], {c: c for c in (*V.MA_VOTES, *V.OSC_VOTES, "ma", "osc", "all")})


def time_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar fields, sessions and period changes at the venue."""
    b = hourly(spark, sf_dir)
    t = F.col("t")
    f = {k: v.cast("int").alias(k) for k, v in T.fields(t).items()}
    return b.select("symbol", "t", *f.values(), T.in_session(t, "0845-1345").alias("in_day"), T.in_session(t, "1500-0500").alias("in_night"), T.changed("D").alias("new_day"), T.changed("W").alias("new_week"), T.changed("M").alias("new_month"), F.coalesce(T.time("240"), F.lit(-1)).alias("opens_4h"), T.time_close("D").alias("closes_day"))


def time_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of sessions and periods, and of those some bars back; -1 where there is none."""
    at = {"session": T.time("D", "0845-1345"), "session_1": T.time("D", "0845-1345", bars_back=1), "session_8": T.time("W", "0845-1345", bars_back=8), "bar_in_session": T.time("60", "0845-1345"), "day_3": T.time("D", bars_back=3), "week_2": T.time("W", bars_back=2), "month_1": T.time("M", bars_back=1), "hours_2": T.time("240", bars_back=2)}
    return hourly(spark, sf_dir).select("symbol", "t", *[F.coalesce(v, F.lit(-1)).alias(k) for k, v in at.items()])


def _floor_change(e: str) -> str:
    return f"coalesce({e} <> lag({e}) OVER (PARTITION BY symbol ORDER BY t), true)"


_LOCAL = "(to_timestamp(t) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR)"
_SIG = f"f AS (SELECT *, {sql_full(3, f'avg(close) OVER {frame(3)}')} AS fast, {sql_full(8, f'avg(close) OVER {frame(8)}')} AS slow, lead(open) OVER (PARTITION BY symbol ORDER BY t) AS next_open FROM b), g AS (SELECT *, CASE WHEN fast > slow AND {sql_lag('fast')} <= {sql_lag('slow')} THEN 1 WHEN fast < slow AND {sql_lag('fast')} >= {sql_lag('slow')} THEN -1 END AS d FROM f), s0 AS (SELECT symbol, i + 1 AS entry_bar, next_open AS entry_price, d AS dir, lag(d) OVER (PARTITION BY symbol ORDER BY i) AS d1 FROM g WHERE d IS NOT NULL AND next_open IS NOT NULL), s1 AS (SELECT * FROM s0 WHERE d1 IS DISTINCT FROM dir), s AS (SELECT *, lead(entry_bar) OVER y AS exit_bar, lead(entry_price) OVER y AS exit_price, row_number() OVER y AS n FROM s1 WINDOW y AS (PARTITION BY symbol ORDER BY entry_bar))"
_WITH = f"WITH {BARS_SQL}"
_ACC = f"{_SIG}, c AS (SELECT *, (exit_price - entry_price) * dir AS p, coalesce(sum((exit_price - entry_price) * dir) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s), a AS (SELECT b.symbol, b.i, 100000 + coalesce(c.before + (b.close - c.entry_price) * c.dir, 0) AS equity, coalesce(c.dir, 0) AS position, c.entry_price AS avg_price, coalesce((b.close - c.entry_price) * c.dir, 0) AS open_profit FROM b ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.i >= c.entry_bar), q AS (SELECT *, greatest(100000, max(equity) OVER z) AS peak, least(100000, min(equity) OVER z) AS trough FROM a WINDOW z AS (PARTITION BY symbol ORDER BY i))"
_STAT = {"closedtrades": "count(*)", "wintrades": "count(CASE WHEN p > 0 THEN 1 END)", "losstrades": "count(CASE WHEN p < 0 THEN 1 END)", "eventrades": "count(CASE WHEN p = 0 THEN 1 END)", "grossprofit": "coalesce(sum(CASE WHEN p > 0 THEN p END), 0)", "grossloss": "coalesce(-sum(CASE WHEN p < 0 THEN p END), 0)", "netprofit": "sum(p)", "netprofit_percent": "sum(p) / 1000", "avg_trade": "avg(p)", "avg_trade_percent": "avg(100 * p / entry_price)", "avg_winning_trade": "avg(CASE WHEN p > 0 THEN p END)", "avg_losing_trade": "avg(CASE WHEN p < 0 THEN p END)", "avg_winning_trade_percent": "avg(CASE WHEN p > 0 THEN 100 * p / entry_price END)", "avg_losing_trade_percent": "avg(CASE WHEN p < 0 THEN 100 * p / entry_price END)"}
_MOVERS = " UNION ALL ".join(f"SELECT '{by}' AS list, t, rank, symbol, {sql6('change')} AS change, {sql6('amount')} AS amount FROM (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY {e}, symbol) AS INT) AS rank FROM m) WHERE rank <= 3" for by, e in (("gainers", "change DESC"), ("losers", "change"), ("volume", "volume DESC"), ("amount", "amount DESC")))
_VOTES = [f"sign(close - {sql_full(n, f'avg(close) OVER {frame(n)}')})" for n in (3, 5, 8, 13, 21)]
_OSC = {"st": sql_full(14, f"100 * (close - min(low) OVER {frame(14)}) / nullif(max(high) OVER {frame(14)} - min(low) OVER {frame(14)}, 0)")}

# Contracts one by one: the k-th opened of a symbol is the k-th closed.
_LADDER = f"""w AS (SELECT *, {sql_full(8, f"6 * (close - avg(close) OVER {frame(8)}) / nullif(max(high) OVER {frame(8)} - min(low) OVER {frame(8)}, 0)")} AS x, lead(open) OVER (PARTITION BY symbol ORDER BY i) AS next_open FROM b),
g AS (SELECT symbol, i + 1 AS i, next_open AS price, CAST(greatest(-3, least(3, floor(x + 0.3178912))) AS INT) AS after FROM w WHERE x IS NOT NULL AND next_open IS NOT NULL),
o AS (SELECT * FROM (SELECT *, coalesce(lag(after) OVER (PARTITION BY symbol ORDER BY i), 0) AS before FROM g) WHERE after <> before),
f AS (SELECT *, CASE WHEN after * before < 0 THEN abs(after) ELSE greatest(abs(after) - abs(before), 0) END AS opening, CASE WHEN after * before < 0 THEN abs(before) ELSE greatest(abs(before) - abs(after), 0) END AS closing, abs(after - before) * price * 0.002 AS comm FROM o),
bought AS (SELECT symbol, i, price, sign(after) AS dir, opening, CASE WHEN closing > 0 THEN 0 ELSE comm END AS comm, row_number() OVER (PARTITION BY symbol ORDER BY i, k) AS unit FROM (SELECT *, unnest(range(opening)) AS k FROM f)),
sold AS (SELECT symbol, i, price, comm / closing AS comm, row_number() OVER (PARTITION BY symbol ORDER BY i, k) AS unit FROM (SELECT *, unnest(range(closing)) AS k FROM f)),
u AS (SELECT a.symbol, a.i AS entry_bar, a.price AS entry_price, CAST(a.dir AS INT) AS dir, a.opening, a.comm AS paid_in, z.i AS exit_bar, z.price AS exit_price, z.comm AS paid_out, (z.price - a.price) * a.dir AS gross FROM bought a LEFT JOIN sold z ON a.symbol = z.symbol AND a.unit = z.unit),
l AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar) - 1 AS n, dir, entry_bar, max(exit_bar) AS exit_bar, count(*) > count(exit_bar) AS open, count(*) AS qty, count(exit_bar) AS closed_qty, entry_price, avg(exit_price) AS exit_price, sum(gross) - paid_in - coalesce(sum(paid_out), 0) AS profit, paid_in + coalesce(sum(paid_out), 0) AS commission FROM u GROUP BY symbol, dir, entry_bar, entry_price, paid_in)"""
_HELD = """q AS (SELECT b.symbol, b.i, b.close, coalesce((SELECT sum(dir) FROM u WHERE u.symbol = b.symbol AND entry_bar <= b.i AND coalesce(exit_bar > b.i, true)), 0) AS position, coalesce((SELECT sum(dir * entry_price) FROM u WHERE u.symbol = b.symbol AND entry_bar <= b.i AND coalesce(exit_bar > b.i, true)), 0) AS cost, coalesce((SELECT sum(gross) FROM u WHERE u.symbol = b.symbol AND exit_bar <= b.i), 0) - coalesce((SELECT sum(comm) FROM f WHERE f.symbol = b.symbol AND f.i <= b.i), 0) AS realized,
 (SELECT count(*) FROM l WHERE l.symbol = b.symbol AND entry_bar <= b.i AND (l.open OR exit_bar > b.i)) AS opentrades FROM b),
d AS (SELECT b.symbol, b.i, count(l.n) AS closedtrades, count(CASE WHEN profit > 0 THEN 1 END) AS wintrades, count(CASE WHEN profit < 0 THEN 1 END) AS losstrades, count(CASE WHEN profit = 0 THEN 1 END) AS eventrades, coalesce(sum(CASE WHEN profit > 0 THEN profit END), 0) AS won, coalesce(-sum(CASE WHEN profit < 0 THEN profit END), 0) AS lost FROM b LEFT JOIN l ON l.symbol = b.symbol AND NOT l.open AND exit_bar <= b.i GROUP BY 1, 2),
e AS (SELECT q.*, d.* EXCLUDE (symbol, i), CASE WHEN position <> 0 THEN close * position - cost ELSE 0 END AS gain, 100000 + realized + CASE WHEN position <> 0 THEN close * position - cost ELSE 0 END AS equity FROM q JOIN d USING (symbol, i)),
y AS (SELECT *, max(equity) OVER z AS peak, min(equity) OVER z AS trough FROM e WINDOW z AS (PARTITION BY symbol ORDER BY i))"""
_OVER = "OVER (PARTITION BY symbol ORDER BY i)"
_ACCOUNT = {"equity": "equity", "position": "position", "avg_price": "CASE WHEN position <> 0 THEN cost / position END", "open_profit": "gain", "open_profit_percent": "100 * gain / (100000 + realized)", "opentrades": "opentrades", "closedtrades": "closedtrades", "wintrades": "wintrades", "losstrades": "losstrades", "eventrades": "eventrades", "grossprofit": "won", "grossloss": "lost", "netprofit": "won - lost", "grossprofit_percent": "won / 1000", "grossloss_percent": "lost / 1000", "netprofit_percent": "(won - lost) / 1000", "max_drawdown": f"max(peak - equity) {_OVER}", "max_runup": f"max(equity - trough) {_OVER}", "max_drawdown_percent": f"max(peak - equity) {_OVER} / 1000", "max_runup_percent": f"max(equity - trough) {_OVER} / 1000", "max_held": f"max(abs(position)) {_OVER}", "max_held_long": f"greatest(max(position) {_OVER}, 0)", "max_held_short": f"greatest(-min(position) {_OVER}, 0)"}
_TRADE = {"qty": "qty", "closed_qty": "closed_qty", "entry_price": "entry_price", "exit_price": "exit_price", "profit": "profit", "profit_percent": "100 * profit / (entry_price * qty)", "commission": "commission", "max_runup": "qty * greatest(0, up)", "max_drawdown": "qty * greatest(0, down)"}

_DAY_SESSION = "hm >= 525 AND hm < 825"


def _opening(day: str, name: str) -> str:
    return f"CASE WHEN {_DAY_SESSION} THEN CAST(epoch(CAST({day} AS TIMESTAMP)) AS BIGINT) * 1000 + (525 - 480) * 60000 ELSE -1 END AS {name}"


QUERIES = {f.__name__: f for f in (strategy_reversal_trades, strategy_reversal_equity, strategy_statistics, strategy_ladder_trades, strategy_ladder_account, strategy_ladder_statistics, strategy_brackets, guard_entries, rank_movers, rank_top_per_group, rank_missing_members, technical_rating, technical_rating_full, time_fields, time_back)}
SQL = {
    "strategy_reversal_trades": f"{_WITH}, {_SIG} SELECT symbol, entry_bar, exit_bar, CAST(dir AS INT) AS dir, {sql_shown({'qty': '1', 'entry_price': 'entry_price', 'exit_price': 'exit_price', 'profit': '(exit_price - entry_price) * dir - CASE WHEN n = 1 THEN 0.1 ELSE 0 END - 0.2', 'commission': 'CASE WHEN n = 1 THEN 0.3 ELSE 0.2 END'})} FROM s WHERE exit_bar IS NOT NULL",
    "strategy_reversal_equity": f"{_WITH}, {_ACC} SELECT symbol, i, {sql_shown({'equity': 'equity', 'position': 'position', 'avg_price': 'avg_price', 'open_profit': 'open_profit', 'max_drawdown': 'max(peak - equity) OVER (PARTITION BY symbol ORDER BY i)', 'max_runup': 'max(equity - trough) OVER (PARTITION BY symbol ORDER BY i)', 'max_held': 'max(abs(position)) OVER (PARTITION BY symbol ORDER BY i)'})} FROM q",
    "strategy_statistics": f"{_WITH}, {_SIG}, c AS (SELECT symbol, entry_price, (exit_price - entry_price) * dir AS p FROM s WHERE exit_bar IS NOT NULL) SELECT symbol, {sql_shown(_STAT)} FROM c GROUP BY symbol",
    "strategy_ladder_trades": f"{_WITH}, {_LADDER}, m AS (SELECT symbol, max(i) AS m FROM b GROUP BY 1), r AS (SELECT l.symbol, l.n, max(CASE WHEN dir > 0 THEN high - entry_price ELSE entry_price - low END) AS up, max(CASE WHEN dir > 0 THEN entry_price - low ELSE high - entry_price END) AS down FROM l JOIN m USING (symbol) JOIN b ON b.symbol = l.symbol AND b.i BETWEEN entry_bar AND CASE WHEN l.open THEN m.m ELSE exit_bar END GROUP BY 1, 2) SELECT symbol, CAST(n AS INT) AS n, dir, entry_bar, coalesce(exit_bar, -1) AS exit_bar, open, {sql_shown(_TRADE)} FROM l JOIN r USING (symbol, n)",
    "strategy_ladder_account": f"{_WITH}, {_LADDER}, {_HELD} SELECT symbol, i, {sql_shown(_ACCOUNT)} FROM y",
    "strategy_ladder_statistics": f"{_WITH}, {_LADDER}, c AS (SELECT symbol, entry_price * qty AS entry_price, profit AS p FROM l WHERE NOT open) SELECT symbol, {sql_shown(_STAT)} FROM c GROUP BY symbol",
    "guard_entries": f"WITH {_INTENTS} SELECT k AS intent, array_to_string(hs, ',') AS hits, CAST(verdict AS INT) AS verdict, CASE WHEN verdict <> 1 THEN q WHEN k % 5 <> 0 THEN greatest(1.0, floor(q / 2)) ELSE q / 2 END AS allowed FROM w",
    "rank_movers": f"{_WITH}, d AS (SELECT symbol, t - t % 86400 AS t, last(close ORDER BY t) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2), m AS (SELECT *, coalesce(CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY t) > 0 THEN 100 * (close - lag(close) OVER (PARTITION BY symbol ORDER BY t)) / lag(close) OVER (PARTITION BY symbol ORDER BY t) END, 0) AS change, close * volume AS amount FROM d) {_MOVERS}",
    "rank_top_per_group": "SELECT p_brand, rank, p_partkey, p_retailprice FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part) WHERE rank <= 3",
    "rank_missing_members": "SELECT c_mktsegment, count(*) AS n FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey GROUP BY 1",
    "technical_rating": f"{_WITH}, w AS (SELECT *, [{', '.join(_VOTES)}] AS vs, {_OSC['st']} AS st FROM b), x AS (SELECT *, list_avg(list_filter(vs, lambda v: v IS NOT NULL)) AS ma, CASE WHEN st IS NOT NULL THEN (CASE WHEN st < 20 THEN 1 WHEN st > 80 THEN -1 ELSE 0 END + CASE WHEN st - 100 < -80 THEN 1 WHEN st - 100 > -20 THEN -1 ELSE 0 END) / 2 END AS osc FROM w) SELECT symbol, t, CASE WHEN (ma + osc) / 2 > 0.5 THEN 'strong buy' WHEN (ma + osc) / 2 > 0.1 THEN 'buy' WHEN (ma + osc) / 2 >= -0.1 THEN 'neutral' WHEN (ma + osc) / 2 >= -0.5 THEN 'sell' WHEN ma + osc IS NOT NULL THEN 'strong sell' END AS band, {sql_shown({'ma': 'ma', 'osc': 'osc'})} FROM x",
    "time_back": f"{_WITH}, l AS (SELECT *, {_LOCAL} AS w FROM b), m AS (SELECT *, CAST(w AS DATE) AS d, hour(w) * 60 + minute(w) AS hm, list_filter(list_transform(range(1, 30), lambda k: CAST(CAST(w AS DATE) - CAST(k AS INT) AS DATE)), lambda x: isodow(x) < 6) AS days FROM l) SELECT symbol, t, {_opening('d', 'session')}, {_opening('days[1]', 'session_1')}, {_opening('days[8]', 'session_8')}, CASE WHEN {_DAY_SESSION} THEN t * 1000 ELSE -1 END AS bar_in_session, CASE WHEN {_floor_change('d')} THEN (t - 259200) * 1000 ELSE -1 END AS day_3, CASE WHEN {_floor_change("date_trunc('week', w)")} THEN (t - 1209600) * 1000 ELSE -1 END AS week_2, CASE WHEN {_floor_change('month(w)')} THEN CAST(epoch_ms(CAST(date_trunc('month', to_timestamp(t) AT TIME ZONE 'UTC') - INTERVAL 1 MONTH AS TIMESTAMP)) AS BIGINT) ELSE -1 END AS month_1, CASE WHEN {_floor_change('t // 14400')} THEN (t - 28800) * 1000 ELSE -1 END AS hours_2 FROM m",
    "time_fields": f"{_WITH}, l AS (SELECT *, {_LOCAL} AS w FROM b), m AS (SELECT *, hour(w) * 60 + minute(w) AS hm FROM l) SELECT symbol, t, CAST(year(w) AS INT) AS year, CAST(month(w) AS INT) AS month, CAST(day(w) AS INT) AS dayofmonth, CAST(hour(w) AS INT) AS hour, CAST(minute(w) AS INT) AS minute, CAST(second(w) AS INT) AS second, CAST(dayofweek(w) + 1 AS INT) AS dayofweek, CAST(weekofyear(w) AS INT) AS weekofyear, hm >= 525 AND hm < 825 AS in_day, hm >= 900 OR hm < 300 AS in_night, {_floor_change('CAST(w AS DATE)')} AS new_day, {_floor_change(chr(40) + 'date_trunc(' + chr(39) + 'week' + chr(39) + ', w))')} AS new_week, {_floor_change('month(w)')} AS new_month, CASE WHEN {_floor_change('t // 14400')} THEN t * 1000 ELSE -1 END AS opens_4h, (t // 86400 + 1) * 86400000 AS closes_day FROM m",
}
