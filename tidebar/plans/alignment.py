"""Timeframes side by side, and ticks after events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import bars as B
from ..operators import flow as W
from ..operators import rolling as R
from .common import BARS_SQL, hourly, shown, sql_full, sql_shown, table

KEYS = ["symbol", "t"]


def _daily(bars: DataFrame) -> DataFrame:
    return B.resample(bars, "D").withColumn("mean3", R.sma("close", 3))


def mtf_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes and their mean at each hour: without and with lookahead, with gaps, and an hour's own history of the result."""
    chart = hourly(spark, sf_dir)
    day = _daily(chart)
    off = A.security(chart, day, "D", ["close", "mean3"], 3600).select(*chart.columns, F.col("other.close").alias("off"), F.col("other.mean3").alias("off_mean"))
    on = A.security(off, day, "D", ["close"], 3600, lookahead=True).select(*off.columns, F.col("other.close").alias("on"))
    gaps = A.security(on, day, "D", ["close"], 3600, gaps=True).select(*on.columns, F.col("other.close").alias("gap"))
    gaps = gaps.withColumn("off_before", R.ago("off"))
    return shown(gaps, KEYS, {c: c for c in ("close", "off", "off_mean", "on", "gap", "off_before")})


def mtf_security_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly closes inside each day: how many, first, last and sum."""
    lower = hourly(spark, sf_dir)
    out = A.security_lower(B.resample(lower, "D"), lower, "D", "close")
    v = F.col("values")
    return shown(out, KEYS, {"n": F.size(v), "first": F.try_element_at(v, F.lit(1)), "last": F.try_element_at(v, F.lit(-1)), "total": F.aggregate(v, F.lit(0.0), lambda a, x: a + x)})


def trade_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runup and drawdown of trades that open on every bar and close seven bars later."""
    b = hourly(spark, sf_dir)
    last = b.groupBy("symbol").agg(F.max("i").alias("last"))
    trades = b.join(last, "symbol").select("symbol", F.col("i").alias("entry"), F.least(F.col("i") + 7, F.col("last")).alias("exit"), F.when(F.col("i") % 2 == 0, 1).otherwise(-1).alias("dir"), F.col("open").alias("price"))
    return shown(A.excursions(trades, b), ["symbol", "entry", "exit", "dir"], {"runup": "runup", "drawdown": "drawdown"})


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.event_ticks(table(spark, sf_dir, "events"))
    return W.with_direction(t.withColumn("amount", F.col("price") * F.col("volume")))


def flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of each tick."""
    return _ticks(spark, sf_dir).select("symbol", "t", "seq", "dir")


def flow_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed volume per minute and size band, and its running sums."""
    names = [n for b, _ in W.BANDS for n in (b, f"cum_{b}")]
    return shown(W.band_flow(_ticks(spark, sf_dir)), ["symbol", "minute"], {n: n for n in names})


def flow_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks by size of amount."""
    return W.histogram(_ticks(spark, sf_dir), [20.0, 50.0, 100.0, 200.0, 400.0])


def flow_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and change over the complete bars of the last hours."""
    out = W.rolling_statistics(hourly(spark, sf_dir), (5, 24), 3600)
    return shown(out, KEYS, {f"{n}_{w}": f"{n}_{w}" for w in (5, 24) for n in ("volume", "buy", "sell", "change")})


def flow_large_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large prints, clusters of them, and streaks."""
    return W.large_prints(_ticks(spark, sf_dir), 150.0, 60.0, 3, 20_000).select("symbol", "t", "seq", "print", "streak").where("print is not null or streak > 1")


def flow_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the price did 1, 4 and 24 hours after each tick."""
    t = _ticks(spark, sf_dir).groupBy("symbol", "t").agg(F.min("price").alias("price"))
    return shown(W.forward_returns(t, t, (60, 240, 1440)), KEYS, {f"ret_{m}": f"ret_{m}" for m in (60, 240, 1440)})


def flow_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversal alerts of the net flow of ten hours."""
    return shown(W.reversals(W.net_flow(_ticks(spark, sf_dir), 60.0, 36_000), 100.0, 60.0, 7_200, 36_000, 7_200), ["symbol", "t", "seq"], {"net": "net", "alert": "alert"})


def tick_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks without those whose symbol, second and rounded price came before."""
    t = B.event_ticks(table(spark, sf_dir, "events")).withColumn("price", F.floor(F.col("price") / 10).cast("long")).withColumn("t", (F.floor(F.col("t") / 600) * 600).cast("long"))
    return B.dedup(t, ["symbol", "t", "price"], ["seq"]).select("symbol", "t", "seq", "price")


_WITH = f"WITH {BARS_SQL}"
_DAYS = f"d0 AS (SELECT symbol, t - t % 86400 AS t, first(open ORDER BY t) AS open, last(close ORDER BY t) AS close FROM bars GROUP BY 1, 2), d AS (SELECT *, {sql_full(3, 'avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS 2 PRECEDING)')} AS mean3, coalesce(lead(t) OVER (PARTITION BY symbol ORDER BY t), t + 86400) AS avail FROM d0)"
_TICKS = "k0 AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, value AS price, 1.0 AS volume, value AS amount FROM events), k1 AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY t, seq)), 0) AS s FROM k0), k AS (SELECT *, CAST(coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 0) AS INT) AS dir FROM k1)"
_BAND = "CASE " + " ".join(f"WHEN amount >= {x} THEN '{b}'" for b, x in W.BANDS) + f" ELSE '{W.BANDS[-1][0]}' END"
_ROLL = {}
for _w in (5, 24):
    _f = f"OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {_w * 3600} PRECEDING AND 1 PRECEDING)"
    _ROLL |= {f"volume_{_w}": f"coalesce(sum(volume) {_f}, 0)", f"buy_{_w}": f"coalesce(sum(CASE WHEN close > open THEN volume END) {_f}, 0)", f"sell_{_w}": f"coalesce(sum(CASE WHEN close < open THEN volume END) {_f}, 0)", f"change_{_w}": f"100 * (last_value(close) {_f} - first_value(open) {_f}) / nullif(first_value(open) {_f}, 0)"}
_NEAR = "OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 20000 PRECEDING AND CURRENT ROW)"

QUERIES = {f.__name__: f for f in (mtf_security, mtf_security_lower, trade_excursions, flow_direction, flow_bands, flow_histogram, flow_rolling, flow_large_prints, flow_forward_returns, flow_reversals, tick_dedup)}
SQL = {
    "mtf_security": f"{_WITH}, {_DAYS}, x AS (SELECT b.*, d.close AS off, d.mean3 AS off_mean, d.t AS dt FROM b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.t >= d.avail), y AS (SELECT x.*, d.close AS onn FROM x ASOF LEFT JOIN d ON x.symbol = d.symbol AND x.t + 3599 >= d.t) SELECT symbol, t, "
    + sql_shown({"close": "close", "off": "off", "off_mean": "off_mean", "\"on\"": "onn", "gap": "CASE WHEN dt IS DISTINCT FROM lag(dt) OVER (PARTITION BY symbol ORDER BY t) THEN off END", "off_before": "lag(off) OVER (PARTITION BY symbol ORDER BY t)"}) + " FROM y",
    "mtf_security_lower": f"{_WITH} SELECT symbol, t - t % 86400 AS t, {sql_shown({'n': 'count(*)', 'first': 'first(close ORDER BY t)', 'last': 'last(close ORDER BY t)', 'total': 'sum(close)'})} FROM bars GROUP BY 1, 2",
    "trade_excursions": f"{_WITH}, tr AS (SELECT b.symbol, b.i AS entry, least(b.i + 7, l.m) AS exit, CASE WHEN b.i % 2 = 0 THEN 1 ELSE -1 END AS dir, b.open AS price FROM b JOIN (SELECT symbol, max(i) AS m FROM b GROUP BY 1) l USING (symbol)) SELECT tr.symbol, entry, exit, dir, {sql_shown({'runup': 'greatest(0, max(CASE WHEN dir > 0 THEN high - price ELSE price - low END))', 'drawdown': 'greatest(0, max(CASE WHEN dir > 0 THEN price - low ELSE high - price END))'})} FROM tr JOIN b ON b.symbol = tr.symbol AND b.i BETWEEN entry AND exit GROUP BY 1, 2, 3, 4",
    "flow_direction": f"WITH {_TICKS} SELECT symbol, t, seq, dir FROM k",
    "flow_bands": f"WITH {_TICKS}, m AS (SELECT symbol, t - t % 60 AS minute, " + ", ".join(f"coalesce(sum(CASE WHEN {_BAND} = '{b}' THEN dir * volume END), 0) AS {b}" for b, _ in W.BANDS) + " FROM k GROUP BY 1, 2) SELECT symbol, minute, " + sql_shown({n: e for b, _ in W.BANDS for n, e in ((b, b), (f"cum_{b}", f"sum({b}) OVER (PARTITION BY symbol ORDER BY minute)"))}) + " FROM m",
    "flow_histogram": f"WITH {_TICKS} SELECT symbol, CAST((amount >= 20)::INT + (amount >= 50)::INT + (amount >= 100)::INT + (amount >= 200)::INT + (amount >= 400)::INT AS INT) AS bin, count(*) AS n FROM k GROUP BY 1, 2",
    "flow_rolling": f"{_WITH} SELECT symbol, t, {sql_shown(_ROLL)} FROM b",
    "flow_large_prints": f"WITH {_TICKS}, l AS (SELECT *, amount >= 60 AS big, sum((amount < 60)::INT) OVER (PARTITION BY symbol ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run, count(CASE WHEN amount >= 60 THEN 1 END) {_NEAR} AS n, min(CASE WHEN amount >= 60 THEN dir END) {_NEAR} AS lo, max(CASE WHEN amount >= 60 THEN dir END) {_NEAR} AS hi FROM k), o AS (SELECT symbol, t, seq, CASE WHEN amount >= 150 THEN 'L1' WHEN big AND n >= 3 AND lo = hi AND lo <> 0 THEN 'L2' END AS print, CAST(sum(big::INT) OVER (PARTITION BY symbol, run ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM l) SELECT * FROM o WHERE print IS NOT NULL OR streak > 1",
    "flow_forward_returns": f"WITH {_TICKS}, p AS (SELECT symbol, t, min(price) AS price FROM k GROUP BY 1, 2), " + ", ".join(f"x{m} AS (SELECT p.symbol, p.t, 100 * (q.price - p.price) / nullif(p.price, 0) AS ret FROM p ASOF LEFT JOIN p q ON p.symbol = q.symbol AND p.t + {m * 60} <= q.t)" for m in (60, 240, 1440)) + " SELECT p.symbol, p.t, " + sql_shown({f"ret_{m}": f"x{m}.ret" for m in (60, 240, 1440)}) + " FROM p JOIN x60 USING (symbol, t) JOIN x240 USING (symbol, t) JOIN x1440 USING (symbol, t)",
    "flow_reversals": f"WITH RECURSIVE {_TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t, seq) AS i, coalesce(sum(CASE WHEN amount >= 60 THEN amount * dir END) {_NEAR.replace('20000', '36000')}, 0) AS net, "
    f"coalesce(max(CASE WHEN amount >= 60 AND dir = 1 THEN 1 END) {_NEAR.replace('20000', '7200')}, 0) AS bought, coalesce(max(CASE WHEN amount >= 60 AND dir = -1 THEN 1 END) {_NEAR.replace('20000', '7200')}, 0) AS sold FROM k), "
    # each tick's own window of net flows, of which an anchor leaves the later ones
    f"w AS MATERIALIZED (SELECT a.*, l.seen FROM n a JOIN (SELECT x.symbol, x.i, list({{'t': y.t, 'net': y.net}}) AS seen FROM n x JOIN n y ON y.symbol = x.symbol AND y.i <= x.i AND y.t >= x.t - 36000 GROUP BY 1, 2) l USING (symbol, i)), "
    "r(symbol, t, seq, i, net, peak_from, trough_from, fired, alert) AS (SELECT symbol, t, seq, i, net, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM w WHERE i = 1 UNION ALL SELECT symbol, t, seq, i, net, CASE WHEN alert = 1 THEN t ELSE peak_from END, CASE WHEN alert = -1 THEN t ELSE trough_from END, CASE WHEN alert <> 0 THEN t ELSE fired END, alert FROM ("
    "SELECT *, CASE WHEN t - fired < 7200 THEN 0 WHEN sold = 1 AND peak >= 200 AND peak - net >= 100 AND (peak - net) / peak >= 0.3 THEN 1 WHEN bought = 1 AND trough <= -200 AND net - trough >= 100 AND (net - trough) / abs(trough) >= 0.3 THEN -1 ELSE 0 END AS alert FROM ("
    "SELECT w.symbol, w.t, w.seq, w.i, w.net, w.bought, w.sold, p.peak_from, p.trough_from, p.fired, list_max(list_transform(list_filter(w.seen, lambda z: z.t >= p.peak_from), lambda z: z.net)) AS peak, list_min(list_transform(list_filter(w.seen, lambda z: z.t >= p.trough_from), lambda z: z.net)) AS trough FROM r p JOIN w ON w.symbol = p.symbol AND w.i = p.i + 1))) "
    f"SELECT symbol, t, seq, {sql_shown({'net': 'net', 'alert': 'alert'})} FROM r WHERE alert <> 0",
    "tick_dedup": "WITH k AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS t, event_id AS seq, CAST(floor(value / 10) AS BIGINT) AS price FROM events) SELECT symbol, t, min(seq) AS seq, price FROM k GROUP BY symbol, t, price",
}
