"""The paper ledger over ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from .alignment import _TICKS, _ticks
from .common import shown, sql_shown


def paper_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders made of every tick: fills, and closes at stop or target."""
    ticks = _ticks(spark, sf_dir)
    k, p = F.col("seq"), F.col("price")
    orders = ticks.select(
        k.alias("order_id"), "symbol", "t", "seq", F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.when(k % 3 == 0, "LIMIT").when(k % 3 == 1, "STOP").otherwise("MARKET").alias("type"), (p * F.when(k % 2 == 0, F.when(k % 3 == 0, 0.8).otherwise(1.2)).otherwise(F.when(k % 3 == 0, 1.2).otherwise(0.8))).alias("level"),
        F.when(k % 4 != 0, p * F.when(k % 2 == 0, 0.5).otherwise(2.0)).alias("stop_loss"), (p * F.when(k % 2 == 0, 1.6).otherwise(0.6)).alias("take_profit"), (k % 5 + 1).cast("double").alias("qty"), F.when(k % 7 == 0, F.col("t") + 20_000).alias("cancel_t"),
    )
    out = L.replay(ticks, orders)
    return shown(out, ["order_id", "symbol", "side", "fill_t"], {"fill_price": "fill_price", "exit_t": "exit_t", "exit_price": "exit_price", "pnl": "pnl"})


_ORDERS = """o AS (SELECT seq AS order_id, symbol, t, seq, seq % 2 = 0 AS buy, seq % 3 AS ty, price AS p0, price * CASE WHEN seq % 2 = 0 THEN CASE WHEN seq % 3 = 0 THEN 0.8 ELSE 1.2 END ELSE CASE WHEN seq % 3 = 0 THEN 1.2 ELSE 0.8 END END AS level,
  CASE WHEN seq % 4 <> 0 THEN price * CASE WHEN seq % 2 = 0 THEN 0.5 ELSE 2.0 END END AS sl, price * CASE WHEN seq % 2 = 0 THEN 1.6 ELSE 0.6 END AS tp, seq % 5 + 1 AS qty, CASE WHEN seq % 7 = 0 THEN t + 20000 END AS ct FROM k),
f AS (SELECT o.order_id, o.symbol, o.buy, o.sl, o.tp, o.qty, k.t AS ft, k.seq AS fs, CASE WHEN ty = 0 THEN CASE WHEN buy THEN least(level, k.price) ELSE greatest(level, k.price) END ELSE k.price END AS fp, true AS here FROM o JOIN k ON k.symbol = o.symbol AND (k.t, k.seq) > (o.t, o.seq) AND (ct IS NULL OR k.t < ct) AND CASE WHEN (ty = 0) = buy THEN k.price <= level ELSE k.price >= level END WHERE ty <> 2 QUALIFY row_number() OVER (PARTITION BY o.order_id ORDER BY k.t, k.seq) = 1
  UNION ALL SELECT order_id, symbol, buy, sl, tp, qty, t, seq, p0, false FROM o WHERE ty = 2),
x AS (SELECT f.order_id, k.t AS et, k.price AS ep FROM f JOIN k ON k.symbol = f.symbol AND ((k.t, k.seq) > (f.ft, f.fs) OR (f.here AND k.seq = f.fs)) AND CASE WHEN buy THEN k.price >= tp OR k.price <= sl ELSE k.price <= tp OR k.price >= sl END QUALIFY row_number() OVER (PARTITION BY f.order_id ORDER BY k.t, k.seq) = 1)"""

QUERIES = {"paper_ledger": paper_ledger}
SQL = {"paper_ledger": f"WITH {_TICKS}, {_ORDERS} SELECT f.order_id, symbol, CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS side, ft AS fill_t, {sql_shown({'fill_price': 'fp', 'exit_t': 'et', 'exit_price': 'ep', 'pnl': '(ep - fp) * CASE WHEN buy THEN 1 ELSE -1 END * qty'})} FROM f LEFT JOIN x USING (order_id)"}
