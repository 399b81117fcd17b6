"""Reports of a decision log whose JSON lines are made of all line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as D
from .common import shown, sql_shown, table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, t, id, price, line): one line of JSON for each line item, some without an answer, a channel or a second opinion."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("symbol"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp_ntz").cast("timestamp")).alias("day"))
    li, n = table(spark, sf_dir, "lineitem").join(o, "l_orderkey"), F.col("l_linenumber").cast("int")
    choice = F.when(F.col("l_returnflag") == "R", "buy").when(F.col("l_returnflag") == "A", "sell").otherwise("hold")
    answers = F.struct(F.struct(choice.alias("choice"), (F.col("l_discount").cast("double") * 10).alias("confidence")).alias("action_choice"), F.struct((F.col("l_tax").cast("double") * 50).alias("score")).alias("volatility_regime"))
    second = F.struct(F.when(n % 3 == 1, "Approve").alias("verdict"), F.when(n % 3 == 2, "veto").alias("decision"))
    gate = F.struct(F.when(n > 4, "block").otherwise("pass").alias("verdict"), F.split("symbol", "-").alias("rules"))
    line = F.to_json(F.struct(F.when(n % 4 == 0, "").otherwise(F.concat("l_linestatus", F.year("l_shipdate").cast("string"))).alias("channel"), F.when(n != 6, answers).alias("answers"), second.alias("second"), F.when(n > 1, gate).alias("risk_gate")))
    return li.select("symbol", (F.col("day") + n * 3600 * 5).alias("t"), ((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")) * 10 + n).alias("id"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price"), F.when(n == 7, "no JSON").otherwise(line).alias("line"))


def report_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices, channels, second opinions, verdicts and rules of the risk gate, counted."""
    return D.counters(D.parsed(_log(spark, sf_dir), "line"))


def report_decision_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence, lines at night, and how often the second opinion differs from the implied verdict."""
    a = D.agreement(D.parsed(_log(spark, sf_dir), "line"), F.floor(F.col("t") / 3600) % 24 + 8 >= 15)
    return shown(a, ["lines", "choices", "night", "seconds", "divergent"], {"confidence": "confidence", "divergence": "divergence"})


def report_decision_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What prices did in the day after each choice."""
    return shown(D.forward_by_choice(D.parsed(_log(spark, sf_dir), "line")), ["choice", "n"], {c: c for c in ("mean", "total", "won")})


_LOG = """g AS (SELECT o_orderpriority AS symbol, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + l_linenumber * 18000 AS t, (l_orderkey * 1000000 + l_partkey) * 10 + l_linenumber AS id, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS price, l_linenumber AS n,
 CASE WHEN l_linenumber = 7 OR l_linenumber % 4 = 0 THEN 'none' ELSE l_linestatus || year(l_shipdate) END AS channel, CASE WHEN l_linenumber < 6 THEN CASE l_returnflag WHEN 'R' THEN 'buy' WHEN 'A' THEN 'sell' ELSE 'hold' END END AS choice, CASE WHEN l_linenumber < 6 THEN CAST(l_discount AS DOUBLE) * 10 END AS confidence,
 CAST(l_tax AS DOUBLE) * 50 AS score, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'Approve' WHEN l_linenumber % 3 = 2 THEN 'veto' END AS second, CASE WHEN l_linenumber IN (1, 7) THEN NULL WHEN l_linenumber > 4 THEN 'block' ELSE 'pass' END AS gate, o_orderpriority AS words FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT *, CASE WHEN choice IS NOT NULL THEN CASE WHEN confidence < 0.6 OR (choice = 'sell' AND score >= 2) THEN 'veto' ELSE 'approve' END END AS implied FROM g)"""
_COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, count(*) AS n FROM v WHERE {k} IS NOT NULL GROUP BY {k}" for k in ("choice", "channel", "second", "gate"))

QUERIES = {f.__name__: f for f in (report_decision_counts, report_decision_agreement, report_decision_forward)}
SQL = {
    "report_decision_counts": f"WITH {_LOG} {_COUNTS} UNION ALL SELECT 'rule', value, count(*) FROM (SELECT unnest(string_split(words, '-')) AS value FROM v WHERE gate IS NOT NULL) GROUP BY value",
    "report_decision_agreement": f"WITH {_LOG} SELECT count(*) AS lines, count(choice) AS choices, count(*) FILTER (t // 3600 % 24 + 8 >= 15) AS night, count(second) AS seconds, count(*) FILTER (lower(second) <> implied) AS divergent, {sql_shown({'confidence': 'avg(confidence)', 'divergence': 'count(*) FILTER (lower(second) <> implied) / count(second)'})} FROM v",
    "report_decision_forward": f"WITH {_LOG}, k AS (SELECT symbol, t, first(price ORDER BY id, price) AS price FROM v GROUP BY 1, 2), f AS (SELECT v.choice, CASE v.choice WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END * 100 * (k.price - v.price) / v.price AS p FROM v ASOF JOIN k ON v.symbol = k.symbol AND k.t >= v.t + 86400 WHERE v.choice IS NOT NULL) SELECT choice, count(*) AS n, {sql_shown({'mean': 'avg(p)', 'total': 'sum(p)', 'won': 'avg((p > 0)::INT)'})} FROM f GROUP BY choice",
}
