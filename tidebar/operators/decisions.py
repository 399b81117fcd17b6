"""A log of decisions as JSON lines: what was chosen, by which channel, what a second opinion and a risk gate said, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import asof

#: The fields of a line that are read; a field of another type counts as missing.
LINE = "channel string, answers struct<action_choice: struct<choice: string, confidence: double>, volatility_regime: struct<score: double>>, second struct<verdict: string, decision: string>, risk_gate struct<verdict: string, rules: array<string>>"
#: Fixed limits of the implied verdict: less confidence is a veto, and so is a sale at this volatility.
LEAST_CONFIDENCE, VOLATILE = 0.6, 2.0


def parsed(lines: DataFrame, text: str, no_channel: str = "none") -> DataFrame:
    """Replaces the column of JSON text by channel, choice, confidence, implied, second, gate and rules.

    implied is the verdict that choice, confidence (1 where missing) and volatility
    amount to; NULL without a choice's answer. A line that is no JSON object has
    the channel ``no_channel`` and nothing else, as has one with an empty channel.
    """
    at = F.from_json(text, LINE)
    out = lines.withColumn("_at", at).drop(text)
    action, x = F.col("_at.answers.action_choice"), F.col("_at")
    veto = (F.coalesce(action["confidence"], F.lit(1.0)) < LEAST_CONFIDENCE) | ((action["choice"] == "sell") & (x["answers"]["volatility_regime"]["score"] >= VOLATILE))
    return out.withColumns({
        "channel": F.when(x["channel"] != "", x["channel"]).otherwise(no_channel), "choice": action["choice"], "confidence": F.when(action["choice"].isNotNull(), action["confidence"]),
        "implied": F.when(action.isNotNull(), F.when(F.coalesce(veto, F.lit(False)), "veto").otherwise("approve")), "second": F.coalesce(x["second"]["verdict"], x["second"]["decision"]), "gate": x["risk_gate"]["verdict"], "rules": x["risk_gate"]["rules"],
    }).drop("_at")


def counters(rows: DataFrame) -> DataFrame:
    """(kind, value, n): how often each choice, channel, second opinion, verdict and rule of the gate occurs. One shuffle of counts."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    found = F.array(*[one(k, F.col(k)) for k in ("choice", "channel", "second", "gate")])
    rules = F.transform(F.coalesce("rules", F.array().cast("array<string>")), lambda r: one("rule", r))
    return rows.select(F.explode(F.concat(found, rules)).alias("x")).select("x.*").where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, night: Column) -> DataFrame:
    """One row: lines, choices, mean confidence, lines at night, second opinions, and how many differ from the implied verdict (a share of 0 without any)."""
    differs = F.lower("second") != F.col("implied")
    return rows.agg(
        F.count("*").alias("lines"), F.count("choice").alias("choices"), F.avg("confidence").alias("confidence"), F.count(F.when(night, 1)).alias("night"), F.count("second").alias("seconds"), F.count(F.when(differs, 1)).alias("divergent"), F.coalesce(F.try_divide(F.count(F.when(differs, 1)), F.count("second")), F.lit(0.0)).alias("divergence")
    )


def forward_by_choice(rows: DataFrame, seconds: int = 86_400) -> DataFrame:
    """(choice, n, mean, total, won): percent from a line's price to that of its symbol's first line no earlier than ``seconds`` later, turned round for a sale and 0 for neither.

    Lines are (symbol, t, id, price, choice); of lines at one time the one with the
    smallest id counts, and of several with that id the lowest price. Lines without a choice, a price or a later line are left out.
    """
    # a row for each time: the line that can be found there, and what is found from there
    line = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("price").cast("double").alias("price"))
    times = rows.groupBy("symbol", F.col("t").cast("long").alias("t")).agg(F.min(F.when(F.col("price").isNotNull(), line)).alias("first"))
    begin = F.col("t") + seconds
    later = asof(times.select("symbol", "t"), times.where("first is not null"), begin, F.col("t"), F.col("first.price"), "_later", ["symbol"], forward=True, times=(begin, F.col("t")))
    later = later.select(F.struct("symbol", "t").alias("_of"), "_later")
    later = rows.where("choice is not null").join(later, F.struct("symbol", F.col("t").cast("long").alias("t")) == F.col("_of"))
    way = F.when(F.col("choice") == "buy", 1).when(F.col("choice") == "sell", -1).otherwise(0)
    out = later.withColumn("_p", way * 100 * F.try_divide(F.col("_later") - F.col("price"), F.col("price"))).where("_p is not null")
    return out.groupBy("choice").agg(F.count("*").alias("n"), F.avg("_p").alias("mean"), F.sum("_p").alias("total"), F.avg((F.col("_p") > 0).cast("double")).alias("won"))
