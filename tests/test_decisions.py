"""The decision log's reports on odd lines, and the verdict that a line implies, against plain Python."""

import json
import random

from pyspark.sql import functions as F
from tidebar.operators import decisions as D


def answer(choice, confidence=None, score=None):
    return {"action_choice": {"choice": choice, "confidence": confidence}, "volatility_regime": {"score": score}}


def test_odd_lines_and_implied_verdicts(spark):
    lines = [
        ("not json", ("none", None, None, None)),
        (None, ("none", None, None, None)),
        (json.dumps({"channel": ""}), ("none", None, None, None)),
        (json.dumps({"channel": "a", "answers": answer("buy")}), ("a", "buy", None, "approve")),
        (json.dumps({"answers": answer("sell", 0.9, 2.0)}), ("none", "sell", 0.9, "veto")),
        (json.dumps({"answers": answer("buy", 0.9, 3.0)}), ("none", "buy", 0.9, "approve")),
        (json.dumps({"answers": answer("sell", 0.9)}), ("none", "sell", 0.9, "approve")),
        (json.dumps({"answers": answer("hold", 0.59)}), ("none", "hold", 0.59, "veto")),
        (json.dumps({"answers": {"action_choice": {"choice": "buy", "confidence": "high"}}}), ("none", "buy", None, "approve")),
        (json.dumps({"answers": {"action_choice": "buy"}}), ("none", None, None, None)),
        (json.dumps({"second": {"decision": "veto"}, "risk_gate": {"verdict": "block", "rules": ["a", "b", "a"]}}), ("none", None, None, None)),
    ]
    rows = D.parsed(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(lines)], "n int, line string"), "line")
    got = {r.n: (r.channel, r.choice, r.confidence, r.implied) for r in rows.collect()}
    assert [got[i] for i in range(len(lines))] == [want for _, want in lines]
    counts = {(r.kind, r.value): r.n for r in D.counters(rows).collect()}
    assert counts == {("channel", "none"): 10, ("channel", "a"): 1, ("choice", "buy"): 3, ("choice", "sell"): 2, ("choice", "hold"): 1, ("second", "veto"): 1, ("gate", "block"): 1, ("rule", "a"): 2, ("rule", "b"): 1}
    a = D.agreement(rows, F.col("n") > 8).first()
    assert (a.lines, a.choices, a.night, a.seconds, a.divergent, a.divergence) == (11, 6, 2, 1, 0, 0.0)
    none = D.parsed(spark.createDataFrame([], "line string"), "line")
    assert D.counters(none).collect() == [] and D.agreement(none, F.lit(True)).first().divergence == 0.0


def test_forward_by_choice_equals_a_walk(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(400) * 3600, r.randrange(50), r.choice([None, 0.0, 10.0, 11.5, 12.0]), r.choice(["buy", "sell", "wait", None])) for _ in range(400)]
    want: dict = {}
    for s, t, _, price, choice in rows:
        later = sorted((u, i, p) for z, u, i, p, _ in rows if z == s and u >= t + 86_400 and p is not None)
        if choice and price and later:
            want.setdefault(choice, []).append({"buy": 1, "sell": -1}.get(choice, 0) * 100 * (later[0][2] - price) / price)
    got = D.forward_by_choice(spark.createDataFrame(rows, "symbol string, t long, id int, price double, choice string").repartition(5)).collect()
    assert len(got) == len(want) == 3
    for x in got:
        w = want[x.choice]
        assert x.n == len(w) and abs(x.total - sum(w)) < 1e-6 and abs(x.won - sum(p > 0 for p in w) / len(w)) < 1e-9


def test_lines_of_one_time_are_sought_once(spark):
    """However many lines a symbol has at a time, what came later is looked up for the time, and dealt by spans."""
    rows = spark.range(40_000).selectExpr("'a' as symbol", "(id % 4) * 43200 as t", "id", "double(1 + id % 4) as price", "'buy' as choice")
    out = D.forward_by_choice(rows)
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition" in x]
    assert windows and not [x for x in windows if "_span" not in x or "choice" in x]
    assert [(r.n, r.won) for r in out.collect()] == [(20_000, 1.0)]
