"""Levels by anchor, statistics at ticks and symbols by column against plain walks, with nulls, ties and empty tables."""

import random

from pyspark.sql import functions as F
from tidebar.operators import flow, guard, ranking, rolling, state


def traditional(o, h, lo, c):
    p, s = (h + lo + c) / 3, h - lo
    return [p, 2 * p - lo, 2 * p - h, p + s, p - s, *[x for k in (2, 3, 4) for x in (p * k + (h - k * lo), p * k - (k * h - lo))]]


def walked(bars, developing):
    """Levels of one symbol's bars (t, open, high, low, close, anchor), bar by bar."""
    out, period, shown = {}, None, None
    for t, o, h, lo, c, anchor in bars:
        if None not in (o, h, lo, c):
            if anchor or period is None:
                if anchor and period is not None:
                    shown = traditional(*period)
                period = (o, h, lo, c)
            else:
                period = (period[0], max(period[1], h), min(period[2], lo), c)
        out[t] = (traditional(*period) if period else None) if developing else shown
    return out


def test_pivot_levels_by_anchor(spark):
    r, rows = random.Random(1), []
    for symbol in ("a", "b", "c"):
        for t in range(60):
            lo = r.randrange(10, 90)
            prices = [lo + r.randrange(9), lo + 9, lo, lo + r.randrange(9)]
            if r.random() < 0.3 or (symbol == "c" and t < 4):
                prices[r.randrange(4)] = None
            rows.append((symbol, t, *[None if p is None else float(p) for p in prices], r.choice((True, False, False, False, None))))
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, anchor boolean")
    for developing in (True, False):
        got = rolling.pivot_levels_by_anchor(df, "Traditional", F.col("anchor"), developing)
        assert got.columns == [*df.columns, "levels"]
        got = {(x.symbol, x.t): x.levels for x in got.collect()}
        for symbol in ("a", "b", "c"):
            for t, want in walked([x[1:] for x in rows if x[0] == symbol], developing).items():
                have = got[symbol, t]
                assert all(x is None for x in have) if want is None else all(abs(x - y) < 1e-9 for x, y in zip(have, want, strict=True)), (symbol, t)
    assert rolling.pivot_levels_by_anchor(df.limit(0), "DM", F.col("anchor")).collect() == []
    try:
        rolling.pivot_levels_by_anchor(df, "Woodie", F.col("anchor"), developing=True)
        raise AssertionError("Woodie doesn't develop")
    except ValueError:
        pass


def test_rolling_at_equals_a_walk(spark):
    r = random.Random(2)
    ticks = [("a", t, k, float(r.randrange(90, 110)), float(r.randrange(1, 300))) for k, t in enumerate(sorted(r.randrange(0, 2400) for _ in range(300)))] + [("a", 600, 300, 100.0, 1.0), ("b", 61, 301, 5.0, None), (None, 61, 302, 5.0, 2.0)]
    minutes = {}
    for s, t, k, p, a in ticks:
        if s:
            b = minutes.setdefault((s, t // 60 * 60), [p, p, 0.0, False])
            b[1], b[2], b[3] = p, b[2] + 1, b[3] or (a or 0) >= 250
    df = spark.createDataFrame(ticks, "symbol string, t long, seq long, price double, amount double")
    bars = spark.createDataFrame([(s, t, *b[:3]) for (s, t), b in minutes.items()], "symbol string, t long, open double, close double, volume double")
    marked = flow.with_large(bars, df, 250.0)
    assert {(x.symbol, x.t): x.large for x in marked.collect()} == {k: b[3] for k, b in minutes.items()}
    got = {x.seq: x for x in flow.rolling_at(df, marked, (5, 15)).collect()}
    assert len(got) == len(ticks)
    for s, t, k, p, _ in ticks:
        for w in (5, 15):
            inside = [b for (symbol, at), b in sorted(minutes.items()) if symbol == s and t - 60 * w <= at < t // 60 * 60]
            up, down = [b for b in inside if b[1] > b[0]], [b for b in inside if b[1] < b[0]]
            want = [sum(b[2] for b in inside), sum(b[2] for b in up), sum(b[2] for b in down), sum(b[2] * b[1] * 1000 for b in up), sum(b[2] * b[1] * 1000 for b in down), sum(b[3] for b in up), sum(b[3] for b in inside if b not in up), 100 * (p - inside[-1][0]) / inside[-1][0] if inside else 0]
            have = [got[k][f"{n}_{w}"] for n in ("volume", "buy", "sell", "buy_amount", "sell_amount", "large_buy", "large_sell", "change")]
            assert all(abs(x - y) < 1e-6 for x, y in zip(have, want, strict=True)), (k, w, have, want)


def test_foreign_by_column(spark):
    day = 86_400
    chart = spark.createDataFrame([("a", 2 * day + 5, "b"), ("a", 2 * day + 6, None), ("b", day, "a"), ("b", 3 * day, "x"), ("b", 5, "b")], "symbol string, t long, want string")
    other = spark.createDataFrame([("a", 0, 1.0), ("a", day, 2.0), ("b", day, 3.0), (None, 0, 9.0)], "symbol string, t long, close double")
    got = {(x.symbol, x.t): x.foreign and x.foreign.close for x in state.foreign_by(chart, other, F.col("want"), ["close"], "D").collect()}
    assert got == {("a", 2 * day + 5): 3.0, ("a", 2 * day + 6): None, ("b", day): 1.0, ("b", 3 * day): None, ("b", 5): None}


def test_guard_groups_and_latest_day(spark):
    rows = [(0, ["x"], -1.0), (0, None, 2.0), (1, ["x", "x", None, ""], 3.0), (None, ["x"], 1.0), (2, ["y"], None)]
    got = {x.group: (x.n, round(x.loss_rate, 3), x.pnl) for x in guard.summary_by_group(spark.createDataFrame(rows, "verdict int, hits array<string>, pnl double")).collect()}
    assert got == {"approve": (2, 0.5, 1.0), "flagged": (1, 0.0, 3.0), "rule:x": (3, 0.333, 5.0)}
    bars = spark.createDataFrame([("a", 1, 5.0, 1.0), ("b", 1, 6.0, 1.0), ("a", 4, 7.0, 1.0)], "symbol string, t int, close double, volume double")
    asked = spark.createDataFrame([(d,) for d in (0, 1, 3, 3, 4, 11, 12)], "asked int")
    got = sorted((x.asked, x.t, x.symbol) for x in ranking.latest_movers(bars, asked, "amount", 1).collect())
    assert got == [(1, 1, "b"), (3, 1, "b"), (4, 4, "a"), (11, 4, "a")]
