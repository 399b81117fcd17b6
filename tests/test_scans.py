"""Recurrences by scans of blocks against a walk over the bars, with missing values, in one block and in many."""

import math
import random

import numpy as np
import pytest

from tidebar.operators import folds as K
from tidebar.operators import scans as L

SCHEMA = "symbol string, t long, high double, low double, close double"


def kernels() -> list[tuple]:
    return [
        (L.ema("ema", 5), ["ema"], lambda: K.Ema(5), ["close"]),
        (L.rma("rma", 4), ["rma"], lambda: K.Rma(4), ["close"]),
        (L.rsi("rsi", 6), ["rsi"], lambda: K.Rsi(6), ["close"]),
        (L.atr("atr", 5), ["atr"], lambda: K.Atr(5), ["high", "low", "close"]),
        (L.macd("macd", "signal", "hist", 3, 6, 4), ["macd", "signal", "hist"], lambda: K.Macd(3, 6, 4), ["close"]),
        (L.tsi("tsi", 3, 5), ["tsi"], lambda: K.Tsi(3, 5), ["close"]),
        (L.dmi("plus", "minus", "adx", 5, 4), ["plus", "minus", "adx"], lambda: K.Dmi(5, 4), ["high", "low", "close"]),
        (L.keltner("basis", "upper", "lower", "width", 6, 2.0), ["basis", "upper", "lower", "width"], lambda: K.Keltner(6, 2.0), ["close", "high", "low", "close"]),
        (L.ewm("ewm", 0.3, 3), ["ewm"], lambda: K.Ewm(0.3, 3), ["close"]),
    ]


def rows(gaps: float) -> list[tuple]:
    r = random.Random(11)
    out = []
    for symbol, n in (("a", 64), ("b", 9), ("c", 1), (None, 20)):
        c = 50.0
        for i in range(n):
            c = max(1.0, c + r.choice([-2.0, -0.5, 0.0, 0.0, 1.5]))
            h, lo = c + r.random(), c - r.random()
            values = [None if r.random() < gaps else v for v in (h, lo, c)]
            out.append((symbol, 100 * i + r.randrange(90), *values))
    return out


@pytest.mark.parametrize("block,gaps", [(8, 0.0), (8, 0.08), (4096, 0.08), (6, 0.3)])
def test_scans_equal_a_walk(spark, block, gaps):
    data = rows(gaps)
    bars = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = L.evaluate(L.scan(bars, [L.Recurrence("p", ("close",), L.ema_steps(2))], span=700, block=block, place="i"), [k[0] for k in kernels()], 700, block).collect()
    assert len(got) == len(data)
    for symbol in ("a", "b", "c", None):
        mine = sorted((x for x in got if x.symbol == symbol), key=lambda x: x.t)
        assert [x.i for x in mine] == list(range(len(mine)))
        for _, names, make, inputs in kernels():
            kernel = make()
            for x in mine:
                want = kernel.step(*[x[c] for c in inputs])
                for name, v in zip(names, want, strict=True):
                    assert (x[name] is None) == (v is None), (symbol, x.i, name, x[name], v)
                    assert v is None or math.isclose(x[name], v, rel_tol=1e-9, abs_tol=1e-9), (symbol, x.i, name)


def test_one_symbol_is_several_tasks(spark):
    bars = spark.createDataFrame([("a", i, 2.0, 1.0, float(i % 5)) for i in range(64)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the blocks of a test are small enough for one task
    try:
        out = L.scan(bars, [L.Recurrence("p", ("close",), L.ema_steps(5))], span=8, place="i")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out.inputFiles()) > 1  # a file for each task that worked on blocks
    assert [r.i for r in out.orderBy("t").collect()] == list(range(64))


def test_composition_is_associative_with_seeds_and_nulls():
    r = np.random.default_rng(3)
    n = 200
    a, b, s = r.normal(size=n), r.normal(size=n), r.normal(size=n)
    b[r.random(n) < 0.2] = np.nan
    s[r.random(n) < 0.3] = np.nan
    for start in (np.nan, 1.5):
        p, want = start, []
        for i in range(n):
            p = s[i] if np.isnan(p) else a[i] * p + b[i]
            want.append(p)
        got = L.values(L.prefixes(a, b, s), np.array(start))
        assert np.allclose(got, want, equal_nan=True, rtol=1e-6)


def test_a_reach_over_many_pieces(spark):
    bars = spark.createDataFrame([("a", i, 2.0, 1.0, None if i == 33 else float(i % 5)) for i in range(64)], SCHEMA)
    kernel = K.Rma(19)
    want = [kernel.step(r.close)[0] for r in bars.orderBy("t").collect()]
    for span, block in ((10, 2), (1000, 7), (3, 4096)):
        got = [r.r for r in L.evaluate(bars, [L.rma("r", 19)], span, block).orderBy("t").collect()]
        assert [v is None for v in got] == [v is None for v in want] and all(v is None or math.isclose(v, w) for v, w in zip(got, want, strict=True))


def test_empty(spark):
    assert L.evaluate(spark.createDataFrame([], SCHEMA), [L.ema("e", 3), L.macd("m", "s", "h")]).count() == 0


@pytest.mark.parametrize("block", [8, 4096])
def test_corrections_equal_a_full_run_and_touch_only_what_changed(spark, block):
    data = [r for r in rows(0.05) if r[0] is not None]
    recurrences = [r for x in (L.ema("ema", 5), L.rma("rma", 6), L.rsi("rsi", 4)) for r in x.first]
    names, columns = [r.name for r in recurrences], ["high", "low", "close"]
    old = [r for n, r in enumerate(data) if n != 30]  # a late bar of a
    old = [(*r[:4], 70.0) if n == 50 else r for n, r in enumerate(old)] + [("b", 5000, 1.0, 1.0, 1.0)]  # a rewritten one, and one of b that is gone
    stored = L.scan(spark.createDataFrame(old, SCHEMA), recurrences, span=700, block=block).cache()
    bars = spark.createDataFrame(data + [("d", 1, 2.0, 1.0, 1.5)], SCHEMA)
    got = {(r.symbol, r.t): r for r in L.corrected(stored, bars, recurrences, columns, span=700, block=block).collect()}
    want = {(r.symbol, r.t): r for r in L.scan(bars, recurrences, span=700, block=block).collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        for n in names:
            assert (got[key][n] is None) == (r[n] is None) and (r[n] is None or math.isclose(got[key][n], r[n], rel_tol=1e-9, abs_tol=1e-9)), (key, n)
    assert {k for k, r in got.items() if r.recomputed} == {(s, t) for s, t, *_ in data if s == "a" and t >= data[30][1]} | {("d", 1)}
