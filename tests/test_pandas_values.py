import math

from brute import BARS, back, cci, each, ewm, random_bars, sma, stoch, true_range, ultimate, window, wma
from tidebar.operators import features


def values_of(bars):
    """Each feature at the last bar, in plain Python."""
    _, _, _, h, lo, c, v, _ = map(list, zip(*bars, strict=True))
    n = len(c)
    out = {f"sma_{k}": sma(c, k) for k in (10, 20, 30, 50, 100, 200)} | {f"ema_{k}": ewm(c, 2 / (k + 1), k) for k in (10, 20, 30, 50, 100, 200)}
    out["ichimoku_base"] = each(lambda a, b: (a + b) / 2, window(h, 26, max), window(lo, 26, min))
    out["vwma_20"] = each(lambda a, b: a / b, window([a * b for a, b in zip(c, v, strict=True)], 20, sum), window(v, 20, sum))
    out["hull_9"] = wma(each(lambda a, b: 2 * a - b, wma(c, 4), wma(c, 9)), 3)
    d = [None] + [c[i] - c[i - 1] for i in range(1, n)]
    gain, loss = (ewm(each(lambda z, s=s: max(s * z, 0.0), d), 1 / 14, 14) for s in (1, -1))
    rsi = [None if None in (g, x) or (x == 0 and g == 0) else 100.0 if x == 0 else 100 - 100 / (1 + g / x) for g, x in zip(gain, loss, strict=True)]
    out |= {"rsi_14": rsi, "stoch_k": sma(stoch(c, h, lo, 14), 3), "stoch_rsi": sma(stoch(rsi, rsi, rsi, 14), 3), "cci_20": cci([(a + b + e) / 3 for a, b, e in zip(h, lo, c, strict=True)], 20)}
    up = [0.0] + [max(h[i] - h[i - 1], 0.0) if h[i] - h[i - 1] > lo[i - 1] - lo[i] else 0.0 for i in range(1, n)]
    down = [0.0] + [max(lo[i - 1] - lo[i], 0.0) if lo[i - 1] - lo[i] > h[i] - h[i - 1] else 0.0 for i in range(1, n)]
    atr = ewm(true_range(h, lo, c), 1 / 14, 14)
    plus, minus = (each(lambda a, t: 100 * a / t, ewm(x, 1 / 14, 14), atr) for x in (up, down))
    dx = each(lambda a, b: 100 * abs(a - b) / (a + b), plus, minus)
    macd = each(lambda a, b: a - b, ewm(c, 2 / 13, 26), ewm(c, 2 / 27, 26))
    mid = [(a + b) / 2 for a, b in zip(h, lo, strict=True)]
    out |= {"atr_14": atr, "adx_14": ewm(dx, 1 / 14, 14), "macd": macd, "signal": ewm(macd, 0.2, 9), "williams_r": each(lambda a: a - 100, stoch(c, h, lo, 14)), "awesome": each(lambda a, b: a - b, sma(mid, 5), sma(mid, 34))}
    out |= {"momentum_10": each(lambda a, b: a - b, c, back(c, 10)), "bull_bear_power": each(lambda a, b, e: a - e + b - e, h, lo, ewm(c, 2 / 14, 13)), "ultimate": ultimate(h, lo, c)}
    return {k: x[-1] for k, x in out.items()}


def test_all_values_equal_the_reference(spark):
    rows = random_bars("x", 260, 15) + random_bars("y", 34, 16) + random_bars("z", 5, 17) + random_bars("w", 13, 18)
    got = {r.symbol: r for r in features.pandas_values(spark.createDataFrame(rows, BARS).repartition(3)).collect()}
    assert set(got) == set("xyzw")
    for s, r in got.items():
        want = values_of([x for x in rows if x[0] == s])
        assert set(want) == set(features.PANDAS) == set(r.asDict()) - {"symbol"}
        for k, v in want.items():
            assert (r[k] is None) == (v is None) and (v is None or math.isclose(r[k], v, rel_tol=1e-9, abs_tol=1e-9)), (s, k, r[k], v)
    assert None not in got["x"] and got["y"].ema_50 is None and got["w"].bull_bear_power is not None and got["z"].sma_10 is None
