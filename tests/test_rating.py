import math

from brute import BARS, back, cci, each, ema, random_bars, rma, sma, stoch, true_range, ultimate, window, wma
from tidebar.operators import rating


def votes_of(bars):
    """The 26 votes of each bar, by the rules of the script one by one, and the (bar, vote) whose crossing hangs on the last bit of a mean."""
    _, _, _, h, lo, c, v, _ = map(list, zip(*bars, strict=True))
    n = len(c)
    less = lambda a, b: a is not None and b is not None and b - a > 1e-10
    one = {f"sma_{k}": sma(c, k) for k in (10, 20, 30, 50, 100, 200)} | {f"ema_{k}": ema(c, k) for k in (10, 20, 30, 50, 100, 200)}
    pv = [a * b for a, b in zip(c, v, strict=True)]
    one["vwma"] = each(lambda a, b: a / b, window(pv, 20, sum), window(v, 20, sum))
    one["hma"] = wma(each(lambda a, b: 2 * a - b, wma(c, 4), wma(c, 9)), 3)
    out = {f"vote_{k}": [None if m is None else 1 if less(m, x) else -1 if less(x, m) else 0 for m, x in zip(s, c, strict=True)] for k, s in one.items()}
    mid = lambda k: each(lambda a, b: (a + b) / 2, window(h, k, max), window(lo, k, min))
    conv, base = mid(9), mid(26)
    cloud1, cloud2 = back(each(lambda a, b: (a + b) / 2, conv, base), 25), back(mid(52), 25)
    at = lambda x, i: x[i] if i >= 0 else None

    def over(x, y, i):
        a, b, a1, b1 = at(x, i), at(y, i), at(x, i - 1), at(y, i - 1)
        return None not in (a, b, a1, b1) and a > b and a1 <= b1

    def under(x, y, i):
        return over([None if z is None else -z for z in x], [None if z is None else -z for z in y], i)

    d = [None] + [c[i] - c[i - 1] for i in range(1, n)]
    gain, loss = rma(each(lambda z: max(z, 0.0), d), 14), rma(each(lambda z: max(-z, 0.0), d), 14)
    rsi = each(lambda a, b: 100 - 100 / (1 + a / b) if b else 100.0, gain, loss)
    k_, sr_k = sma(stoch(c, h, lo, 14), 3), sma(stoch(rsi, rsi, rsi, 14), 3)
    d_, sr_d = sma(k_, 3), sma(sr_k, 3)
    cc = cci([(a + b + e) / 3 for a, b, e in zip(h, lo, c, strict=True)], 20)
    up = [None] + [max(h[i] - h[i - 1], 0.0) if h[i] - h[i - 1] > lo[i - 1] - lo[i] else 0.0 for i in range(1, n)]
    down = [None] + [max(lo[i - 1] - lo[i], 0.0) if lo[i - 1] - lo[i] > h[i] - h[i - 1] else 0.0 for i in range(1, n)]
    t = rma(true_range(h, lo, c), 14)
    plus, minus = each(lambda a, b: 100 * a / b, rma(up, 14), t), each(lambda a, b: 100 * a / b, rma(down, 14), t)
    adx = rma(each(lambda a, b: 100 * abs(a - b) / (a + b) if a + b else 0.0, plus, minus), 14)
    hl2 = [(a + b) / 2 for a, b in zip(h, lo, strict=True)]
    ao = each(lambda a, b: a - b, sma(hl2, 5), sma(hl2, 34))
    mom = each(lambda a, b: a - b, c, back(c, 10))
    macd = each(lambda a, b: a - b, ema(c, 12), ema(c, 26))
    signal = ema(macd, 9)
    wpr = each(lambda a: a - 100, stoch(c, h, lo, 14))
    e13, trend = ema(c, 13), one["sma_50"]
    bull, bear = [a - b for a, b in zip(h, e13, strict=True)], [a - b for a, b in zip(lo, e13, strict=True)]
    uo, zero = ultimate(h, lo, c), [0.0] * n
    rules = {
        "ichimoku": (lambda i: cloud2[i] is not None and base[i] is not None, lambda i: less(base[i], c[i]) and over(conv, c, i) and less(c[i], cloud1[i]) and less(cloud2[i], cloud1[i]), lambda i: less(c[i], base[i]) and under(conv, c, i) and less(cloud1[i], c[i]) and less(cloud1[i], cloud2[i])),
        "stoch": (lambda i: at(d_, i - 1) is not None, lambda i: less(k_[i], 20) and over(k_, d_, i), lambda i: less(80, k_[i]) and under(k_, d_, i)),
        "adx": (lambda i: adx[i] is not None, lambda i: less(20, adx[i]) and less(plus[i - 1], minus[i - 1]) and less(minus[i], plus[i]), lambda i: less(20, adx[i]) and less(minus[i - 1], plus[i - 1]) and less(plus[i], minus[i])),
        "ao": (lambda i: at(ao, i - 2) is not None, lambda i: (less(0, ao[i]) and less(ao[i - 1], ao[i]) and less(ao[i - 1], ao[i - 2])) or over(ao, zero, i), lambda i: (less(ao[i], 0) and less(ao[i], ao[i - 1]) and less(ao[i - 2], ao[i - 1])) or under(ao, zero, i)),
        "mom": (lambda i: at(mom, i - 1) is not None, lambda i: less(mom[i - 1], mom[i]), lambda i: less(mom[i], mom[i - 1])),
        "macd": (lambda i: True, lambda i: less(signal[i], macd[i]), lambda i: less(macd[i], signal[i])),
        "stoch_rsi": (lambda i: at(sr_d, i - 1) is not None and trend[i] is not None, lambda i: less(c[i], trend[i]) and less(sr_k[i], 20) and less(sr_d[i], 20) and over(sr_k, sr_d, i), lambda i: less(trend[i], c[i]) and less(80, sr_k[i]) and less(80, sr_d[i]) and under(sr_k, sr_d, i)),
        "bbp": (lambda i: i and trend[i] is not None, lambda i: less(trend[i], c[i]) and less(bear[i], 0) and less(bear[i - 1], bear[i]), lambda i: less(c[i], trend[i]) and less(0, bull[i]) and less(bull[i], bull[i - 1])),
        "uo": (lambda i: uo[i] is not None, lambda i: less(70, uo[i]), lambda i: less(uo[i], 30)),
    } | {
        k: (lambda i, x=x: at(x, i - 1) is not None, lambda i, x=x, a=a: less(x[i], a) and less(x[i - 1], x[i]), lambda i, x=x, b=b: less(b, x[i]) and less(x[i], x[i - 1]))
        for k, x, a, b in (("rsi", rsi, 30, 70), ("cci", cc, -100, 100), ("wpr", wpr, -80, -20))
    }
    for k, (ready, buy, sell) in rules.items():
        out[f"vote_{k}"] = [(1 if buy(i) else -1 if sell(i) else 0) if ready(i) else None for i in range(n)]
    near = lambda x, y, i: None not in (at(x, i), at(y, i)) and abs(x[i] - y[i]) < 1e-9 and not x[i] == y[i] in (0, 100)
    unsure = {(i, v) for v, x, y in (("vote_stoch", k_, d_), ("vote_stoch_rsi", sr_k, sr_d)) for i in range(n) if near(x, y, i) or near(x, y, i - 1)}
    return out, unsure


def test_all_votes_equal_the_script(spark):
    rows = random_bars("x", 330, 5) + random_bars("y", 260, 6) + random_bars("z", 7, 7)
    got = rating.with_votes(spark.createDataFrame(rows, BARS).repartition(3)).collect()
    assert len(got) == len(rows) and len(rating.MA_VOTES) == 15 and len(rating.OSC_VOTES) == 11
    met = {v: set() for v in (*rating.MA_VOTES, *rating.OSC_VOTES)}
    for s in "xyz":
        mine = sorted((r for r in got if r.symbol == s), key=lambda r: r.t)
        want, unsure = votes_of([r for r in rows if r[0] == s])
        assert set(want) == set(met) and len(unsure) < 0.1 * len(mine)
        for i, r in enumerate(mine):
            for v in met:
                assert r[v] == want[v][i] or (i, v) in unsure, (s, i, v)
                met[v].add(r[v])
            ma, osc = ([r[v] for v in names if r[v] is not None] for names in (rating.MA_VOTES, rating.OSC_VOTES))
            assert math.isclose(r.ma, sum(ma) / len(ma)) and math.isclose(r.osc, sum(osc) / len(osc))
            assert math.isclose(r["all"], (r.ma + r.osc) / 2, abs_tol=1e-12)
    assert not [v for v in met if None in met[v] and len(met[v]) < 2]
    assert sum({1, -1} <= s for s in met.values()) >= 22, met
