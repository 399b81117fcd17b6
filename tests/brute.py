"""Plain Python over one symbol's bars, for tests: lists in time order, None is missing."""

import random


def random_bars(symbol, n, seed):
    r, out, c = random.Random(seed), [], 100.0
    for i in range(n):
        o, c = c, max(5.0, c + r.choice([-1, 1]) * r.choice([0.25, 0.5, 1.5, 2, 3]) + 2 * (((i // 40) % 2) - 0.5))
        out.append((symbol, 3600 * i, o, max(o, c) + r.choice([0, 0.5, 1]), min(o, c) - r.choice([0, 0.5, 1]), c, float(r.randrange(1, 50)), i))
    return out


BARS = "symbol string, t long, open double, high double, low double, close double, volume double, i long"


def window(x, n, f):
    return [f(x[i - n + 1 : i + 1]) if i >= n - 1 and None not in x[i - n + 1 : i + 1] else None for i in range(len(x))]


def each(f, *xs):
    return [None if None in v else f(*v) for v in zip(*xs, strict=True)]


def sma(x, n):
    return window(x, n, lambda w: sum(w) / n)


def wma(x, n):
    return window(x, n, lambda w: sum(v * (k + 1) for k, v in enumerate(w)) / (n * (n + 1) / 2))


def back(x, k):
    return ([None] * k + x)[: len(x)]


def rma(x, n):
    out = []
    for i, v in enumerate(x):
        before = out[-1] if out else None
        if v is None or i < n - 1:
            out.append(None)
        elif before is None:
            w = x[i - n + 1 : i + 1]
            out.append(None if None in w else sum(w) / n)
        else:
            out.append((before * (n - 1) + v) / n)
    return out


def ema(x, n):
    out, p = [], None
    for v in x:
        p = None if v is None else v if p is None else p + 2 / (n + 1) * (v - p)
        out.append(p)
    return out


def ewm(x, alpha, least):
    """pandas' ewm(adjust=False): missing values hold it."""
    out, p, seen = [], None, 0
    for v in x:
        if v is not None:
            seen, p = seen + 1, v if p is None else p + alpha * (v - p)
        out.append(p if seen >= least else None)
    return out


def stoch(x, h, lo, n):
    top, low = window(h, n, max), window(lo, n, min)
    return [None if None in (v, a, b) or a == b else 100 * (v - b) / (a - b) for v, a, b in zip(x, top, low, strict=True)]


def cci(x, n):
    def one(w):
        m = sum(w) / n
        d = sum(abs(v - m) for v in w) / n
        return (w[-1] - m) / (0.015 * d) if d else None

    return window(x, n, one)


def true_range(h, lo, c):
    return [h[0] - lo[0]] + [max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, len(c))]


def ultimate(h, lo, c):
    bp = [c[0] - lo[0]] + [c[i] - min(lo[i], c[i - 1]) for i in range(1, len(c))]
    tr = true_range(h, lo, c)
    s = lambda x, n: window(x, n, sum)
    parts = [each(lambda a, b: a / b if b else 0.0, s(bp, n), s(tr, n)) for n in (7, 14, 28)]
    return each(lambda a, b, d: 100 * (4 * a + 2 * b + d) / 7, *parts)
