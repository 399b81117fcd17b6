"""Recurrences: operators whose next value needs their last one.

``fold`` sorts each symbol's bars once and passes over them in Arrow batches,
keeping only each kernel's few numbers between rows and batches, so a symbol
may have any number of bars. Several kernels share one pass.

A kernel is a class with ``outputs`` and ``step(row)``, which takes the values
of its input columns (None is NULL) and returns as many values as outputs.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .. import ship


class Ema:
    """Starts with the first value; NULL gives NULL and starts anew."""

    outputs = 1

    def __init__(self, n: int):
        self.a, self.p = 2 / (n + 1), None

    def step(self, x):
        self.p = None if x is None else x if self.p is None else self.a * x + (1 - self.a) * self.p
        return (self.p,)


class Rma:
    """Wilder's average: the mean of the first n bars at bar n - 1, then 1/n of each new value. After NULL the mean of n full bars starts anew."""

    outputs = 1

    def __init__(self, n: int):
        self.n, self.p, self.bar, self.last = n, None, -1, deque(maxlen=n)

    def step(self, x):
        self.bar += 1
        self.last.append(x)
        if x is None or self.bar < self.n - 1:
            self.p = None
        elif self.p is None:
            self.p = sum(self.last) / self.n if len(self.last) == self.n and None not in self.last else None
        else:
            self.p = x / self.n + (1 - 1 / self.n) * self.p
        return (self.p,)


class Rsi:
    outputs = 1

    def __init__(self, n: int):
        self.up, self.down, self.x1 = Rma(n), Rma(n), None

    def step(self, x):
        d = None if x is None or self.x1 is None else x - self.x1
        self.x1 = x
        (g,), (l,) = self.up.step(None if d is None else max(d, 0.0)), self.down.step(None if d is None else max(-d, 0.0))
        if g is None or l is None or g == l == 0:
            return (None,)
        return (100.0 if l == 0 else 100 - 100 / (1 + g / l),)


class _Range:
    """True range of (high, low, close) and what it needs of the bar before."""

    def __init__(self):
        self.c1 = None

    def step(self, h, lo, c):
        if h is None or lo is None:
            out = None
        else:
            out = h - lo if self.c1 is None else max(h - lo, abs(h - self.c1), abs(lo - self.c1))
        self.c1 = c
        return out


class Atr:
    outputs = 1

    def __init__(self, n: int):
        self.tr, self.rma = _Range(), Rma(n)

    def step(self, h, lo, c):
        return self.rma.step(self.tr.step(h, lo, c))


class Macd:
    """Line, signal and their difference."""

    outputs = 3

    def __init__(self, fast: int, slow: int, signal: int):
        self.fast, self.slow, self.signal = Ema(fast), Ema(slow), Ema(signal)

    def step(self, x):
        (f,), (s,) = self.fast.step(x), self.slow.step(x)
        m = None if f is None or s is None else f - s
        (g,) = self.signal.step(m)
        return m, g, None if m is None or g is None else m - g


class Tsi:
    outputs = 1

    def __init__(self, short: int = 13, long: int = 25):
        self.x1 = None
        self.chains = [(Ema(long), Ema(short)) for _ in range(2)]

    def step(self, x):
        d = None if x is None or self.x1 is None else x - self.x1
        self.x1 = x
        n, m = (second.step(first.step(v)[0])[0] for (first, second), v in zip(self.chains, (d, None if d is None else abs(d)), strict=True))
        return (None if n is None or not m else 100 * n / m,)


class Dmi:
    """+DI, -DI and ADX."""

    outputs = 3

    def __init__(self, n: int, smoothing: int | None = None):
        self.tr, self.h1, self.l1 = _Range(), None, None
        self.rmas = [Rma(n) for _ in range(3)]
        self.adx = Rma(smoothing or n)

    def step(self, h, lo, c):
        plus = minus = None
        if None not in (h, lo, self.h1, self.l1):
            up, down = h - self.h1, self.l1 - lo
            plus, minus = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
        t, p, m = (r.step(x)[0] for r, x in zip(self.rmas, (self.tr.step(h, lo, c), plus, minus), strict=True))
        self.h1, self.l1 = h, lo
        if None in (t, p, m):
            return None, None, self.adx.step(None)[0]
        p, m = (100 * p / t, 100 * m / t) if t else (0.0, 0.0)
        return p, m, self.adx.step(100 * abs(p - m) / (p + m) if p + m else 0.0)[0]


class Keltner:
    """Basis, upper and lower band on exponential averages, and the bands' width over the basis."""

    outputs = 4

    def __init__(self, n: int = 20, mult: float = 2, true_range: bool = True):
        self.tr, self.true, self.mult, self.basis, self.spread = _Range(), true_range, mult, Ema(n), Ema(n)

    def step(self, x, h, lo, c):
        span = self.tr.step(h, lo, c)
        if not self.true:
            span = None if h is None or lo is None else h - lo
        (b,), (s,) = self.basis.step(x), self.spread.step(span)
        if b is None or s is None:
            return None, None, None, None
        return b, b + self.mult * s, b - self.mult * s, 2 * self.mult * s / b if b else 0.0


class Fisher:
    """The transform of the price's place in its window, and its last value."""

    outputs = 2

    def __init__(self, n: int = 9):
        self.n, self.v, self.f, self.last = n, 0.0, 0.0, deque(maxlen=n)

    def step(self, x):
        self.last.append(x)
        if len(self.last) < self.n or None in self.last:
            return None, None
        high, low = max(self.last), min(self.last)
        v = 0.66 * ((x - low) / (high - low) - 0.5) + 0.67 * self.v if high > low else 0.0
        self.v = math.copysign(0.999, v) if abs(v) > 0.99 else v
        before, self.f = self.f, 0.5 * math.log((1 + self.v) / (1 - self.v)) + 0.5 * self.f
        return self.f, before


class Supertrend:
    """The line, and its direction: 1 while it is above the price, -1 below."""

    outputs = 2

    def __init__(self, factor: float, n: int):
        self.factor, self.atr = factor, Atr(n)
        self.up = self.down = self.direction = self.c1 = self.a1 = None

    def step(self, h, lo, c):
        (a,) = self.atr.step(h, lo, c)
        out = None, None
        if None not in (a, h, lo, c):
            up, down = (h + lo) / 2 - self.factor * a, (h + lo) / 2 + self.factor * a
            if self.c1 is not None:
                if self.up is not None and self.c1 >= self.up:
                    up = max(up, self.up)
                if self.down is not None and self.c1 <= self.down:
                    down = min(down, self.down)
            if self.a1 is None or self.direction is None:
                d = 1
            elif self.direction == 1:
                d = -1 if c > down else 1
            else:
                d = 1 if c < up else -1
            self.up, self.down, self.direction = up, down, d
            out = (up if d == -1 else down), float(d)
        self.c1, self.a1 = c, a
        return out


class Sar:
    """Parabolic stop and reverse, beginning upwards at the first low."""

    outputs = 1

    def __init__(self, start: float = 0.02, increment: float = 0.02, most: float = 0.2):
        self.start, self.increment, self.most = start, increment, most
        self.sar = None
        self.before: deque = deque(maxlen=2)

    def step(self, h, lo):
        if h is None or lo is None:
            self.before.append((h, lo))
            return (None,)
        if self.sar is None:
            self.rises, self.extreme, self.sar, self.af = True, h, lo, self.start
        else:
            sar = self.sar + self.af * (self.extreme - self.sar)
            for h1, l1 in self.before:
                if (l1 if self.rises else h1) is not None:
                    sar = min(sar, l1) if self.rises else max(sar, h1)
            if (lo < sar) if self.rises else (h > sar):
                sar, self.extreme = self.extreme, lo if self.rises else h
                self.rises, self.af = not self.rises, self.start
            elif (h > self.extreme) if self.rises else (lo < self.extreme):
                self.extreme, self.af = h if self.rises else lo, min(self.af + self.increment, self.most)
            self.sar = sar
        self.before.append((h, lo))
        return (self.sar,)


class VolumeIndex:
    """Compounds the price's change on bars whose volume falls (negative) or rises (positive)."""

    outputs = 1

    def __init__(self, negative: bool):
        self.negative, self.value, self.c1, self.v1 = negative, None, None, None

    def step(self, c, v):
        if None not in (c, v, self.c1, self.v1) and self.c1 != 0:
            base = 1000.0 if self.value is None else self.value
            active = v < self.v1 if self.negative else v > self.v1
            self.value = base * (1 + (c - self.c1) / self.c1) if active else base
        self.c1, self.v1 = c, v
        return (self.value,)


class Ewm:
    """Exponential mean that NULL doesn't move, shown from ``least`` values on."""

    outputs = 1

    def __init__(self, alpha: float, least: int):
        self.alpha, self.least, self.p, self.seen = alpha, least, None, 0

    def step(self, x):
        if x is not None:
            self.p = x if self.p is None else self.alpha * x + (1 - self.alpha) * self.p
            self.seen += 1
        return (self.p if self.seen >= self.least else None,)


class SeededEma:
    """The chart's exponential average: begins at bar n - 1 with the mean of the first n."""

    outputs = 1

    def __init__(self, n: int):
        self.n, self.head, self.p = n, [], None

    def step(self, x):
        if self.p is None:
            self.head.append(x)
            if len(self.head) == self.n:
                self.p = sum(self.head) / self.n
        else:
            k = 2 / (self.n + 1)
            self.p = x * k + self.p * (1 - k)
        return (self.p,)


class ZigZag:
    """Price and direction of the last confirmed pivot: a retracement of ``deviation`` percent from an extreme that is at least ``depth`` bars old.

    The retracement is that of the lowest low since the high (the highest high
    since the low), and the new leg starts there. ``low_since`` and ``high_since``
    begin with the extreme's own bar; an equal extreme doesn't move it.
    """

    outputs = 2

    def __init__(self, deviation: float = 5.0, depth: int = 10):
        self.deviation, self.depth, self.bar, self.direction = deviation, depth, -1, 0
        self.high = self.low = self.low_since = self.high_since = self.pivot = None  # (price, bar)

    def _falls(self, high: float, low: float) -> bool:
        return high > 0 and (high - low) / high * 100 >= self.deviation

    def _rises(self, low: float, high: float) -> bool:
        return low > 0 and (high - low) / low * 100 >= self.deviation

    def step(self, h, lo):
        self.bar += 1
        if h is not None and lo is not None:
            h, lo = (h, self.bar), (lo, self.bar)
            if self.direction == 0:
                self._begin(h, lo)
            elif self.direction == 1:
                self._up(h, lo)
            else:
                self._down(h, lo)
        return self.pivot or (None, None)

    def _begin(self, h, lo):
        if self.high is None:
            self.high, self.low, self.low_since, self.high_since = h, lo, lo, h
        else:
            if h[0] > self.high[0]:
                self.high, self.low_since = h, lo
            elif lo[0] < self.low_since[0]:
                self.low_since = lo
            if lo[0] < self.low[0]:
                self.low, self.high_since = lo, h
            elif h[0] > self.high_since[0]:
                self.high_since = h
        if self.high[1] != self.low[1] and self._rises(self.low[0], self.high[0]):
            self.direction = 1 if self.low[1] < self.high[1] else -1
            self.pivot = (self.low[0], -1.0) if self.direction == 1 else (self.high[0], 1.0)

    def _up(self, h, lo):
        if h[0] > self.high[0]:
            self.high, self.low_since = h, lo
            return
        if lo[0] < self.low_since[0]:
            self.low_since = lo
        if self._falls(self.high[0], self.low_since[0]) and self.bar - self.high[1] >= self.depth:
            self.pivot, self.direction, self.low, self.high_since = (self.high[0], 1.0), -1, self.low_since, h

    def _down(self, h, lo):
        if lo[0] < self.low[0]:
            self.low, self.high_since = lo, h
            return
        if h[0] > self.high_since[0]:
            self.high_since = h
        if self._rises(self.low[0], self.high_since[0]) and self.bar - self.low[1] >= self.depth:
            self.pivot, self.direction, self.high, self.low_since = (self.low[0], -1.0), 1, self.high_since, lo


class _Extreme:
    """The greatest value of the last ``span`` seconds and since the anchor, in constant time for each value (amortised): a queue of falling values."""

    def __init__(self, span: float):
        self.span, self.queue = span, deque()

    def add(self, t: float, v: float) -> float:
        while self.queue and self.queue[-1][1] <= v:
            self.queue.pop()
        self.queue.append((t, v))
        self.drop_before(t - self.span)
        return self.queue[0][1]

    def drop_before(self, t: float) -> None:
        while self.queue[0][0] < t:
            self.queue.popleft()


class Reversal:
    """Alerts when net flow falls back from its 30-minute peak (1) or rises from its trough (-1) while a large print goes against it.

    An alert sets the extreme of its own side anew, at its time; the other side's
    goes on. After an alert of either side there is none for a while.
    """

    outputs = 1

    def __init__(self, least: float, share: float = 0.3, span: int = 1800, quiet: int = 300):
        self.least, self.share, self.quiet = least, share, quiet
        self.peaks, self.troughs, self.last = _Extreme(span), _Extreme(span), None

    def step(self, t, net, bought, sold):
        peak, trough = self.peaks.add(t, net), -self.troughs.add(t, -net)
        if self.last is not None and t - self.last < self.quiet:
            return (0.0,)
        fall, rise = peak - net, net - trough
        if sold and peak >= 2 * self.least and fall >= self.least and fall / peak >= self.share:
            self.last = t
            self.peaks.drop_before(t)
            return (1.0,)
        if bought and trough <= -2 * self.least and rise >= self.least and rise / abs(trough) >= self.share:
            self.last = t
            self.troughs.drop_before(t)
            return (-1.0,)
        return (0.0,)


def fold(bars: DataFrame, kernels: list[tuple], key: str = "symbol", order: tuple[str, ...] = ("t",), keep: list[str] | None = None) -> DataFrame:
    """Adds the outputs of kernels, given as (names of outputs, make a kernel, names of inputs).

    Rows come back with ``keep`` (all columns by default). One shuffle by key and
    one sort serve all kernels; state lives from batch to batch.
    """
    keep = keep or bars.columns
    inputs = sorted({c for _, _, columns in kernels for c in columns})
    dealt = bars.repartition(key).sortWithinPartitions(key, *order).select(*keep, *[bars[c].cast("double").alias(f"_in_{c}") for c in inputs])
    names = [n for outputs, _, _ in kernels for n in outputs]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*keep).schema] + [f"`{n}` double" for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, made = object(), []
        for pdf in batches:
            columns = {c: pdf[f"_in_{c}"].astype(object).where(pdf[f"_in_{c}"].notna(), None).tolist() for c in inputs}
            out: list[list] = [[] for _ in names]
            for i, own in enumerate(pdf[key].tolist()):
                if own != symbol:
                    symbol, made = own, [(make(), cs) for _, make, cs in kernels]
                at = 0
                for kernel, cs in made:
                    for value in kernel.step(*[columns[c][i] for c in cs]):
                        out[at].append(value)
                        at += 1
            yield pd.concat([pdf[keep], pd.DataFrame(dict(zip(names, out, strict=True)), index=pdf.index, dtype="float64")], axis=1)

    ship(bars.sparkSession)
    return dealt.mapInPandas(run, schema)
