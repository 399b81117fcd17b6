"""Rolling, cumulative and segmented operators as window expressions.

Every function returns a column over ``by()``: bars of a symbol in time order.
Windows are strict unless a function says otherwise: a window that is short or
holds NULL gives NULL. All operators of a query share one sort of its bars.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.na import div, finite

def by():
    """Bars of a symbol in time order."""
    return Window.partitionBy("symbol").orderBy("t")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def back(n: int, upto: int = 0):
    return by().rowsBetween(-(n - 1), -upto)


def so_far():
    return by().rowsBetween(Window.unboundedPreceding, 0)


def full(x, n: int, value: Column) -> Column:
    """The value where the last n bars all have x."""
    return F.when(F.count(_c(x)).over(back(n)) == n, value)


def ago(x, n: int = 1) -> Column:
    return F.lag(_c(x), n).over(by())


def _weighted(x, weights: list[float]) -> Column:
    """Sum of x[k] * weights[k], k bars back; NULL if any is."""
    return reduce(add, [(ago(x, k) if k else _c(x)) * w for k, w in enumerate(weights)])


# -- averages ------------------------------------------------------------------------

def sma(x, n: int) -> Column:
    return full(x, n, F.avg(_c(x)).over(back(n)))


def wma(x, n: int) -> Column:
    return _weighted(x, [(n - k) / (n * (n + 1) / 2) for k in range(n)])


def swma(x) -> Column:
    return _weighted(x, [1 / 6, 2 / 6, 2 / 6, 1 / 6])


def vwma(x, n: int, volume="volume") -> Column:
    pv = _c(x) * _c(volume)
    return full(pv, n, div(F.sum(pv).over(back(n)), F.sum(F.when(pv.isNotNull(), _c(volume))).over(back(n))))


def alma(x, n: int, offset: float = 0.85, sigma: float = 6, floored: bool = False) -> Column:
    m = offset * (n - 1)
    m = math.floor(m) if floored else m
    w = [math.exp(-((n - 1 - k - m) ** 2) / (2 * (n / sigma) ** 2)) for k in range(n)]
    return _weighted(x, [v / sum(w) for v in w])


def linreg(x, n: int, offset: int = 0) -> Column:
    """The least-squares line of the last n values, at the newest shifted back by ``offset``."""
    mean = (n - 1) / 2
    spread = sum((k - mean) ** 2 for k in range(n))
    return _weighted(x, [1 / n + (k - mean) * (offset - mean) / spread for k in range(n)])


def with_hma(bars: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """Adds the Hull average: of twice the half-length average less the full one, over the root of the length."""
    raw = f"_{name}"
    bars = bars.withColumn(raw, 2 * wma(x, max(1, n // 2)) - wma(x, n))
    return bars.withColumn(name, wma(raw, max(1, math.floor(math.sqrt(n) + 0.5)))).drop(raw)


# -- spread --------------------------------------------------------------------------

def variance(x, n: int, biased: bool = True) -> Column:
    f = F.var_pop if biased else F.var_samp
    return full(x, n, f(_c(x)).over(back(n))) if biased or n > 1 else F.lit(None).cast("double")


def stdev(x, n: int, biased: bool = True) -> Column:
    return F.sqrt(variance(x, n, biased))


def bb(x, n: int, mult: float) -> tuple[Column, Column, Column]:
    """Basis, upper and lower band."""
    basis, width = sma(x, n), mult * stdev(x, n)
    return basis, basis + width, basis - width


def bbw(x, n: int, mult: float) -> Column:
    basis, upper, lower = bb(x, n, mult)
    return div(upper - lower, basis)


def highest(x, n: int) -> Column:
    return full(x, n, F.max(_c(x)).over(back(n)))


def lowest(x, n: int) -> Column:
    return full(x, n, F.min(_c(x)).over(back(n)))


def highestbars(x, n: int, i: str = "i") -> Column:
    """How far back (0 or less) the newest of the greatest values is."""
    return full(x, n, F.max(F.struct(_c(x).alias("x"), _c(i).alias("i"))).over(back(n))["i"] - _c(i))


def lowestbars(x, n: int, i: str = "i") -> Column:
    return full(x, n, F.max(F.struct((-_c(x)).alias("x"), _c(i).alias("i"))).over(back(n))["i"] - _c(i))


def _window(x, n: int) -> Column:
    return F.collect_list(_c(x)).over(back(n))


def dev(x, n: int) -> Column:
    """Mean distance from the window's mean."""
    mean = F.avg(_c(x)).over(back(n))
    return full(x, n, F.aggregate(F.zip_with(_window(x, n), F.array_repeat(mean, n), lambda v, m: F.abs(v - m)), F.lit(0.0), lambda s, v: s + v) / n)


def median(x, n: int) -> Column:
    s = F.array_sort(_window(x, n))
    return full(x, n, s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2)


def mode(x, n: int) -> Column:
    """The most frequent; of several, the one met first from the newest on."""
    w = F.reverse(_window(x, n))
    counted = F.transform(F.array_distinct(w), lambda v, k: F.struct(F.size(F.filter(w, lambda y: y == v)).alias("n"), (-k).alias("k"), v.alias("v")))
    return full(x, n, F.array_max(counted)["v"])


def percentile_linear_interpolation(x, n: int, percentage: float) -> Column:
    s, place = F.array_sort(_window(x, n)), percentage / 100 * (n - 1)
    low, high = math.floor(place), math.ceil(place)
    return full(x, n, s[low] + (s[high] - s[low]) * (place - low))


def percentile_nearest_rank(x, n: int, percentage: float) -> Column:
    return full(x, n, F.array_sort(_window(x, n))[max(1, math.ceil(percentage / 100 * n)) - 1])


def percentrank(x, n: int, i: str = "i") -> Column:
    """Share of the n values before that are no greater; NULL counts as none, a NULL now gives 0."""
    before = F.collect_list(_c(x)).over(by().rowsBetween(-n, -1))
    share = F.size(F.filter(F.zip_with(before, F.array_repeat(_c(x), F.size(before)), lambda v, c: v <= c), lambda ok: ok)) * 100.0 / n
    return F.when(_c(i) >= n, F.when(_c(x).isNull(), F.lit(0.0)).otherwise(share))


def range_(x, n: int) -> Column:
    """Greatest less least of the last n values that are not NULL."""
    own = F.collect_list(_c(x)).over(so_far())
    tail = F.slice(own, -n, n)
    return F.when(_c(x).isNotNull() & (F.size(own) >= n), F.array_max(tail) - F.array_min(tail))


def rci(x, n: int, i: str = "i") -> Column:
    """Rank correlation of time and value, ties sharing their mean rank, times 100."""
    w = _window(x, n)
    rank = F.transform(w, lambda v: F.size(F.filter(w, lambda y: y < v)) + (F.size(F.filter(w, lambda y: y == v)) + 1) / 2.0)
    mean = (n + 1) / 2
    cov = F.aggregate(F.transform(rank, lambda r, k: (k + 1 - mean) * (r - mean)), F.lit(0.0), lambda s, v: s + v)
    var = F.aggregate(F.transform(rank, lambda r: (r - mean) * (r - mean)), F.lit(0.0), lambda s, v: s + v)
    time = sum((k - mean) ** 2 for k in range(1, n + 1))
    return F.when(_c(i) >= n, full(x, n, 100 * div(cov, F.sqrt(var * time))))


def correlation(x, y, n: int) -> Column:
    both = F.when(_c(x).isNotNull() & _c(y).isNotNull(), F.struct(_c(x).alias("x"), _c(y).alias("y")))
    w = F.collect_list(both).over(back(n))
    mx, my = F.avg(_c(x)).over(back(n)), F.avg(_c(y)).over(back(n))
    centred = F.zip_with(w, F.array_repeat(F.struct(mx.alias("x"), my.alias("y")), n), lambda p, m: F.struct((p["x"] - m["x"]).alias("x"), (p["y"] - m["y"]).alias("y")))
    total = lambda f: F.aggregate(F.transform(centred, f), F.lit(0.0), lambda s, v: s + v)
    return full(both, n, div(total(lambda p: p["x"] * p["y"]), F.sqrt(total(lambda p: p["x"] * p["x"]) * total(lambda p: p["y"] * p["y"]))))


# -- moves ---------------------------------------------------------------------------

def change(x, n: int = 1) -> Column:
    return _c(x) - ago(x, n)


mom = momentum = change


def roc(x, n: int) -> Column:
    return 100 * div(change(x, n), ago(x, n))


def _and(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(x, F.lit(False)) for x in xs])


def crossover(x, y) -> Column:
    return _and(_c(x) > _c(y), ago(x) <= ago(y))


def crossunder(x, y) -> Column:
    return _and(_c(x) < _c(y), ago(x) >= ago(y))


def cross(x, y) -> Column:
    return crossover(x, y) | crossunder(x, y)


def tr(first: bool = True) -> Column:
    """True range; of a symbol's first bar its own range, or NULL."""
    h, lo, c1 = _c("high"), _c("low"), ago("close")
    span = F.greatest(h - lo, F.abs(h - c1), F.abs(lo - c1))
    return F.when(c1.isNotNull(), span).otherwise(h - lo if first else F.lit(None))


def with_moves(bars: DataFrame) -> DataFrame:
    """Adds the columns that cmo, mfi, vortex and the cumulative indexes sum: differences, flows and ranges of single bars."""
    h, lo, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    c1, d = ago("close"), change("close")
    hlc3 = (h + lo + c) / 3
    p1 = (ago("high") + ago("low") + ago("close")) / 3
    known = d.isNotNull() & v.isNotNull()
    return bars.withColumns({
        "up": F.when(d > 0, d).when(d.isNotNull(), 0.0),
        "down": F.when(d <= 0, -d).when(d.isNotNull(), 0.0),
        "inflow": F.when(p1.isNotNull() & v.isNotNull(), F.when(hlc3 > p1, hlc3 * v).otherwise(0.0)),
        "outflow": F.when(p1.isNotNull() & v.isNotNull(), F.when(hlc3 < p1, hlc3 * v).otherwise(0.0)),
        "vi_up": F.abs(h - ago("low")),
        "vi_down": F.abs(lo - ago("high")),
        "true_range": tr(),
        "obv_step": F.when(known, F.signum(d) * v),
        "pvt_step": F.when(known & (c1 != 0), d / c1 * v),
        "wad_step": F.when(c1.isNull(), F.when(c.isNotNull(), 0.0)).when(d > 0, c - F.least(lo, c1)).when(d < 0, c - F.greatest(h, c1)).otherwise(0.0),
        "accdist_step": F.when(h == lo, 0.0).otherwise(div((c - lo) - (h - c), h - lo) * v),
        "moved": F.signum(d),
    })


def cmo(n: int) -> Column:
    """Of :func:`with_moves`: the balance of rises and falls."""
    up, down = F.sum("up").over(back(n)), F.sum("down").over(back(n))
    return full("up", n, F.when(up + down == 0, 0.0).otherwise(100 * div(up - down, up + down)))


def mfi(n: int) -> Column:
    """Of :func:`with_moves`: money flow on the typical price."""
    pos, neg = F.sum("inflow").over(back(n)), F.sum("outflow").over(back(n))
    return full("inflow", n, F.when(neg == 0, F.when(pos != 0, 100.0)).otherwise(100 - 100 / (1 + div(pos, neg))))


def vortex(n: int) -> tuple[Column, Column]:
    """Of :func:`with_moves`: upward and downward movement per true range."""
    span = F.sum("true_range").over(back(n))
    return tuple(full("vi_up", n, div(F.sum(x).over(back(n)), span)) for x in ("vi_up", "vi_down"))


def cci(x, n: int) -> Column:
    mad = dev(x, n)
    return div(_c(x) - sma(x, n), 0.015 * mad)


def cog(x, n: int) -> Column:
    return -div(_weighted(x, [k + 1 for k in range(n)]), _weighted(x, [1.0] * n))


def wpr(n: int) -> Column:
    hh, ll = highest("high", n), lowest("low", n)
    return -100 * div(hh - _c("close"), hh - ll)


def stoch(x, high, low, n: int) -> Column:
    hh, ll = highest(high, n), lowest(low, n)
    return 100 * div(_c(x) - ll, hh - ll)


def kc_wma(x, n: int, mult: float, spread: str = "true_range") -> tuple[Column, Column, Column]:
    """Keltner bands on linearly weighted averages: basis, upper, lower."""
    basis, width = wma(x, n), mult * wma(spread, n)
    return basis, basis + width, basis - width


def nadaraya_watson(x, h: float = 8, r: float = 8, n: int = 25, mult: float = 1) -> tuple[Column, Column]:
    """A rational-quadratic kernel mean of the last n bars, with a band of the mean distance from it."""
    w = [(1 + k * k / (2 * r * h * h)) ** -r for k in range(n)]
    mean = _weighted(x, [v / sum(w) for v in w])
    mae = reduce(add, [F.abs((ago(x, k) if k else _c(x)) - mean) for k in range(n)]) / n
    return mean + mult * mae, mean - mult * mae


# -- running -------------------------------------------------------------------------

def sum_loose(x, n: int) -> Column:
    """NULL counts as 0, and short windows are allowed."""
    return F.sum(F.coalesce(_c(x), F.lit(0.0))).over(back(n))


def sum_strict(x, n: int) -> Column:
    return full(x, n, F.sum(_c(x)).over(back(n)))


def with_cum(bars: DataFrame, x: str, name: str) -> DataFrame:
    """Adds a running sum that NULL interrupts and starts anew."""
    bars = bars.withColumn("_gaps", F.sum(F.col(x).isNull().cast("int")).over(so_far()))
    own = Window.partitionBy("symbol", "_gaps").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn(name, F.when(F.col(x).isNotNull(), F.sum(x).over(own))).drop("_gaps")


def running(step: str) -> Column:
    """The sum of a step column so far; a NULL step holds it."""
    return F.sum(step).over(so_far())


def running_max(x) -> Column:
    return F.max(_c(x)).over(so_far())


def running_min(x) -> Column:
    return F.min(_c(x)).over(so_far())


def fixnan(x) -> Column:
    return F.last(_c(x), ignorenulls=True).over(so_far())


def barssince(condition: Column, i: str = "i") -> Column:
    return _c(i) - F.last(F.when(condition, _c(i)), ignorenulls=True).over(so_far())


def valuewhen(condition: Column, x, occurrence: int = 0) -> Column:
    """The value at the n-th last bar that met the condition."""
    met = F.when(condition, F.struct(_c(x).alias("x")))
    if not occurrence:
        return F.last(met, ignorenulls=True).over(so_far())["x"]
    return F.try_element_at(F.collect_list(met).over(so_far()), F.lit(-(occurrence + 1)))["x"]


def rising(moved, n: int) -> Column:
    """Of :func:`with_moves`: n strict rises in a row, steps without a value left out."""
    tail = F.slice(F.filter(F.collect_list(_c(moved)).over(back(10 * n)), lambda x: x.isNotNull()), -n, n) if n > 1 else F.array(_c(moved))
    return F.coalesce((F.size(F.collect_list(_c(moved)).over(back(10 * n))) >= n) & F.forall(tail, lambda x: x > 0), F.lit(False))


def falling(moved, n: int) -> Column:
    tail = F.slice(F.collect_list(_c(moved)).over(back(10 * n)), -n, n)
    return F.coalesce((F.size(F.collect_list(_c(moved)).over(back(10 * n))) >= n) & F.forall(tail, lambda x: x < 0), F.lit(False))


def pivot(x, left: int, right: int, high: bool = True) -> Column:
    """The value ``right`` bars ago if all neighbours are strictly lower (higher); NULL otherwise."""
    centre, f = ago(x, right), F.max if high else F.min
    older, newer = by().rowsBetween(-(left + right), -(right + 1)), by().rowsBetween(-(right - 1), 0)
    whole = F.count(_c(x)).over(back(left + right + 1)) == left + right + 1
    beats = (lambda e: centre > e) if high else (lambda e: centre < e)
    return F.when(whole & beats(f(_c(x)).over(older)) & beats(f(_c(x)).over(newer)), centre)


# -- segments ------------------------------------------------------------------------

def with_segment(bars: DataFrame, starts: Column, name: str = "segment") -> DataFrame:
    """Adds the number of starts so far."""
    return bars.withColumn("_starts", F.coalesce(starts, F.lit(False)).cast("int")).withColumn(name, F.sum("_starts").over(so_far())).drop("_starts")


def vwap(x, segment: str = "segment", mult: float | None = None) -> Column | tuple[Column, Column, Column]:
    """Volume-weighted mean since the segment's start, with bands of ``mult`` deviations."""
    own = Window.partitionBy("symbol", segment).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(_c(x).isNotNull(), F.col("volume"))
    total = F.sum(v).over(own)
    mean = div(F.sum(_c(x) * v).over(own), total)
    if mult is None:
        return mean
    spread = F.sqrt(F.greatest(F.lit(0.0), div(F.sum(_c(x) * _c(x) * v).over(own), total) - mean * mean))
    return mean, mean + mult * spread, mean - mult * spread


def pivot_point_levels(bars: DataFrame, kind: str, tf: str) -> DataFrame:
    """(symbol, period, levels) for each period of a timeframe: eleven levels from the period before it."""
    from .bars import resample

    periods = resample(bars, tf)
    before = lambda c: F.lag(c).over(by())
    o, h, lo, c = (before(x) for x in ("open", "high", "low", "close"))
    return periods.select("symbol", F.col("t").alias("period"), levels(kind, o, h, lo, c, F.col("open")).alias("levels"))


def pivot_levels_by_anchor(bars: DataFrame, kind: str, anchor: Column, developing: bool = False) -> DataFrame:
    """Adds levels to each bar: those of the period that ended at the last bar whose anchor is true, or with ``developing`` those of the period so far.

    The first bar opens a period without an anchor, too. A bar that lacks a price neither opens nor extends one; it
    shows what the bar before it shows. Before the first period has ended there are no levels.
    """
    if developing and kind == "Woodie":
        raise ValueError("Woodie's levels need the next period's opening: they do not develop")
    prices = ("open", "high", "low", "close")
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), prices, F.lit(True))
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(whole, F.coalesce(anchor, F.lit(False))).otherwise(F.lit(False))
    own = bars.withColumn("_opens", opens).withColumn("_period", F.sum(F.col("_opens").cast("int")).over(upto))
    # bars of a period that lack a price don't count
    inside = Window.partitionBy("symbol", "_period").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    only = lambda c: F.when(whole, F.col(c))
    sofar = F.struct(F.first(only("open"), ignorenulls=True).over(inside).alias("open"), F.max(only("high")).over(inside).alias("high"), F.min(only("low")).over(inside).alias("low"), F.last(only("close"), ignorenulls=True).over(inside).alias("close"))
    own = own.withColumn("_sofar", F.when(whole, sofar))
    if developing:
        x = F.last("_sofar", ignorenulls=True).over(upto)
        return own.withColumn("_x", x).withColumn("levels", levels(kind, *[F.col(f"_x.{c}") for c in prices], F.col("_x.open"))).drop("_x", "_opens", "_period", "_sofar")
    ended = F.last("_sofar", ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_ended", F.when(F.col("_opens"), F.struct(ended.alias("period"), F.col("open").alias("new")))).withColumn("_ended", F.when(F.col("_ended.period").isNotNull(), F.col("_ended")))
    own = own.withColumn("_ended", F.last("_ended", ignorenulls=True).over(upto))
    return own.withColumn("levels", levels(kind, *[F.col(f"_ended.period.{c}") for c in prices], F.col("_ended.new"))).drop("_ended", "_opens", "_period", "_sofar")


def levels(kind: str, o: Column, h: Column, lo: Column, c: Column, new_open: Column) -> Column:
    """P, R1, S1 to R5, S5 of a closed period."""
    span, p = h - lo, (h + lo + c) / 3
    none = F.lit(None).cast("double")
    if kind == "Traditional":
        out = [p, 2 * p - lo, 2 * p - h, p + span, p - span]
        for k in (2, 3, 4):
            out += [p * k + (h - k * lo), p * k - (k * h - lo)]
    elif kind == "Classic":
        out = [p, 2 * p - lo, 2 * p - h, p + span, p - span, p + 2 * span, p - 2 * span, p + 3 * span, p - 3 * span]
    elif kind == "Fibonacci":
        out = [p, *[p + s * k * span for k in (0.382, 0.618, 1.0) for s in (1, -1)]]
    elif kind == "Woodie":
        w = (h + lo + 2 * new_open) / 4
        r3, s3 = h + 2 * (w - lo), lo - 2 * (h - w)
        out = [w, 2 * w - lo, 2 * w - h, w + span, w - span, r3, s3, r3 + span, s3 - span]
    elif kind == "DM":
        x = F.when(c < o, h + 2 * lo + c).when(c > o, 2 * h + lo + c).otherwise(h + lo + 2 * c)
        out = [x / 4, x / 2 - lo, x / 2 - h]
    elif kind == "Camarilla":
        out = [p, *[c + s * span * 1.1 / k for k in (12, 6, 4, 2) for s in (1, -1)], div(h, lo) * c, c - (div(h, lo) * c - c)]
    else:
        raise ValueError(f"no such kind of pivot levels: {kind}")
    return F.array(*[finite(x) for x in out], *[none] * (11 - len(out)))
