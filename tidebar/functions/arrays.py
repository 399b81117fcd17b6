"""Arrays, maps and matrices. Statistics skip NULL elements; what has no value is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .na import finite


def numbers(a: Column) -> Column:
    """The elements that are numbers, as doubles."""
    return F.transform(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), lambda x: x.cast("double"))


def _fold(a: Column, step, start: float = 0.0) -> Column:
    return F.aggregate(a, F.lit(start), step)


def _some(a: Column, value: Column) -> Column:
    return F.when(F.size(a) > 0, value)


# -- access and change ---------------------------------------------------------------

def new(size: int, value: Column) -> Column:
    return F.array_repeat(value, size)


def get(a: Column, i: Column) -> Column:
    return F.get(a, i)


def first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def push(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def unshift(a: Column, x: Column) -> Column:
    return F.array_prepend(a, x)


def pop(a: Column) -> tuple[Column, Column]:
    """What is left, and what was last."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), last(a)


def shift(a: Column) -> tuple[Column, Column]:
    """What is left, and what was first."""
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), first(a)


def set_(a: Column, at: Column, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))


def insert(a: Column, at: Column, value: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), at), F.array(value), F.slice(a, at + 1, F.size(a)))


def remove(a: Column, at: Column) -> tuple[Column, Column]:
    """What is left, and what was there."""
    return F.filter(a, lambda x, i: i != at), F.get(a, at)


def fill(a: Column, value: Column, begin: int = 0, end: int | None = None) -> Column:
    return F.transform(a, lambda x, i: F.when((i >= begin) & (i < (F.size(a) if end is None else end)), value).otherwise(x))


def slice_(a: Column, begin: int, end: int | None = None) -> Column:
    """From begin up to end; negative places count from the end."""
    n = F.size(a)
    place = lambda k: F.least(F.greatest(F.lit(k) + (n if k < 0 else 0), F.lit(0)), n)
    start, stop = place(begin), n if end is None else place(end)
    return F.slice(a, start + 1, F.greatest(stop - start, F.lit(0)))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def includes(a: Column, value: Column) -> Column:
    return F.exists(a, lambda x: x.eqNullSafe(value))


def indexof(a: Column, value: Column) -> Column:
    return (F.array_position(a, value) - 1).cast("int")


def lastindexof(a: Column, value: Column) -> Column:
    back = F.array_position(F.reverse(a), value)
    return F.when(back > 0, F.size(a) - back).otherwise(-1).cast("int")


def reverse(a: Column) -> Column:
    return F.reverse(a)


def sort(a: Column, ascending: bool = True) -> Column:
    return F.sort_array(a, ascending)


def sort_indices(a: Column, ascending: bool = True) -> Column:
    """Places in the order of their elements; equal ones in their own order."""
    keyed = F.transform(a, lambda x, i: F.struct((x if ascending else -x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def _below(a: Column, value: Column) -> Column:
    return F.size(F.filter(a, lambda x: x < value))


def binary_search(a: Column, value: Column) -> Column:
    """In a sorted array the place of a value, or -(where it would go) - 1."""
    at = _below(a, value)
    return F.when(F.get(a, at) == value, at).otherwise(-at - 1)


def binary_search_leftmost(a: Column, value: Column) -> Column:
    return binary_search(a, value)


def binary_search_rightmost(a: Column, value: Column) -> Column:
    upto = F.size(F.filter(a, lambda x: x <= value))
    return F.when(upto > _below(a, value), upto - 1).otherwise(-_below(a, value) - 1)


# -- statistics ----------------------------------------------------------------------

def sum_(a: Column) -> Column:
    x = numbers(a)
    return _some(x, _fold(x, lambda s, v: s + v))


def avg(a: Column) -> Column:
    return sum_(a) / F.size(numbers(a))


def max_(a: Column) -> Column:
    return F.array_max(numbers(a))


def min_(a: Column) -> Column:
    return F.array_min(numbers(a))


def range_(a: Column) -> Column:
    return max_(a) - min_(a)


def median(a: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        half = F.floor(n / 2).cast("int")
        return F.when(n == 0, None).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)

    return _let(F.array_sort(numbers(a)), middle)


def mode(a: Column) -> Column:
    """The most frequent; of several, the first met. Counts come from one pass over the sorted places."""
    placed = F.array_sort(F.transform(numbers(a), lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i"))))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("v")).alias("best"))

    def step(s: Column, p: Column) -> Column:
        same = F.coalesce(s["v"] == p["v"], F.lit(False))
        n, i = F.when(same, s["n"] + 1).otherwise(1), F.when(same, s["i"]).otherwise(-p["i"])
        return F.struct(p["v"].alias("v"), n.alias("n"), i.alias("i"), F.greatest(s["best"], F.struct(n.alias("n"), i.alias("i"), p["v"].alias("v"))).alias("best"))

    return F.aggregate(placed, start, step)["best"]["v"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once for the row: a lambda evaluates what stands in it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _moments(pairs: Column) -> Column:
    """n, and sums of x, y, x * x, y * y and x * y of an array of (x, y), each less the first pair so that large values keep their digits: one pass."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")])

    def add(first: Column):
        def one(s: Column, p: Column) -> Column:
            x, y = p["x"] - first["x"], p["y"] - first["y"]
            return F.struct((s["n"] + 1.0).alias("n"), (s["x"] + x).alias("x"), (s["y"] + y).alias("y"), (s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy"), (s["xy"] + x * y).alias("xy"))

        return one

    return _let(F.struct(pairs.alias("p"), F.get(pairs, F.lit(0)).alias("first")), lambda r: F.aggregate(r["p"], zero, add(r["first"])))


def _spread(s: Column, over: Column, x: str = "x", y: str = "x") -> Column:
    """Of moments, the sum of products about the means, divided."""
    return F.try_divide(s[x + y] - F.try_divide(s[x] * s[y], s["n"]), over)


def variance(a: Column, biased: bool = True) -> Column:
    pairs = F.transform(numbers(a), lambda v: F.struct(v.cast("double").alias("x"), F.lit(0.0).alias("y")))
    return _let(_moments(pairs), lambda s: F.greatest(_spread(s, s["n"] - (0 if biased else 1)), F.lit(0.0) * s["n"] + F.when(s["n"] > (0 if biased else 1), 0.0)))


def stdev(a: Column, biased: bool = True) -> Column:
    return F.sqrt(variance(a, biased))


def every(a: Column) -> Column:
    return F.forall(a, lambda x: F.coalesce(x.cast("boolean"), F.lit(False)))


def some(a: Column) -> Column:
    return F.exists(a, lambda x: F.coalesce(x.cast("boolean"), F.lit(False)))


def join(a: Column, separator: str = ", ") -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), separator)


def abs_(a: Column) -> Column:
    return F.transform(a, F.abs)


def percentrank(a: Column, value: Column) -> Column:
    x = numbers(a)
    return F.try_divide(100.0 * F.size(F.filter(x, lambda v: v <= value)), F.size(x))


def standardize(a: Column, biased: bool = True) -> Column:
    row = F.struct(numbers(a).alias("x"), avg(a).alias("mean"), stdev(a, biased).alias("spread"))
    return _let(row, lambda r: F.transform(r["x"], lambda x: F.when(r["spread"] == 0, 0.0).otherwise((x - r["mean"]) / r["spread"])))


def _pairs(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def covariance(a: Column, b: Column, biased: bool = True) -> Column:
    return _let(_moments(_pairs(a, b)), lambda s: _spread(s, s["n"] - (0 if biased else 1), "x", "y"))


def correlation(a: Column, b: Column) -> Column:
    one = F.lit(1.0)
    return _let(_moments(_pairs(a, b)), lambda s: finite(F.try_divide(_spread(s, one, "x", "y"), F.sqrt(F.greatest(_spread(s, one) * _spread(s, one, "y", "y"), F.lit(0.0))))))


def percentile_linear_interpolation(a: Column, percentage: float) -> Column:
    def between(s: Column) -> Column:
        place = (percentage / 100) * (F.size(s) - 1)
        low, high = F.get(s, F.floor(place).cast("int")), F.get(s, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return _let(F.array_sort(numbers(a)), between)


def percentile_nearest_rank(a: Column, percentage: float) -> Column:
    return _let(F.array_sort(numbers(a)), lambda s: F.get(s, F.greatest(F.lit(1), F.ceil(percentage / 100 * F.size(s))).cast("int") - 1))


# -- maps ----------------------------------------------------------------------------

def map_put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_put_all(m: Column, other: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k)), other)


def map_get(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def map_remove(m: Column, key: Column) -> tuple[Column, Column]:
    """What is left, and what the key had."""
    return F.map_filter(m, lambda k, _: k != key), F.try_element_at(m, key)


# -- matrices ------------------------------------------------------------------------

def matrix_new(rows: int, columns: int, value: Column) -> Column:
    return F.array_repeat(F.array_repeat(value, columns), rows)


def matrix_rows(m: Column) -> Column:
    return F.size(m)


def matrix_columns(m: Column) -> Column:
    return F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))


def matrix_get(m: Column, row: Column, column: Column) -> Column:
    """A cell; outside the matrix it is an error."""
    return F.element_at(F.element_at(m, row + 1), column + 1)


def matrix_set(m: Column, row: Column, column: Column, value: Column) -> Column:
    return F.transform(m, lambda r, i: F.when(i == row, set_(r, column, value)).otherwise(r))


def matrix_row(m: Column, row: Column) -> Column:
    return F.element_at(m, row + 1)


def matrix_add_row(m: Column, at: Column, row: Column) -> Column:
    fits = (F.size(m) == 0) | (F.size(row) == matrix_columns(m))
    return F.when(fits, insert(m, at, row)).otherwise(F.raise_error(F.lit("the row's length is not the matrix's width")))


def matrix_remove_row(m: Column, at: Column) -> tuple[Column, Column]:
    return remove(m, at)
