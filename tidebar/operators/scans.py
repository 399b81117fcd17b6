"""Linear recurrences as a scan of two levels, so that one symbol's bars are many tasks.

A bar's step takes the value before to a * value + b, or to s if there is none
yet; a result of NaN is "none" again. Such steps compose to steps of the same
form, which is what lets seeds and missing inputs go through a scan:

1. Bars are dealt by symbol and span of time, sorted, and cut into pieces of at
   most ``BLOCK`` bars. Each piece is written with a summary: its first and its
   last few inputs, as many as a step looks back at (``reach``), and the steps in
   between composed to one, in numpy by doubling.
2. A symbol's summaries are walked in order. That gives each piece the value, the
   number of bars and the inputs that lie before it.
3. Each piece works out its values from these.

Bars are shuffled and worked on once; an indicator may need two rounds, as the
second recurrence reads the first (``evaluate``). Nulls are NaN inside; null
results are NULL again outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..functions.na import div
from ..store import written

BLOCK = 4096


@dataclass
class Recurrence:
    """``steps(x, places)`` gives (a, b, s) for each value of x; x = ``source`` of the input columns. ``reach``: how many bars before a bar both look at."""

    name: str
    columns: tuple[str, ...]
    steps: Callable
    reach: int = 0
    source: Callable = np.asarray


def before(x: np.ndarray) -> np.ndarray:
    """Each bar's value one bar earlier."""
    return np.append(np.nan, x[:-1])


def gain(x: np.ndarray) -> np.ndarray:
    return np.maximum(x - before(x), 0.0)


def loss(x: np.ndarray) -> np.ndarray:
    return np.maximum(before(x) - x, 0.0)


def change(x: np.ndarray) -> np.ndarray:
    return x - before(x)


def size_of_change(x: np.ndarray) -> np.ndarray:
    return np.abs(x - before(x))


def true_range(h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    """fmax ignores what a close that is missing makes."""
    c1 = before(c)
    return np.fmax(h - lo, np.fmax(np.abs(h - c1), np.abs(lo - c1))) + 0 * (h - lo)


def plus_movement(h: np.ndarray, lo: np.ndarray) -> np.ndarray:
    up, down = h - before(h), before(lo) - lo
    return np.where((up > down) & (up > 0), up, 0.0) + 0 * (up + down)


def minus_movement(h: np.ndarray, lo: np.ndarray) -> np.ndarray:
    up, down = h - before(h), before(lo) - lo
    return np.where((down > up) & (down > 0), down, 0.0) + 0 * (up + down)


def _mean_of_last(x: np.ndarray, n: int) -> np.ndarray:
    """NaN unless all n are there."""
    return np.lib.stride_tricks.sliding_window_view(np.append(np.full(n - 1, np.nan), x), n).mean(axis=1)


def _decay(keep: float, x: np.ndarray, seed: np.ndarray):
    null = np.isnan(x)
    return np.where(null, 0.0, keep), (1 - keep) * x, np.where(null, np.nan, seed)


def ema_steps(n: int):
    """Starts with the first value; NULL gives NULL and starts anew."""
    return lambda x, places: _decay(1 - 2 / (n + 1), x, x)


def rma_steps(n: int):
    """Wilder's average: starts, also after NULL, with the mean of n bars that are all there."""
    return lambda x, places: _decay(1 - 1 / n, x, _mean_of_last(x, n))


def seeded_ema_steps(n: int):
    """The chart's exponential average: starts at bar n - 1 with the mean of the first n."""
    return lambda x, places: _decay(1 - 2 / (n + 1), x, np.where(places == n - 1, _mean_of_last(x, n), np.nan))


def ewm_steps(alpha: float):
    """Exponential mean that NULL doesn't move."""
    return lambda x, places: (np.where(np.isnan(x), 1.0, 1 - alpha), np.where(np.isnan(x), 0.0, alpha * x), x)


def count_steps(x: np.ndarray, places: np.ndarray):
    """How many values there were."""
    one = 1.0 - np.isnan(x)
    return np.ones(len(x)), one, one


def compose(first, then):
    """One step that does ``first`` and then ``then``; a triple of arrays each."""
    (a, b, s), (a2, b2, s2) = first, then
    return np.where(np.isnan(b), 0.0, a2 * a), np.where(np.isnan(b), s2, a2 * b + b2), np.where(np.isnan(s), s2, a2 * s + b2)


def prefixes(a: np.ndarray, b: np.ndarray, s: np.ndarray):
    """Compositions of all steps up to each one, by doubling; steps along the first axis."""
    shift = 1
    while shift < len(a):
        head = tuple(x[:shift] for x in (a, b, s))
        rest = compose(tuple(x[:-shift] for x in (a, b, s)), tuple(x[shift:] for x in (a, b, s)))
        a, b, s = (np.concatenate(p) for p in zip(head, rest, strict=True))
        shift *= 2
    return a, b, s


def values(steps, start: np.ndarray) -> np.ndarray:
    """What composed steps make of a value before them, NaN being none."""
    a, b, s = steps
    return np.where(np.isnan(start), s, a * start + b)


#: The span of rows whose values are known; it lies before all others.
KNOWN = -(1 << 62)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, int]]:
    """Rows of one group in pieces of at most ``most``, and the piece's number in its group."""
    held: list[pa.RecordBatch] = []
    rows, number, last = 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("_group").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            while first < end:
                if held and (group[first] != last or rows == most):
                    yield pa.Table.from_batches(held), number
                    held, rows, number = [], 0, number + 1 if group[first] == last else 0
                elif group[first] != last:
                    number = 0
                take = min(end - first, most - rows)
                held.append(batch.slice(first, take))
                rows, first, last = rows + take, first + take, group[first]
    if held:
        yield pa.Table.from_batches(held), number


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def in_blocks(bars: DataFrame, inputs: list[str], summary: Callable, summary_schema: str, begin: Callable, start_type: str, finish: Callable, schema: str, key: str = "symbol", order: tuple[str, ...] = ("t",), span: int = BLOCK * 3600, block: int = BLOCK, known=None) -> DataFrame:
    """A symbol's rows in pieces: ``summary(rows, span)`` of a piece, ``begin(summaries)`` of a symbol in order gives what each piece starts with, ``finish(rows, start, span)`` gives its rows.

    ``rows`` are an Arrow table in order. Inputs are doubles with the prefix _in_.
    Only the summaries of a symbol come together in one task. Rows for which
    ``known`` holds are pieces of the span ``KNOWN``.
    """
    ship(bars.sparkSession)
    at = F.floor(F.col(order[0]) / span).cast("long")
    at = F.when(known, KNOWN).otherwise(at) if known is not None else at
    rows = bars.select(*bars.columns, *[F.col(c).cast("double").alias(f"_in_{c}") for c in inputs], at.alias("_span"))
    rows = rows.withColumn("_group", F.xxhash64(key, "_span")).repartition(key, "_span").sortWithinPartitions(key, "_span", *order)
    kind = dict(bars.dtypes)[key]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, number in _pieces(batches, block):
            own = piece.column("_span")[0].as_py()
            found = summary(piece, own)
            columns = [piece.column(key).slice(0, 1).combine_chunks(), pa.array([own], pa.int64()), pa.array([number], pa.int64()), *(pa.array([v]) for v in found.values()), pa.array([_packed(piece.drop_columns(["_span", "_group"]))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_at", "_piece", *found, "_rows"])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_at", "_piece"])
        return pd.DataFrame({"_key": pdf["_key"], "_at": pdf["_at"], "_piece": pdf["_piece"], "_start": begin(pdf)})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, start, data in zip(batch.column("_at").to_pylist(), batch.column("_start").to_pylist(), batch.column("_rows"), strict=True):
                yield from finish(pa.ipc.open_stream(data.as_buffer()).read_all(), start, own).combine_chunks().to_batches()

    blocks = written(rows.mapInArrow(pack, f"_key {kind}, _at long, _piece long, {summary_schema}, _rows binary"), "blocks")
    begun = blocks.drop("_rows").groupBy("_key").applyInPandas(starts, f"_key {kind}, _at long, _piece long, _start {start_type}")
    begun = begun.select(F.col("_key").alias("_of"), F.col("_at").alias("_of_at"), F.col("_piece").alias("_of_piece"), "_start")
    same = F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_at") == F.col("_of_at")) & (F.col("_piece") == F.col("_of_piece"))
    return blocks.select("_key", "_at", "_piece", "_rows").join(begun, same).select("_at", "_start", "_rows").mapInArrow(apply, schema)


def scan(bars: DataFrame, recurrences: list[Recurrence], key: str = "symbol", order: str = "t", span: int = BLOCK * 3600, block: int = BLOCK, place: str | None = None, stored: list[str] | None = None, known=None) -> DataFrame:
    """Adds the recurrences' values to bars, and each bar's place in its symbol if ``place`` names a column for it.

    Bars for which ``known`` holds lie before all others of their symbol and don't
    come back; their last values, in the columns ``stored``, are what others start from.
    """
    names, columns, stored = [r.name for r in recurrences], bars.columns, stored or []
    inputs = sorted({c for r in recurrences for c in r.columns})
    reach, k, far = max(r.reach for r in recurrences), len(names), 1 << 40

    def steps(x: np.ndarray, first: int):
        """(a, b, s) of rows whose inputs are columns of x, rows x recurrences; ``first`` is the place of the first."""
        places = first + np.arange(len(x))
        with np.errstate(all="ignore"):
            parts = [r.steps(r.source(*[x[:, inputs.index(c)] for c in r.columns]), places) for r in recurrences]
        return tuple(np.stack([np.asarray(p[j], float) for p in parts], axis=1) for j in range(3))

    def taken(rows: pa.Table) -> np.ndarray:
        return np.stack([rows.column(f"_in_{c}").to_numpy() for c in inputs], axis=1)

    def summary(rows: pa.Table, own: int) -> dict:
        x, n = taken(rows), len(rows)
        if own == KNOWN:
            total = (np.zeros(k), *[np.array([rows.column(f"_in_stored_{c}").to_numpy(zero_copy_only=False)[-1] for c in stored], float)] * 2)
        elif n > reach:  # what comes after the head looks back at the piece alone
            total = tuple(v[-1] for v in prefixes(*(v[reach:] for v in steps(x, far))))
        else:
            total = (np.ones(k), np.zeros(k), np.full(k, np.nan))
        return {"n": n, "a": total[0], "b": total[1], "s": total[2], "head": x[:reach].ravel(), "tail": x[max(0, n - reach) :].ravel()}

    def begin(pieces: pd.DataFrame) -> list:
        tail, value, place, out = np.empty((0, len(inputs))), np.full(k, np.nan), 0, []
        for p in pieces.itertuples():
            out.append(np.concatenate([[place], value, tail.ravel()]))
            head = np.array(p.head, float).reshape(-1, len(inputs))
            if p._2 == KNOWN:
                value, place = np.array(p.s, float), far
            else:
                if len(head):
                    own = steps(np.concatenate([tail, head]), place - len(tail))
                    value = values(tuple(v[-1] for v in prefixes(*(v[len(tail) :] for v in own))), value)
                value = values(tuple(np.array(v, float) for v in (p.a, p.b, p.s)), value)
                place += p.n
            joined = np.concatenate([tail, np.array(p.tail, float).reshape(-1, len(inputs))])
            tail = joined[max(0, len(joined) - reach) :]
        return out

    def finish(rows: pa.Table, start: list, own: int) -> pa.Table:
        first, value, tail = int(start[0]), np.array(start[1 : k + 1], float), np.array(start[k + 1 :], float).reshape(-1, len(inputs))
        found = steps(np.concatenate([tail, taken(rows)]), first - len(tail))
        out = values(prefixes(*(v[len(tail) :] for v in found)), value)
        table = rows.select(columns)
        for i, name in enumerate(names):
            table = table.append_column(name, pa.array(out[:, i], from_pandas=True))
        if place:
            table = table.append_column(place, pa.array(first + np.arange(len(rows))))
        return table.slice(0, 0 if own == KNOWN else None)

    wide = bars.withColumns({f"stored_{c}": F.col(c) for c in stored}) if stored else bars
    schema = f"{schema_of(bars)}, " + ", ".join(f"`{n}` double" for n in names) + (f", `{place}` long" if place else "")
    lists = ", ".join(f"{n} array<double>" for n in ("a", "b", "s", "head", "tail"))
    return in_blocks(wide, [*inputs, *(f"stored_{c}" for c in stored)], summary, f"n long, {lists}", begin, "array<double>", finish, schema, key, (order,), span, block, known)


def first_changes(old: DataFrame, new: DataFrame, columns: list[str], key: str = "symbol", order: str = "t") -> DataFrame:
    """(key, first): where a new version of a series first differs from an old one, by hashes of its rows; only keys that do. A row that is gone counts at its own place."""
    versions = [df.select(key, order, F.xxhash64(*columns).alias(name)) for df, name in ((old, "_old"), (new, "_new"))]
    both = versions[0].unionByName(versions[1], allowMissingColumns=True).groupBy(key, order).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).groupBy(key).agg(F.min(order).alias("first"))


def corrected(stored: DataFrame, bars: DataFrame, recurrences: list[Recurrence], columns: list[str], key: str = "symbol", order: str = "t", span: int = BLOCK * 3600, block: int = BLOCK) -> DataFrame:
    """A new version of bars with the recurrences' values, from ``stored``, an old version with its values; ``recomputed`` tells which were worked out anew.

    Only symbols with a change are, and only from their first changed bar on: that
    is where a scan begins, with the values stored for the bar before, and looks at
    no more than ``reach`` bars before it. All other values are taken over.
    """
    names, reach = [r.name for r in recurrences], max(1, *(r.reach for r in recurrences))
    known = stored.select(key, order, *[F.col(n).alias(f"_was_{n}") for n in names])
    since = first_changes(stored, bars, columns, key, order)
    rows = bars.join(since, key, "left").join(known, [key, order], "left")
    changed, same = F.coalesce(F.col(order) >= F.col("first"), F.lit(False)), [F.col(f"_was_{n}").alias(n) for n in names]
    kept = rows.where(~changed).select(*bars.columns, *same, F.lit(False).alias("recomputed"))
    # of the bars before a change only the nearest come along
    near = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    earlier = rows.where(F.col(order) < F.col("first")).withColumn("_near", near).where(F.col("_near") <= reach).drop("_near").withColumn("_known", F.lit(True))
    anew = scan(rows.where(changed).withColumn("_known", F.lit(False)).unionByName(earlier), recurrences, key, order, span, block, None, [f"_was_{n}" for n in names], F.col("_known"))
    return kept.unionByName(anew.select(*bars.columns, *names, F.lit(True).alias("recomputed")))


@dataclass
class Indicator:
    """Recurrences over the bars, columns of their values, recurrences over these, and the columns that are shown."""

    shown: dict[str, Column]
    first: list[Recurrence]
    between: dict[str, Column] = field(default_factory=dict)
    second: list[Recurrence] = field(default_factory=list)


HLC = ("high", "low", "close")


def ema(name: str, n: int, x: str = "close") -> Indicator:
    return Indicator({name: F.col(name)}, [Recurrence(name, (x,), ema_steps(n))])


def rma(name: str, n: int, x: str = "close") -> Indicator:
    return Indicator({name: F.col(name)}, [Recurrence(name, (x,), rma_steps(n), n - 1)])


def rsi(name: str, n: int, x: str = "close") -> Indicator:
    g, lo = F.col(f"_{name}_gain"), F.col(f"_{name}_loss")
    value = F.when((g != 0) | (lo != 0), F.when(lo == 0, 100.0).otherwise(100 - 100 / (1 + div(g, lo))))
    return Indicator({name: value}, [Recurrence(f"_{name}_gain", (x,), rma_steps(n), n, gain), Recurrence(f"_{name}_loss", (x,), rma_steps(n), n, loss)])


def atr(name: str, n: int) -> Indicator:
    return Indicator({name: F.col(name)}, [Recurrence(name, HLC, rma_steps(n), n, true_range)])


def macd(line: str, signal: str, hist: str, fast: int = 12, slow: int = 26, n: int = 9, x: str = "close") -> Indicator:
    f, s = f"_{line}_fast", f"_{line}_slow"
    first = [Recurrence(f, (x,), ema_steps(fast)), Recurrence(s, (x,), ema_steps(slow))]
    return Indicator({line: F.col(line), signal: F.col(signal), hist: F.col(line) - F.col(signal)}, first, {line: F.col(f) - F.col(s)}, [Recurrence(signal, (line,), ema_steps(n))])


def tsi(name: str, short: int = 13, long: int = 25, x: str = "close") -> Indicator:
    n, d = f"_{name}_n", f"_{name}_d"
    first = [Recurrence(n, (x,), ema_steps(long), 1, change), Recurrence(d, (x,), ema_steps(long), 1, size_of_change)]
    return Indicator({name: 100 * div(F.col(f"{n}2"), F.col(f"{d}2"))}, first, {}, [Recurrence(f"{n}2", (n,), ema_steps(short)), Recurrence(f"{d}2", (d,), ema_steps(short))])


def dmi(plus: str, minus: str, adx: str, n: int, smoothing: int | None = None) -> Indicator:
    k = smoothing or n
    t, p, m = (f"_{adx}_{c}" for c in "tpm")
    first = [Recurrence(t, HLC, rma_steps(n), n, true_range), Recurrence(p, ("high", "low"), rma_steps(n), n, plus_movement), Recurrence(m, ("high", "low"), rma_steps(n), n, minus_movement)]
    known = F.col(t).isNotNull() & F.col(p).isNotNull() & F.col(m).isNotNull()
    share = {name: F.when(known, F.when(F.col(t) == 0, 0.0).otherwise(100 * div(F.col(c), F.col(t)))) for name, c in ((plus, p), (minus, m))}
    both = share[plus] + share[minus]
    dx = F.when(both == 0, 0.0).otherwise(100 * div(F.abs(share[plus] - share[minus]), both))
    return Indicator({plus: F.col(plus), minus: F.col(minus), adx: F.col(adx)}, first, {**share, f"_{adx}_dx": dx}, [Recurrence(adx, (f"_{adx}_dx",), rma_steps(k), k - 1)])


def keltner(basis: str, upper: str, lower: str, width: str, n: int = 20, mult: float = 2.0, x: str = "close") -> Indicator:
    b, s = F.col(f"_{basis}_b"), F.col(f"_{basis}_s")
    whole = s + 0 * b
    return Indicator({basis: b + 0 * s, upper: b + mult * s, lower: b - mult * s, width: F.when(b == 0, 0 * whole).otherwise(2 * mult * div(s, b))}, [Recurrence(f"_{basis}_b", (x,), ema_steps(n)), Recurrence(f"_{basis}_s", HLC, ema_steps(n), 1, true_range)])


def ewm(name: str, alpha: float, least: int, x: str = "close") -> Indicator:
    """pandas' exponential mean (adjust=False), shown from ``least`` values on."""
    return Indicator({name: F.when(F.col(f"_{name}_n") >= least, F.col(f"_{name}_v"))}, [Recurrence(f"_{name}_v", (x,), ewm_steps(alpha)), Recurrence(f"_{name}_n", (x,), count_steps)])


def seeded_ema(name: str, n: int, x: str = "close") -> Indicator:
    return Indicator({name: F.col(name)}, [Recurrence(name, (x,), seeded_ema_steps(n), n - 1)])


def evaluate(bars: DataFrame, indicators: list[Indicator], span: int = BLOCK * 3600, block: int = BLOCK) -> DataFrame:
    """Adds the indicators."""
    b = scan(bars, [r for x in indicators for r in x.first], span=span, block=block)
    between = {k: c for x in indicators for k, c in x.between.items()}
    b = b.withColumns(between) if between else b
    second = [r for x in indicators for r in x.second]
    b = scan(b, second, span=span, block=block) if second else b
    return b.withColumns({k: c for x in indicators for k, c in x.shown.items()}).select(*bars.columns, *[k for x in indicators for k in x.shown])
