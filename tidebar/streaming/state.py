"""Streams with state of their own: forming bars, seeding from a batch, forward returns, refresh of a longer timeframe.

All run on ``transformWithState``, whose state lives in RocksDB and is checkpointed
with the batch's number, so a stream that is stopped goes on where it was. A
symbol's state is a few numbers, its pending deadlines, or the chart bars of one
longer bar; rows of a batch come to it in time order.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = ["open", "high", "low", "close", "volume"]


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that ``transformWithState`` needs, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship(spark)


def _frame(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(order), kind="stable")


class _FormingBars(StatefulProcessor):
    """Two versions of a symbol's recurrences: the kernels after the last closed bar, and the bar that is forming. Each batch evaluates the forming bar on a copy of the kernels."""

    def __init__(self, kernels: list[tuple], size: int):
        self.kernels, self.size = kernels, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bar", "t long, " + ", ".join(f"{c} double" for c in BAR) + ", kernels binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((int(r["t"]), *(float(r[c]) for c in BAR), bytes(r["kernels"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks = _frame(rows, "t", "seq")
        ticks = ticks.assign(t=ticks["t"] // self.size * self.size)
        bars = ticks.groupby("t", sort=True).agg(open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"), volume=("volume", "sum"))
        if self.state.exists():
            t, *bar, made = self.state.get()
            made = pickle.loads(made)
        else:
            t, bar, made = None, None, [make() for _, make, _ in self.kernels]
        out = []
        for at, new in zip(bars.index.tolist(), bars.to_numpy(float).tolist(), strict=True):
            if t is not None and at < t:
                continue  # a closed bar doesn't change
            if at == t:
                bar = [bar[0], max(bar[1], new[1]), min(bar[2], new[2]), new[3], bar[4] + new[4]]
            else:
                if t is not None:
                    step(made, self.kernels, bar)
                t, bar = at, new
            out.append((*key, at, *bar, *step(copy.deepcopy(made), self.kernels, bar)))
        if t is not None:
            self.state.update((t, *bar, pickle.dumps(made)))
        yield pd.DataFrame(out, columns=["symbol", "t", *BAR, *(n for names, _, _ in self.kernels for n in names)])

    def close(self) -> None:
        pass


def step(made: list, kernels: list[tuple], bar: list[float]) -> list[float | None]:
    """One bar through all kernels."""
    values = dict(zip(BAR, bar, strict=True))
    return [v for kernel, (_, _, inputs) in zip(made, kernels, strict=True) for v in kernel.step(*[values[c] for c in inputs])]


def forming_bars(ticks: DataFrame, kernels: list[tuple], size: int, seed: DataFrame | None = None) -> DataFrame:
    """Bars of ``size`` seconds of a stream of (symbol, t, seq, price, volume) and kernels over them, in update mode: with each batch a bar's row comes again until it is closed.

    Kernels are given as to ``folds.fold``. ``seed`` is what :func:`committed`
    made of a batch of earlier bars. Ticks of bars that are closed are left out.
    """
    use_rocksdb(ticks.sparkSession)
    schema = "symbol string, t long, " + ", ".join(f"{c} double" for c in [*BAR, *(n for names, _, _ in kernels for n in names)])
    rows = ticks.select("symbol", "t", "seq", ticks["price"].cast("double").alias("price"), ticks["volume"].cast("double").alias("volume"))
    return rows.groupBy("symbol").transformWithStateInPandas(_FormingBars(kernels, size), schema, "Update", "None", seed.groupBy("symbol") if seed is not None else None)


def committed(bars: DataFrame, kernels: list[tuple]) -> DataFrame:
    """The state after a batch of bars, a row for each symbol: its last bar, which may still form, and the kernels after all before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, made, last = None, None, None
        found = lambda: pd.DataFrame([(symbol, *last, pickle.dumps(made))], columns=["symbol", "t", *BAR, "kernels"])
        for pdf in frames:
            for own, *bar in pdf[["symbol", "t", *BAR]].itertuples(index=False, name=None):
                if last is not None and own == symbol:
                    step(made, kernels, last[1:])
                else:
                    if last is not None:
                        yield found()
                    symbol, made = own, [make() for _, make, _ in kernels]
                last = bar
        if last is not None:
            yield found()

    ship(bars.sparkSession)
    rows = bars.select("symbol", bars["t"].cast("long").alias("t"), *[bars[c].cast("double").alias(c) for c in BAR])
    return rows.repartition("symbol").sortWithinPartitions("symbol", "t").mapInPandas(run, "symbol string, t long, " + ", ".join(f"{c} double" for c in BAR) + ", kernels binary")


class _ForwardReturns(StatefulProcessor):
    """Pending deadlines of a symbol's events, and a timer that gives up on those that no tick has met for a while."""

    def __init__(self, minutes: tuple[int, ...], patience: int):
        self.minutes, self.patience = minutes, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "t long, m int, price double")

    def _load(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.pending.get()), columns=["t", "m", "price"]).astype({"t": "int64", "m": "int64", "price": "float64"})

    def _keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.pending.put([(int(t), int(m), float(p)) for t, m, p in rows[["t", "m", "price"]].itertuples(index=False, name=None)])
        elif self.pending.exists():
            self.pending.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks = _frame(rows, "t")
        new = pd.DataFrame({"t": np.repeat(ticks["t"].to_numpy(), len(self.minutes)), "m": np.tile(self.minutes, len(ticks)), "price": np.repeat(ticks["price"].to_numpy(), len(self.minutes))})
        due = pd.concat([self._load(), new], ignore_index=True) if self.pending.exists() else new
        at = np.searchsorted(ticks["t"].to_numpy(), due["t"].to_numpy() + 60 * due["m"].to_numpy(), "left")
        met = at < len(ticks)
        later, price = ticks["price"].to_numpy()[at[met]], due["price"].to_numpy()[met]
        self._keep(due[~met])
        if not met.all():
            self.handle.registerTimer(1000 * int((due["t"] + 60 * due["m"])[~met].max() + self.patience))
        with np.errstate(all="ignore"):
            ret = np.where(price == 0, np.nan, 100 * (later - price) / price)
        yield pd.DataFrame({"symbol": key[0], "t": due["t"].to_numpy()[met], "m": due["m"].to_numpy()[met].astype("int32"), "ret": ret})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = self._load()
        gone = (rows["t"] + 60 * rows["m"] + self.patience) * 1000 <= expiredTimerInfo.getExpiryTimeInMs()
        self._keep(rows[~gone])
        yield pd.DataFrame({"symbol": key[0], "t": rows["t"][gone], "m": rows["m"][gone].astype("int32"), "ret": np.nan})

    def close(self) -> None:
        pass


def forward_returns(ticks: DataFrame, minutes: tuple[int, ...] = (5, 15, 30, 60), patience: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """(symbol, t, m, ret) for each tick (symbol, ts, t, price) of a stream: the change of price up to the first tick at least m minutes later, in percent.

    A row comes when that tick does. If there is none for ``patience`` seconds
    after the deadline, by the watermark, the row comes with NULL and the state
    forgets it. Ticks of a symbol come in time order; several of one second count
    as they come.
    """
    use_rocksdb(ticks.sparkSession)
    rows = ticks.withWatermark("ts", late).select("symbol", "ts", "t", ticks["price"].cast("double").alias("price"))
    return rows.groupBy("symbol").transformWithStateInPandas(_ForwardReturns(minutes, patience), "symbol string, t long, m int, ret double", "Append", "EventTime")


class _Refresh(StatefulProcessor):
    """The longer bars of a symbol that the chart hasn't passed, with the last one before; and the chart bars that a newer longer bar may change."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.longer = handle.getListState("longer", "at long, " + ", ".join(f"`{c}` double" for c in self.columns))
        self.chart, self.newest = handle.getListState("chart", "t long"), handle.getValueState("newest", "t long")

    def _put(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _frame(rows, "t")
        arrived = new.loc[new["side"] == 1, "t"].tolist()
        times = np.array(sorted(set(arrived) | ({r[0] for r in self.chart.get()} if self.chart.exists() else set())), "int64")
        known = [tuple(r) for r in self.longer.get()] if self.longer.exists() else []
        known += [(int(t), *(None if pd.isna(v) else float(v) for v in values)) for t, *values in new.loc[new["side"] == 0, ["t", *self.columns]].itertuples(index=False, name=None)]
        known.sort(key=lambda r: r[0])
        ends = np.array([r[0] for r in known], "int64")
        at = np.searchsorted(ends, times, "right") - 1
        out = [(key[0], int(t), *(known[i][1:] if i >= 0 else (None,) * len(self.columns))) for t, i in zip(times, at, strict=True)]
        newest = max([*arrived, *([self.newest.get()[0]] if self.newest.exists() else [])], default=None)
        if newest is not None:
            self.newest.update((int(newest),))
            known = known[max(int(np.searchsorted(ends, newest, "right")) - 1, 0) :]
        self._put(self.longer, known)
        self._put(self.chart, [(int(t),) for t in times if not len(ends) or t >= ends[-1]])
        yield pd.DataFrame(out, columns=["symbol", "t", *self.columns]).astype({"t": "int64"} | dict.fromkeys(self.columns, "float64"))

    def close(self) -> None:
        pass


def refreshed(chart: DataFrame, longer: DataFrame, columns: list[str]) -> DataFrame:
    """(symbol, t, columns): at each chart bar (symbol, t) of a stream, the newest bar of a stream of longer ones (symbol, at, columns), ``at`` being when a bar is complete; in update mode.

    Each stream comes in order, and either may run ahead of the other. A chart bar's
    row comes with the chart bar and again when a longer bar rolls that was complete
    by then; chart bars before the newest longer one are final and leave the state,
    as do longer bars that the chart has passed.
    """
    use_rocksdb(chart.sparkSession)
    bars = chart.selectExpr("symbol", "cast(t as long) as t", *[f"cast(null as double) as `{c}`" for c in columns], "1 as side")
    both = bars.unionAll(longer.selectExpr("symbol", "cast(at as long) as t", *[f"cast(`{c}` as double) as `{c}`" for c in columns], "0 as side"))
    schema = "symbol string, t long, " + ", ".join(f"`{c}` double" for c in columns)
    return both.groupBy("symbol").transformWithStateInPandas(_Refresh(columns), schema, "Update", "None")
