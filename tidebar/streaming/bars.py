"""Bars, dedup and recurrences under Structured Streaming.

A closed bar is committed once the watermark passes its end; late ticks within
the watermark still change it. In update mode the forming bar is emitted again
with each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import ship
from ..operators.scans import ema_steps, prefixes, rma_steps, values


def minute_bars(ticks: DataFrame, size: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Bars of a stream of (symbol, ts, seq, price, volume)."""
    at = F.struct("ts", "seq", "price")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", size).alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sliding_volume(ticks: DataFrame, size: str, slide: str, late: str = "2 minutes") -> DataFrame:
    """Volume of overlapping windows."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", size, slide).alias("w")).agg(F.sum("volume").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "volume")


def dedup(ticks: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark; what reconnecting sends again is dropped."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def averages(bars: DataFrame, n: int = 10) -> DataFrame:
    """Exponential and Wilder averages of closes, state kept for each symbol between batches.

    Bars of a batch are taken in time order; bars before the last committed one
    are left out, as a committed bar does not change.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, rma, tail, last = state.get if state.exists else (None, None, [], None)
        rows = pd.concat(list(frames)).sort_values("ts")
        if last is not None:
            rows = rows[rows["ts"] > pd.Timestamp(last, unit="us", tz=rows["ts"].dt.tz)]
        if len(rows):
            x = np.concatenate([np.array(tail, float), rows["close"].to_numpy(float)])
            own = slice(len(tail), None)
            starts = (np.nan if v is None else v for v in (ema, rma))
            out = [values(prefixes(*(np.asarray(p)[own] for p in steps(x, None))), start) for steps, start in zip((ema_steps(n), rma_steps(n)), starts, strict=True)]
            ema, rma = (None if np.isnan(v[-1]) else float(v[-1]) for v in out)
            tail, last = [None if np.isnan(v) else float(v) for v in x[-n:]][1 - n :] if n > 1 else [], int(rows["ts"].iloc[-1].value // 1000)
            yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"], "close": rows["close"], "ema": out[0], "rma": out[1]})
        state.update((ema, rma, tail, last))

    ship(bars.sparkSession)
    return bars.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, ts timestamp, close double, ema double, rma double", "ema double, rma double, tail array<double>, ts bigint", "append", GroupStateTimeout.NoTimeout
    )
