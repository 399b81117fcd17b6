"""Filters that look back at what they last let through: price checks against the last good tick, alerts with a cooldown.

What such a filter does with a row hangs on the last accepted row, however far
back. A rule tells for each row's value which states (the last accepted value)
accept it, as an interval; an accepted value is the new state. A block's summary
is therefore a list of intervals of states with the state that the block ends in;
states in none of them pass the block unchanged. A symbol's blocks are walked
from summary to summary, and each block then keeps its rows from its own start
(``scans.in_blocks``). The same walk serves a stream, whose state is one value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scans


@dataclass
class Rule:
    """``accepted_by(x)``: the least and the greatest state that accept each value. ``rising``: values never fall, so a block's states are at most its first value."""

    accepted_by: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    rising: bool = False


def within(share: float) -> Rule:
    """A value is accepted when |value - state| / state is at most ``share``; values are positive."""

    def accepted_by(x: np.ndarray):
        def ok(s: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                return np.abs(x - s) / s <= share

        low, high = x / (1 + share), x / (1 - share) if share < 1 else np.full(len(x), np.inf)
        # the ends are the last doubles for which the rule holds as it is computed
        for out, back in ((-np.inf, np.inf), (np.inf, -np.inf)):
            end = low if out < 0 else high
            for _ in range(8):
                further = np.nextafter(end, out)
                end = np.where(np.isfinite(end) & ok(further), further, end)
            for _ in range(8):
                end = np.where(np.isfinite(end) & ~ok(end), np.nextafter(end, back), end)
            low, high = (end, high) if out < 0 else (low, end)
        return low, high

    return Rule(accepted_by)


def apart(seconds: float) -> Rule:
    """A time is accepted when it is at least so long after the last accepted one."""
    return Rule(lambda x: (np.full(len(x), -np.inf), x - seconds), rising=True)


def _first(low: np.ndarray, high: np.ndarray, at: int, state: float) -> int:
    """The first row from ``at`` on that the state accepts; their number if there is none."""
    step = 64
    while at < len(low):
        hit = np.flatnonzero((low[at : at + step] <= state) & (state <= high[at : at + step]))
        if len(hit):
            return at + int(hit[0])
        at, step = at + step, step * 2
    return len(low)


def _breaks(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows that the row right before them, accepted, would not accept."""
    return np.flatnonzero((x[:-1] < low[1:]) | (x[:-1] > high[1:])) + 1


def kept(x: np.ndarray, rule: Rule, state: float) -> np.ndarray:
    """Which values are accepted after a state; NaN accepts anything."""
    low, high = rule.accepted_by(x)
    breaks, keep = np.append(_breaks(x, low, high), len(x)), np.zeros(len(x), bool)
    at = 0 if np.isnan(state) else _first(low, high, 0, state)
    while at < len(x):
        end = int(breaks[np.searchsorted(breaks, at, "right")])
        keep[at:end] = True
        at = _first(low, high, end, x[end - 1])
    return keep


def table(x: np.ndarray, rule: Rule) -> dict[str, list[float] | float]:
    """What the values make of a state: ``out`` for states from ``low`` to ``high``, ``fresh`` for none, itself for all others."""
    low, high = rule.accepted_by(x)
    breaks = np.append(_breaks(x, low, high), len(x))
    ends: dict[int, float] = {}

    def end_of(at: int) -> float:
        runs = []
        while True:
            end = int(breaks[np.searchsorted(breaks, at, "right")])
            if end in ends:
                last = ends[end]
                break
            runs.append(end)
            at = _first(low, high, end, x[end - 1])
            if at == len(x):
                last = float(x[end - 1])
                break
        ends.update(dict.fromkeys(runs, last))
        return last

    pieces: list[tuple[float, float, float]] = []
    covered: list[tuple[float, float]] = []
    at = 0
    while at < len(x):
        if rule.rising and covered and covered[-1][1] >= x[0]:
            break
        todo = [(low[at], high[at])]
        for a, b in covered:  # what earlier rows don't take
            todo = [p for lo, hi in todo for p in ((lo, min(hi, np.nextafter(a, -np.inf))), (max(lo, np.nextafter(b, np.inf)), hi)) if p[0] <= p[1]]
        pieces += [(lo, hi, end_of(at)) for lo, hi in todo]
        for lo, hi in [(low[at], high[at])] if todo else []:
            touch = [c for c in covered if c[0] <= np.nextafter(hi, np.inf) and np.nextafter(lo, -np.inf) <= c[1]]
            covered = sorted([c for c in covered if c not in touch] + [(min([lo, *(c[0] for c in touch)]), max([hi, *(c[1] for c in touch)]))])
        at += 1
        if len(covered) == 1:
            new = np.flatnonzero((low[at:] < covered[0][0]) | (high[at:] > covered[0][1]))
            at = at + int(new[0]) if len(new) else len(x)
    columns = [[float(p[k]) for p in pieces] for k in range(3)]
    return {"low": columns[0], "high": columns[1], "out": columns[2], "fresh": end_of(0)}


def after(state: float, low, high, out, fresh: float) -> float:
    """The state after a block."""
    if np.isnan(state):
        return fresh
    hit = np.flatnonzero((np.asarray(low) <= state) & (state <= np.asarray(high)))
    return float(np.asarray(out)[hit[0]]) if len(hit) else state


def last_accepted(rows: DataFrame, value: str, rule: Rule, key: str = "symbol", order: tuple[str, ...] = ("t", "seq"), span: int = 86_400, block: int = scans.BLOCK) -> DataFrame:
    """The rows that a rule accepts, in order, for each key; rows with a null value are left out."""
    rows = rows.where(rows[value].isNotNull())
    columns = rows.columns
    x = lambda piece: piece.column(f"_in_{value}").to_numpy()

    def begin(tables: pd.DataFrame) -> list[float]:
        state, out = np.nan, []
        for t in tables.itertuples():
            out.append(state)
            state = after(state, t.low, t.high, t.out, t.fresh)
        return out

    def finish(piece: pa.Table, start: float | None, own: int) -> pa.Table:
        return piece.filter(pa.array(kept(x(piece), rule, np.nan if start is None else start))).select(columns)

    return scans.in_blocks(rows, [value], lambda piece, own: table(x(piece), rule), "low array<double>, high array<double>, out array<double>, fresh double", begin, "double", finish, scans.schema_of(rows), key, order, span, block)
