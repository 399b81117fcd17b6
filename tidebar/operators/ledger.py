"""A paper-trading ledger over ticks: resting orders, stops and targets.

Orders (order_id, symbol, t, seq, side, type, level, stop_loss, take_profit,
qty, cancel_t) rest until a tick reaches their level; a limit never fills worse
than its level, a stop fills at the market, a market order fills at the tick it
is placed on. Positions don't net: each order opens one of its own and closes
at the first tick that reaches its stop or target, from the filling tick on.

Ticks and orders pass once, in time order by symbol; only resting orders and
open positions are kept between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship

_OUT = ["order_id", "symbol", "side", "qty", "fill_t", "fill_price", "exit_t", "exit_price", "pnl"]


def _triggers(side: str, kind: str, level: float, price: float) -> bool:
    if kind == "LIMIT":
        return price <= level if side == "BUY" else price >= level
    return price >= level if side == "BUY" else price <= level


def _stops(position: dict, price: float) -> bool:
    up = position["side"] == "BUY"
    target, stop = position["take_profit"], position["stop_loss"]
    return (target is not None and (price >= target if up else price <= target)) or (stop is not None and (price <= stop if up else price >= stop))


def replay(ticks: DataFrame, orders: DataFrame) -> DataFrame:
    """A row for each filled order: when and where it filled, and where it closed (NULL while open)."""
    names = ["order_id", "side", "type", "level", "stop_loss", "take_profit", "qty", "cancel_t"]
    placed = orders.select("symbol", "t", "seq", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("price"), *names)
    seen = ticks.select("symbol", "t", "seq", F.lit(0).alias("kind"), "price", *[F.lit(None).cast(orders.schema[n].dataType).alias(n) for n in names])
    events = seen.unionByName(placed).repartition("symbol").sortWithinPartitions("symbol", "t", "seq", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, resting, held, last = None, [], [], None
        for pdf in batches:
            out = []

            def close(p: dict, t=None, price=None, out=out) -> None:
                pnl = None if price is None else (price - p["fill_price"]) * (1 if p["side"] == "BUY" else -1) * p["qty"]
                out.append((p["order_id"], p["symbol"], p["side"], p["qty"], p["fill_t"], p["fill_price"], t, price, pnl))

            for e in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if e["symbol"] != symbol:
                    for p in held:
                        close(p)
                    symbol, resting, held, last = e["symbol"], [], [], None
                if e["kind"]:
                    if e["type"] == "MARKET":
                        if last is not None:
                            held.append(e | {"fill_t": e["t"], "fill_price": last})
                    else:
                        resting.append(e)
                    continue
                t, price = e["t"], e["price"]
                last = price
                resting = [o for o in resting if o["cancel_t"] is None or t < o["cancel_t"]]
                for o in [o for o in resting if _triggers(o["side"], o["type"], o["level"], price)]:
                    resting.remove(o)
                    better = min if o["side"] == "BUY" else max
                    held.append(o | {"fill_t": t, "fill_price": better(o["level"], price) if o["type"] == "LIMIT" else price})
                for p in [p for p in held if _stops(p, price)]:
                    held.remove(p)
                    close(p, t, price)
            yield pd.DataFrame(out, columns=_OUT)
        yield pd.DataFrame([(p["order_id"], p["symbol"], p["side"], p["qty"], p["fill_t"], p["fill_price"], None, None, None) for p in held], columns=_OUT)

    ship(events.sparkSession)
    return events.mapInPandas(run, "order_id long, symbol string, side string, qty double, fill_t long, fill_price double, exit_t long, exit_price double, pnl double")
