"""A broker's order book replayed over bars.

Orders are rows (symbol, i, seq, kind, id, dir, qty, limit, stop, oca, comment)
recorded at bar i. The replay walks each symbol's bars once, keeping only
working orders and open legs, and returns a row for each bar with the account
after it, what was executed and which trades closed. Everything else - trades,
statistics, drawdowns - is an aggregation or a window over these rows.

Within a bar working orders fill first, then the position is checked against
its margin, and the equity is marked at the close. An order fills from the bar
after its own on: without a level at the open; a limit or stop when the bar
touches it, or at the open if that is past it; of both the worse. An entry
against the position closes it and opens its own side. Legs close first in,
first out.

An exit may also name distances in price: ``profit`` and ``loss`` from the
average entry, and a trailing stop that stands ``offset`` behind the best price
once that is ``trail`` ahead of the entry. Risk rules of the configuration
close the position and stop new orders, for the day or for good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ship

ORDER = "seq int, kind string, id string, dir int, qty double, limit double, stop double, oca string, comment string"
#: Columns that orders may have besides.
DISTANCES = ["profit", "loss", "trail", "offset"]
_TRADE = "entry_bar bigint, exit_bar bigint, dir int, qty double, entry_price double, exit_price double, profit double, commission double, id string, exit_id string"
_BAR = f"equity double, position double, avg_price double, open_profit double, realized double, open_legs int, executions array<struct<price:double,qty:double,dir:int,id:string>>, trades array<struct<{_TRADE.replace(' ', ':').replace(',:', ',')}>>"


@dataclass
class Config:
    capital: float = 100_000.0
    qty: float = 1.0
    qty_type: str = "fixed"  # fixed, cash, percent_of_equity
    pyramiding: int = 0
    slippage: float = 0.0
    commission: float = 0.0
    commission_type: str = "per_contract"  # per_contract, per_order, percent
    margin: float = 100.0
    on_close: bool = False
    # risk rules; 0 is none
    allow: int = 0  # 1: only long entries, -1: only short ones
    max_position: float = 0.0
    max_drawdown: float = 0.0
    max_drawdown_percent: float = 0.0
    max_day_loss: float = 0.0
    max_day_fills: int = 0
    max_losing_days: int = 0


@dataclass
class Book:
    """One symbol's account."""

    config: Config
    position: float = 0.0
    realized: float = 0.0
    legs: list = field(default_factory=list)  # [bar, price, qty, id, commission, opened qty, profit]
    working: list = field(default_factory=list)
    day: int | None = None
    halted: bool = False
    halted_day: int | None = None
    losing_days: int = 0
    fills: int = 0

    def __post_init__(self):
        self.peak = self.day_start = self.day_peak = self.config.capital

    @property
    def side(self) -> int:
        return (self.position > 0) - (self.position < 0)

    @property
    def average(self) -> float:
        return sum(leg[1] * leg[2] for leg in self.legs) / abs(self.position) if self.legs else 0.0

    def equity(self, price: float) -> float:
        return self.config.capital + self.realized + self.position * (price - self.average)

    def record(self, o: dict) -> None:
        """Takes an order: cancels, changes a working one of its id, or lets it work."""
        if self.halted or self.halted_day == self.day is not None:
            return
        if o["kind"] == "cancel":
            self.working = [w for w in self.working if o["id"] and w["id"] != o["id"]]
            return
        if o["kind"] == "entry":
            for k, w in enumerate(self.working):
                if w["kind"] == "entry" and w["id"] == o["id"] and w["dir"] == o["dir"]:
                    self.working[k] = o
                    return
            if self.side == o["dir"] and len(self.legs) > self.config.pyramiding:
                return
        self.working.append(o)

    def price(self, o: dict, dir_: int, open_: float, high: float, low: float, market: float) -> float | None:
        """Where an order fills on a bar, if it does."""
        limit, stop, slip = o["limit"], o["stop"], dir_ * self.config.slippage
        if limit is None and stop is None:
            return market + slip
        worse, better = (max, min) if dir_ > 0 else (min, max)
        by_stop = worse(stop, open_) + slip if stop is not None and (high >= stop if dir_ > 0 else low <= stop) else None
        by_limit = better(limit, open_) if limit is not None and (low <= limit if dir_ > 0 else high >= limit) else None
        return worse(by_stop, by_limit) if None not in (by_stop, by_limit) else by_stop if by_limit is None else by_limit

    def size(self, o: dict, price: float) -> float:
        held = abs(self.position)
        if o["kind"] != "entry":
            return min(held, held if o["qty"] is None else o["qty"])
        if o["qty"] is not None:
            return o["qty"]
        c = self.config
        return c.qty if c.qty_type == "fixed" else c.qty / price if c.qty_type == "cash" else self.equity(price) * c.qty / 100 / price

    def capped(self, o: dict, qty: float, dir_: int) -> float:
        """What the largest position leaves of an entry."""
        most = self.config.max_position
        return qty if o["kind"] != "entry" or not most else max(0.0, min(qty, most - abs(self.position))) if self.side == dir_ else min(qty, most)

    def levels(self, o: dict, high: float, low: float) -> dict:
        """An exit with the levels that its distances give now."""
        side, limit, stop = self.side, o["limit"], o["stop"]
        if o["profit"] is not None and limit is None:
            limit = self.average + side * o["profit"]
        if o["loss"] is not None and stop is None:
            stop = self.average - side * o["loss"]
        if o["trail"] is not None:
            best = max if side > 0 else min
            o["best"] = best(o.get("best", self.average), high if side > 0 else low)
            if (o["best"] - self.average) * side >= o["trail"]:
                trailing = o["best"] - side * (o["offset"] or 0.0)
                stop = trailing if stop is None else best(stop, trailing)
        return o | {"limit": limit, "stop": stop}

    def fill(self, bar: int, o: dict, price: float, qty: float, dir_: int, executed: list, closed: list) -> None:
        c = self.config
        traded = qty + abs(self.position) if o["kind"] == "entry" and self.side == -dir_ else qty
        cost = traded * price * c.commission / 100 if c.commission_type == "percent" else c.commission if c.commission_type == "per_order" else traded * c.commission
        self.realized -= cost
        executed.append((price, traded, dir_, o["comment"] or o["id"]))
        closing = min(traded, abs(self.position)) if self.side == -dir_ else 0.0
        left = closing
        while left > 1e-12 and self.legs:
            leg = self.legs[0]
            q = min(left, leg[2])
            profit = q * (price - leg[1]) * -dir_
            self.realized += profit
            leg[6] += profit
            leg[4] += cost * q / closing
            leg[2] -= q
            left -= q
            if leg[2] <= 1e-12:
                closed.append((leg[0], bar, -dir_, leg[5], leg[1], price, leg[6] - leg[4], leg[4], leg[3], o["id"]))
                self.legs.pop(0)
        self.position += dir_ * traded
        if traded - closing > 1e-12:
            self.legs.append([bar, price, traded - closing, o["id"], 0.0 if closing else cost, traded - closing, 0.0])
        if abs(self.position) < 1e-12:
            self.position = 0.0
        if o["oca"]:
            self.working = [w for w in self.working if w["oca"] != o["oca"]]

    def settle(self, bar: int, open_: float, high: float, low: float, close: float, market: float, executed: list, closed: list) -> None:
        for o in list(self.working):
            if o not in self.working:
                continue  # another of its group has filled
            dir_ = o["dir"] if o["kind"] == "entry" else -self.side
            waits = any(o.get(d) is not None for d in ("limit", "stop", *(DISTANCES if o["kind"] == "exit" else ())))
            if not dir_:
                if not waits:
                    self.working.remove(o)
                continue
            level = self.levels(o, high, low) if o["kind"] == "exit" else o
            if waits and level["limit"] is None and level["stop"] is None:
                continue  # a trailing stop that has not been set yet
            price = self.price(level, dir_, open_, high, low, market)
            if price is None:
                continue
            self.working.remove(o)
            allow = self.config.allow
            if o["kind"] == "entry" and allow and dir_ != allow:
                o = o | {"kind": "close", "qty": None}  # a forbidden side only closes the other
                if self.side != -dir_:
                    continue
            qty = self.capped(o, self.size(o, price), dir_)
            after = abs(self.position + dir_ * (qty + (abs(self.position) if self.side == -dir_ else 0)))
            if qty > 0 and (o["kind"] != "entry" or self.equity(price) >= after * price * self.config.margin / 100):
                self.fill(bar, o, price, qty, dir_, executed, closed)
                self.fills += 1

    def rules(self, bar: int, day: int, ends_day: bool, close: float, executed: list, closed: list) -> None:
        """Closes everything and stops when a risk rule is broken."""
        c, equity = self.config, self.equity(close)
        self.peak, self.day_peak = max(self.peak, equity), max(self.day_peak, equity)
        if self.halted or self.halted_day == day:
            return
        if ends_day:
            self.losing_days = self.losing_days + 1 if equity < self.day_start else 0
        fall = self.peak - equity
        for_good = (c.max_drawdown and fall >= c.max_drawdown) or (c.max_drawdown_percent and 100 * fall >= c.max_drawdown_percent * self.peak) or (ends_day and c.max_losing_days and self.losing_days >= c.max_losing_days)
        for_today = (c.max_day_fills and self.fills >= c.max_day_fills) or (c.max_day_loss and self.day_peak - equity >= c.max_day_loss)
        if for_good or for_today:
            self.working.clear()
            if self.position:
                self.fill(bar, {"kind": "close", "id": "", "oca": None, "comment": "risk"}, close, abs(self.position), -self.side, executed, closed)
            self.halted, self.halted_day = self.halted or bool(for_good), day

    def begin(self, day: int, before: float) -> None:
        """A new day: its extremes start from the equity before it."""
        if day != self.day:
            self.day, self.fills = day, 0
            self.day_start = self.day_peak = before

    def margin_call(self, bar: int, close: float, executed: list, closed: list) -> None:
        """Sells four times what the shortfall needs once equity no longer covers the margin."""
        ratio, size = self.config.margin / 100, abs(self.position)
        if not size or ratio == self.side or self.equity(close) > size * close * ratio:
            return
        equity = self.config.capital + self.realized - abs(size * (close - self.average))
        qty = min(size, 4 * int(abs((equity - size * close * ratio) / ratio / close) * 1e8) / 1e8)
        if qty > 0:
            self.fill(bar, {"kind": "close", "id": "", "oca": None, "comment": "margin call"}, close, qty, -self.side, executed, closed)


def replay(bars: DataFrame, orders: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """(symbol, i, t, close, equity, position, avg_price, open_profit, realized, open_legs, executions, trades) for each bar."""
    fields = [x.split()[0] for x in ORDER.split(", ")] + DISTANCES
    orders = orders.withColumns({d: F.lit(None).cast("double") for d in DISTANCES if d not in orders.columns})
    day = F.floor(F.col("t") / 86_400)
    bars = bars.withColumn("_ends", F.coalesce(F.lead(day).over(Window.partitionBy("symbol").orderBy("i")) != day, F.lit(True)))
    placed = orders.groupBy("symbol", "i").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("orders"))
    joined = bars.join(placed, ["symbol", "i"], "left").select("symbol", "i", "t", "open", "high", "low", "close", "_ends", "orders")
    dealt = joined.repartition("symbol").sortWithinPartitions("symbol", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, book, before = object(), Book(config), config.capital
        for pdf in batches:
            out = []
            for own, i, t, o, h, lo, c, ends, placed_now in pdf.itertuples(index=False, name=None):
                if own != symbol:
                    symbol, book, before = own, Book(config), config.capital
                book.begin(t // 86_400, before)
                executed: list = []
                closed: list = []
                book.settle(i, o, h, lo, c, o, executed, closed)
                book.rules(i, t // 86_400, ends, c, executed, closed)
                book.margin_call(i, c, executed, closed)
                for order in () if placed_now is None else placed_now:
                    order = {k: None if isinstance(v, float) and v != v else v for k, v in (order if isinstance(order, dict) else order.asDict()).items()}
                    book.record(order)
                if config.on_close:
                    book.settle(i, c, c, c, c, c, executed, closed)
                before = book.equity(c)
                open_profit = book.position * (c - book.average)
                out.append((own, i, t, c, book.equity(c), book.position, book.average if book.legs else None, open_profit, book.realized, len(book.legs), executed, closed))
            yield pd.DataFrame(out, columns=["symbol", "i", "t", "close", *[x.strip().split()[0] for x in ("equity", "position", "avg_price", "open_profit", "realized", "open_legs", "executions", "trades")]])

    ship(dealt.sparkSession)
    return dealt.mapInPandas(run, f"symbol string, i bigint, t bigint, close double, {_BAR}")


def trades(account: DataFrame) -> DataFrame:
    """A row for each closed trade."""
    return account.select("symbol", F.explode("trades").alias("x")).select("symbol", "x.*")


def statistics(closed: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Totals and means of closed trades by symbol."""
    p = F.col("profit")
    percent = 100 * p / (F.col("entry_price") * F.col("qty"))
    win, lose = p > 0, p < 0
    return closed.groupBy("symbol").agg(
        F.count("*").alias("closedtrades"), F.count(F.when(win, 1)).alias("wintrades"), F.count(F.when(lose, 1)).alias("losstrades"), F.count(F.when(p == 0, 1)).alias("eventrades"),
        F.coalesce(F.sum(F.when(win, p)), F.lit(0.0)).alias("grossprofit"), F.coalesce(-F.sum(F.when(lose, p)), F.lit(0.0)).alias("grossloss"), F.sum(p).alias("netprofit"), (100 * F.sum(p) / capital).alias("netprofit_percent"),
        F.avg(p).alias("avg_trade"), F.avg(percent).alias("avg_trade_percent"), F.avg(F.when(win, p)).alias("avg_winning_trade"), F.avg(F.when(lose, p)).alias("avg_losing_trade"),
        F.avg(F.when(win, percent)).alias("avg_winning_trade_percent"), F.avg(F.when(lose, percent)).alias("avg_losing_trade_percent"),
    )


def drawdowns(account: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Adds the greatest fall from a peak and rise from a trough of equity so far, and the greatest position held."""
    by = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    peaked = account.withColumns({"_peak": F.greatest(F.max("equity").over(by), F.lit(capital)), "_trough": F.least(F.min("equity").over(by), F.lit(capital))})
    return peaked.withColumns({"max_drawdown": F.max(F.col("_peak") - F.col("equity")).over(by), "max_runup": F.max(F.col("equity") - F.col("_trough")).over(by), "max_held": F.max(F.abs("position")).over(by)}).drop("_peak", "_trough")
