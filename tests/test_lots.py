"""Trades and accounts of orders in any quantity, against a walk over one symbol's orders."""

import random

import pytest
from brute import BARS, random_bars
from tidebar.operators import lots

FILLS = "symbol string, i long, seq int, price double, qty decimal(20,8), commission double"


def random_fills(symbol, bars, seed, quantities):
    r, out, at = random.Random(seed), [], 0.0
    for b in bars[1:]:
        for seq in range(r.choice([0, 0, 1, 1, 2])):
            q = -at if at and r.random() < 0.2 else r.choice(quantities) * r.choice([-1, 1])
            at = round(at + q, 8)
            out.append((symbol, b[7], seq, b[2] + seq * 0.25, q, abs(q) * 0.1))
    return out


def walk(fills, bars, capital):
    """Open legs in a list, closed from its front; (trades, account by bar) as plain dictionaries."""
    legs, closed, realized, out, peak, trough, dd, ru = [], [], 0.0, [], -1e18, 1e18, 0.0, 0.0
    held = [0.0]
    for b in bars:
        for _, _, _, price, q, comm in [f for f in fills if f[1] == b[7]]:
            realized -= comm
            position = round(sum(x["left"] * x["dir"] for x in legs), 8)
            closing = min(abs(q), abs(position)) if position * q < 0 else 0.0
            left = closing
            while left > 1e-9:
                x = legs[0]
                part = min(left, x["left"])
                gain = part * (price - x["price"]) * x["dir"]
                realized += gain
                x["gain"] += gain - comm * part / closing
                x["paid"] += comm * part / closing
                x["value"] += part * price
                x["left"], left, x["exit"] = round(x["left"] - part, 8), round(left - part, 8), b[7]
                if x["left"] == 0:
                    closed.append(legs.pop(0))
            if abs(q) - closing > 1e-9:
                paid = 0.0 if closing else comm
                size = round(abs(q) - closing, 8)
                legs.append({"bar": b[7], "price": price, "dir": 1 if q > 0 else -1, "qty": size, "left": size, "gain": -paid, "paid": paid, "value": 0.0, "exit": None})
            held.append(round(sum(x["left"] * x["dir"] for x in legs), 8))
        position = round(sum(x["left"] * x["dir"] for x in legs), 8)
        cost = sum(x["left"] * x["dir"] * x["price"] for x in legs)
        open_profit = b[5] * position - cost if position else 0.0
        equity = capital + realized + open_profit
        peak, trough = max(peak, equity), min(trough, equity)
        dd, ru = max(dd, peak - equity), max(ru, equity - trough)
        won, lost = [x["gain"] for x in closed if x["gain"] > 0], [-x["gain"] for x in closed if x["gain"] < 0]
        out.append({
            "equity": equity, "position": position, "avg_price": cost / position if position else None, "open_profit": open_profit, "open_profit_percent": 100 * open_profit / (capital + realized), "opentrades": len(legs), "closedtrades": len(closed), "wintrades": len(won), "losstrades": len(lost),
            "grossprofit": sum(won), "grossloss": sum(lost), "max_drawdown": dd, "max_runup": ru, "max_held": max(map(abs, held)), "max_held_long": max(held), "max_held_short": -min(held), "netprofit_percent": 100 * (sum(won) - sum(lost)) / capital,
        })
    return closed, legs, out


@pytest.mark.parametrize("quantities", [[1, 2, 3], [0.1, 0.2, 0.7, 1.3]])
def test_trades_and_account_equal_a_walk(spark, quantities):
    series = {s: random_bars(s, 160, k) for k, s in enumerate("abc")}
    orders = {s: random_fills(s, b, k + 10, quantities) for k, (s, b) in enumerate(series.items())}
    from decimal import Decimal

    rows = [(*f[:4], Decimal(str(round(f[4], 8))), f[5]) for o in orders.values() for f in o]
    fills = spark.createDataFrame(rows, FILLS).repartition(5)
    bars = spark.createDataFrame([b for s in series.values() for b in s], BARS).repartition(3)
    got = {}
    for t in lots.trades(fills).collect():
        got.setdefault(t.symbol, {})[t.n] = t
    account = {(a.symbol, a.i): a for a in lots.account(bars, fills, 1000.0).collect()}
    assert len(account) == 480
    for s, b in series.items():
        closed, still, curve = walk(orders[s], b, 1000.0)
        every = sorted(closed, key=lambda x: x["bar"]) + still
        assert len(got[s]) == len(every) > 20 and sum(not t.open for t in got[s].values()) == len(closed)
        for x in every:
            t = [t for t in got[s].values() if (t.entry_bar, t.entry_price, t.dir) == (x["bar"], x["price"], x["dir"])]
            assert len(t) == 1
            done = x["qty"] - x["left"]
            assert (t[0].qty, t[0].exit_bar, t[0].open) == (pytest.approx(x["qty"]), x["exit"], x["left"] > 0)
            assert t[0].closed_qty == pytest.approx(done, abs=1e-9) and t[0].commission == pytest.approx(x["paid"])
            if done:
                assert t[0].profit == pytest.approx(x["gain"], abs=1e-9) and t[0].exit_price == pytest.approx(x["value"] / done)
        for r, want in zip(b, curve, strict=True):
            for k, v in want.items():
                assert account[s, r[7]][k] == (None if v is None else pytest.approx(v, abs=1e-7)), (s, r[7], k)


def test_an_order_that_turns_the_position_closes_and_opens(spark):
    rows = [("x", 1, 0, 10.0, 2, 1.0), ("x", 2, 0, 12.0, 1, 1.0), ("x", 4, 0, 15.0, -5, 3.0), ("x", 6, 0, 11.0, 2, 1.0)]
    fills = spark.createDataFrame([(*r[:4], r[4], r[5]) for r in rows], FILLS.replace("decimal(20,8)", "int"))
    t = [(r.dir, r.qty, r.entry_bar, r.exit_bar, r.exit_price, r.profit, r.commission, r.open) for r in lots.trades(fills).orderBy("n").collect()]
    assert t == [(1, 2.0, 1, 4, 15.0, 7.0, 3.0, False), (1, 1.0, 2, 4, 15.0, 1.0, 2.0, False), (-1, 2.0, 4, 6, 11.0, 7.0, 1.0, False)]


def test_odd_orders(spark):
    """No orders; orders without a price or a quantity; a target without a next bar; bars without a close."""
    b = spark.createDataFrame([("x", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0), ("x", 3600, 2.0, 2.0, 2.0, None, 1.0, 1)], BARS)
    none = spark.createDataFrame([], FILLS)
    assert lots.trades(none).collect() == []
    assert [(r.equity, r.position, r.avg_price, r.max_held) for r in lots.account(b, none).collect()] == [(100_000.0, 0.0, None, 0.0)] * 2
    odd = spark.createDataFrame([("x", 1, 0, None, 1, 0.0), ("x", 1, 1, 5.0, None, 0.0), ("x", 1, 2, 5.0, 0, 0.0), ("x", 1, 3, 2.0, 1, None)], FILLS.replace("decimal(20,8)", "int"))
    assert [(r.entry_price, r.qty, r.open, r.profit, r.commission) for r in lots.trades(odd).collect()] == [(2.0, 1.0, True, None, 0.0)]
    assert [(r.equity, r.open_profit) for r in lots.account(b, odd).orderBy("i").collect()] == [(100_000.0, 0.0)] * 2
    from pyspark.sql import functions as F

    filled = lots.to_targets(b, F.col("i") + 1, 2.0, "cash_per_order").collect()
    assert [(r.i, r.price, float(r.qty), r.commission) for r in filled] == [(1, 2.0, 1.0, 2.0)]
