import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidebar.functions import numeric, text
from tidebar.operators import accepted, align, bars, broker, flow, folds, guard, rolling, spans
from tidebar.sources import files


def ramp(spark, n=30):
    """open = 100 + i, high = 102 + i, low = 99 + i, close = 100 + i, volume = 1000 + 10 i, a bar a minute."""
    rows = [("x", 60 * i, 100.0 + i, 102.0 + i, 99.0 + i, 100.0 + i, 1000.0 + 10 * i, i) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double, i long")


def column(df, name):
    return [r[name] for r in df.orderBy("t").select(name).collect()]


def test_strict_and_loose_windows(spark):
    b = ramp(spark, 6).withColumn("x", F.when(F.col("i") != 2, F.col("close")))
    assert column(b.withColumn("o", rolling.sma("x", 2)), "o") == [None, 100.5, None, None, 103.5, 104.5]
    assert column(b.withColumn("o", rolling.sum_loose("x", 2)), "o") == [100.0, 201.0, 101.0, 103.0, 207.0, 209.0]
    assert column(rolling.with_cum(b, "x", "o"), "o") == [100.0, 201.0, None, 103.0, 207.0, 312.0]


def test_seeds_of_recurrences():
    ema, rma = folds.Ema(3), folds.Rma(3)
    assert [ema.step(x)[0] for x in (1.0, 2.0, None, 5.0)] == [1.0, 1.5, None, 5.0]
    assert [rma.step(x)[0] for x in (1.0, 2.0, 3.0)] == [None, None, 2.0]
    assert folds.SeededEma(2).step(1.0) == (None,)


def test_fold_keeps_state_between_batches(spark):
    b = ramp(spark, 300)
    whole = folds.fold(b, [(["e"], lambda: folds.Ema(10), ["close"])])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        parts = column(folds.fold(b, [(["e"], lambda: folds.Ema(10), ["close"])]), "e")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts == column(whole, "e")


def test_rsi_of_a_ramp_is_100():
    rsi = folds.Rsi(3)
    assert [rsi.step(float(i))[0] for i in range(6)] == [None, None, None, 100.0, 100.0, 100.0]


def test_rounding_goes_up(spark):
    assert [r[0] for r in spark.createDataFrame([(-1.5,), (1.5,), (-0.5,)], "x double").select(numeric.round_(F.col("x"))).collect()] == [-1, 2, 0]


def test_random_matches_the_generator(spark):
    def want(seed, bar):
        x = ((seed * 0x9E3779B1) & 0xFFFFFFFF) ^ (((bar + 1) * 0x85EBCA6B) & 0xFFFFFFFF)
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        return x

    got = spark.range(2000).select(numeric.xorshift(F.lit(7), F.col("id"))).collect()
    assert [r[0] for r in got] == [want(7, i) for i in range(2000)]


def test_timeframes(spark):
    assert [bars.seconds(x) for x in ("15", "30S", "4H", "D", "2W")] == [900, 30, 14_400, 86_400, 1_209_600]
    assert [bars.from_seconds(x) for x in (1, 300, 86_400, 604_800)] == ["1S", "5", "1D", "1W"]
    t = spark.createDataFrame([(1_700_000_000,)], "t long")
    assert t.select(bars.floor_to(F.col("t"), "W"), bars.floor_to(F.col("t"), "M"), bars.next_of(bars.floor_to(F.col("t"), "M"), "M")).first()[:] == (1_699_833_600, 1_698_796_800, 1_701_388_800)
    with pytest.raises(ValueError, match="timeframe"):
        bars.timeframe("7X")


def test_security_waits_for_the_end(spark):
    chart = ramp(spark, 24).withColumn("t", F.col("i") * 900)
    higher = bars.resample(chart, "60")
    off = align.security(chart, higher, "60", ["close"], 900)
    assert [r.other.close if r.other else None for r in off.orderBy("t").collect()][:9] == [None] * 4 + [103.0] * 4 + [107.0]
    on = align.security(chart, higher, "60", ["close"], 900, lookahead=True)
    assert [r.other.close for r in on.orderBy("t").collect()][:5] == [103.0] * 4 + [107.0]
    gaps = align.security(chart, higher, "60", ["close"], 900, gaps=True)
    assert [r.other.close if r.other else None for r in gaps.orderBy("t").collect()][3:9] == [None, 103.0, None, None, None, 107.0]


def orders(spark, rows):
    return spark.createDataFrame(rows, "symbol string, i long, seq int, kind string, id string, dir int, qty double, limit double, stop double, oca string, comment string")


def test_orders_fill_at_the_next_open_and_close_first_in_first_out(spark):
    o = orders(spark, [("x", 0, 0, "entry", "a", 1, 2.0, None, None, None, ""), ("x", 2, 0, "entry", "b", 1, 1.0, None, None, None, ""), ("x", 4, 0, "close", "c", 0, 2.5, None, None, None, "")])
    account = broker.replay(ramp(spark, 10), o, broker.Config(pyramiding=1)).orderBy("i").collect()
    assert account[1].position == 2 and account[1].avg_price == 101
    assert account[3].position == 3 and math.isclose(account[3].avg_price, (2 * 101 + 103) / 3)
    assert account[5].position == 0.5 and account[5].realized == 2 * 4 + 0.5 * 2
    assert [(t.entry_bar, t.exit_bar, t.profit) for t in account[5].trades] == [(1, 5, 8.0)]


def test_brackets_and_reversal(spark):
    o = orders(spark, [("x", 0, 0, "entry", "a", 1, 1.0, None, None, None, ""), ("x", 1, 0, "exit", "t", 0, None, 105.0, 90.0, "g", ""), ("x", 6, 0, "entry", "s", -1, 1.0, None, None, None, ""), ("x", 8, 0, "entry", "l", 1, 1.0, None, None, None, "")])
    account = broker.replay(ramp(spark, 12), o).orderBy("i").collect()
    assert [(x.price, x.qty, x.dir) for r in account for x in r.executions] == [(101.0, 1.0, 1), (105.0, 1.0, -1), (107.0, 1.0, -1), (109.0, 2.0, 1)]
    assert account[-1].position == 1


def test_limit_price_is_never_worse(spark):
    o = orders(spark, [("x", 0, 0, "entry", "a", 1, 1.0, 150.0, None, None, ""), ("x", 2, 0, "entry", "b", 1, 1.0, None, 90.0, None, "")])
    account = broker.replay(ramp(spark, 8), o, broker.Config(pyramiding=3)).orderBy("i").collect()
    assert [x.price for r in account for x in r.executions] == [101.0, 103.0]


def test_trailing_stop_and_distances(spark):
    o = orders(spark, [("x", 0, 0, "entry", "a", 1, 1.0, None, None, None, ""), ("x", 0, 1, "exit", "t", 0, None, None, None, None, "")]).withColumns({"trail": F.when(F.col("kind") == "exit", 4.0), "offset": F.lit(3.5), "profit": F.lit(None).cast("double"), "loss": F.lit(None).cast("double")})
    account = broker.replay(ramp(spark, 12), o).orderBy("i").collect()
    # entry at 101; the high first is 105 on bar 3, where the low of 102 doesn't reach 101.5; nor later on the ramp
    assert [(x.price, x.dir) for r in account for x in r.executions] == [(101.0, 1)]
    tight = broker.replay(ramp(spark, 12), o.withColumn("offset", F.lit(2.5))).orderBy("i").collect()
    assert [(r.i, x.price, x.dir) for r in tight for x in r.executions] == [(1, 101.0, 1), (3, 102.5, -1)]
    loss = broker.replay(ramp(spark, 12), o.withColumns({"trail": F.lit(None).cast("double"), "profit": F.when(F.col("kind") == "exit", 6.0)})).orderBy("i").collect()
    assert [(r.i, x.price) for r in loss for x in r.executions] == [(1, 101.0), (5, 107.0)]


def test_risk_rules(spark):
    o = orders(spark, [("x", 2 * k, 0, "entry", f"e{k}", -1, 1.0, None, None, None, "") for k in range(8)])
    free = broker.replay(ramp(spark, 20), o, broker.Config(pyramiding=9)).orderBy("i").collect()
    assert free[-1].position == -8
    capped = broker.replay(ramp(spark, 20), o, broker.Config(pyramiding=9, max_position=3)).orderBy("i").collect()
    assert capped[-1].position == -3
    halted = broker.replay(ramp(spark, 20), o, broker.Config(pyramiding=9, max_drawdown=5)).orderBy("i").collect()
    assert halted[-1].position == 0 and [x.id for r in halted for x in r.executions][-1] == "risk"
    today = broker.replay(ramp(spark, 20), o, broker.Config(pyramiding=9, max_day_fills=2)).orderBy("i").collect()
    assert today[-1].position == 0 and sum(len(r.executions) for r in today) == 3
    assert not any(r.executions for r in broker.replay(ramp(spark, 20), o, broker.Config(allow=1)).collect())


def test_stop_rules(spark):
    rows = [("LONG", 90.0, 95.0), ("LONG", 90.0, 85.0), ("SHORT", 90.0, 95.0), ("LONG", 90.0, None), ("LONG", None, 80.0), ("LONG", None, -1.0)]
    got = spark.createDataFrame(rows, "side string, old double, new double").select(guard.stop_change(F.col("side"), F.col("old"), F.col("new"))).collect()
    assert [r[0] for r in got] == [None, "stop_widen", "stop_widen", "stop_removed", None, "stop_invalid"]


def test_loss_streak_counts_trades_not_rows(spark):
    rows = [("a", 1, "x", 10, 20, -1.0), ("a", 1, "x", 10, 21, -1.0), ("a", 1, "y", 5, 15, -2.0), ("a", 1, "z", 1, 2, 3.0), ("a", 1, "z", 0, 1, -3.0)]
    got = guard.loss_streaks(spark.createDataFrame(rows, "account string, day int, symbol string, opened long, closed long, pnl double")).collect()
    assert [r.loss_streak for r in got] == [2]


def test_direction_inherits(spark):
    t = spark.createDataFrame([("x", i, i, p, 1.0) for i, p in enumerate([5.0, 5.0, 6.0, 6.0, 4.0, 4.0])], "symbol string, t long, seq long, price double, volume double")
    assert column(flow.with_direction(t), "dir") == [0, 0, 1, 1, -1, -1]


def test_text(spark):
    df = spark.createDataFrame([("a.b.c",)], "x string")
    x = F.col("x")
    got = df.select(text.split(x, "."), text.replace_first(x, ".", "-"), text.substring(x, F.lit(-2), F.lit(99)), text.pos(x, F.lit("z")), text.match(x, "(")).first()
    assert got[:] == (["a", "b", "c"], "a-b.c", "a.b.c", -1, None)


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"time": 60, "open": 1, "high": 2, "low": 0.5, "close": 1.5}, {"time": 120, "open": 1, "high": 2, "low": 0.5, "close": 1.7, "volume": 3}]')
    got = files.candles(spark, str(tmp_path / "c.json"), "s", limit=1).collect()
    assert [(r.t, r.close, r.volume) for r in got] == [(120, 1.7, 3.0)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"ts": 1, "code": "2330", "price": 5.0}\nbroken\n{"ts": 2, "code": "2330", "price": 6.0}\n')
    log = files.tick_log(spark, str(tmp_path / "log"))
    assert log.count() == 2
    (tmp_path / "z.csv").write_text("date,code,time,price,volume\n20240102,TX,84500,17000,4\n20240102,TX,84559,17010,2\n20240102,TX,84600,17005,2\n")
    b = bars.from_ticks(files.archive_trades(spark, str(tmp_path / "z.csv")), "1").orderBy("t").collect()
    assert [(r.t, r.open, r.close, r.volume) for r in b] == [(1704185100, 17000.0, 17010.0, 3.0), (1704185160, 17005.0, 17005.0, 1.0)]
    k = spark.createDataFrame([("s", [1, 2], [1.0, None], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [None, 1.0])], files.KLINES)
    assert [(r.t, r.volume) for r in files.klines(k).collect()] == [(1, 0.0)]
    assert files.verify_dedup(log, log.dropDuplicates(["ts"]), ["ts"]) == {"appeared": 0, "vanished": 0, "double": 0}


def test_reversals_equal_a_plain_walk(spark):
    """Net flow, the opposite print and the alerts, against one pass over each symbol's ticks in Python."""
    rnd = random.Random(4)
    rows = [(s, 40 * k + rnd.randrange(30), k, float(rnd.choice([5, 20, 70, 130])), (rnd.random() < 0.5 + 0.4 * math.sin(k / 15)) * 2 - 1) for s in "ab" for k in range(400)]
    ticks = spark.createDataFrame(rows, "symbol string, t long, seq long, amount double, dir int")
    got = {(r.symbol, r.seq): int(r.alert) for r in flow.reversals(flow.net_flow(ticks, 20.0, 3600), 100.0, 70.0, 60).collect()}
    want = {}
    for s in "ab":
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))
        net = {r[2]: sum(x[3] * x[4] for x in own if r[1] - 3600 <= x[1] <= r[1] and x[3] >= 20) for r in own}
        since, alerted = {1: 0, -1: 0}, None
        for n, (_, t, seq, _, _) in enumerate(own):
            if alerted is not None and t - alerted < 300:
                continue
            seen = {k: [net[r[2]] for r in own[: n + 1] if r[1] >= max(t - 1800, at)] for k, at in since.items()}
            near = [r for r in own if t - 60 <= r[1] <= t and r[3] >= 70]
            peak, trough, now = max(seen[1]), min(seen[-1]), net[seq]
            alert = 0
            if peak >= 200 and peak - now >= max(100, 0.3 * peak) and any(r[4] < 0 for r in near):
                alert = 1
            elif trough <= -200 and now - trough >= max(100, -0.3 * trough) and any(r[4] > 0 for r in near):
                alert = -1
            if alert:
                want[s, seq], alerted, since[alert] = alert, t, t
    assert got == want and {1, -1} <= set(want.values())


def test_an_alert_of_one_side_keeps_the_extreme_of_the_other():
    kernel = folds.Reversal(100.0)
    steps = [(0, -300.0, 0, 0), (100, 250.0, 0, 1), (110, 100.0, 0, 1), (500, 60.0, 1, 0), (510, -300.0, 1, 1)]
    assert [kernel.step(*s)[0] for s in steps] == [0.0, 0.0, 1.0, -1.0, 0.0]


def test_zigzag_confirms_a_retracement_that_came_before_its_depth():
    kernel = folds.ZigZag(5.0, 10)
    bars = [(100.0, 99.0), (101.0, 100.0), (110.0, 108.0), (106.0, 103.0)] + [(109.5, 108.5)] * 12
    out = [kernel.step(*b) for b in bars]
    assert out[2] == (99.0, -1.0) and out[11] == (99.0, -1.0) and out[12] == (110.0, 1.0)
    assert kernel.low == (103.0, 3)  # the leg begins at the low that was tracked
    kernel = folds.ZigZag(5.0, 2)
    for b in [(100.0, 99.0), (110.0, 109.0), (110.0, 100.0), (109.0, 101.0)]:
        last = kernel.step(*b)
    assert last == (110.0, 1.0)  # an equal high doesn't move the extreme


def test_sane_ticks_are_measured_against_the_last_good_one(spark):
    rows = [("x", i, i, p) for i, p in enumerate([100.0, 500.0, 101.0, 102.0, 0.0, -1.0, None, 103.0])] + [("y", 0, 0, 500.0)]
    ticks = spark.createDataFrame(rows, "symbol string, t long, seq long, price double")
    for block in (2, 4096):
        assert sorted((r.symbol, r.seq) for r in flow.sane(ticks, 0.05, block).collect()) == [("x", 0), ("x", 2), ("x", 3), ("x", 7), ("y", 0)]


def test_last_accepted_in_blocks_equals_a_walk():
    """Every block's summary and rows, from any state, for walks, jumps and ties."""
    rnd = np.random.default_rng(2)
    for share in (0.02, 0.3, 0.5, 2.0):
        for x in (np.exp(rnd.normal(size=300)), 100 + rnd.normal(size=300).cumsum(), rnd.choice([5.0, 10.0, 20.0], size=300), np.exp(rnd.normal(size=300).cumsum())):
            rule, state, want = accepted.within(share), math.nan, []
            for v in x:
                ok = math.isnan(state) or abs(v - state) / state <= share
                want.append(ok)
                state = v if ok else state
            state, got = math.nan, []
            for i in range(0, 300, 40):
                got += accepted.kept(x[i : i + 40], rule, state).tolist()
                state = accepted.after(state, **accepted.table(x[i : i + 40], rule))
            assert got == want
    t = np.sort(rnd.integers(0, 2000, size=300)).astype(float)
    state, got, want, last = math.nan, [], [], -math.inf
    for v in t:
        want.append(v - last >= 30)
        last = v if want[-1] else last
    for i in range(0, 300, 25):
        found = accepted.table(t[i : i + 25], accepted.apart(30))
        assert len(found["out"]) <= 25
        got += accepted.kept(t[i : i + 25], accepted.apart(30), state).tolist()
        state = accepted.after(state, **found)
    assert got == want


def test_lines_cross_at_their_price_and_rest_after_it(spark):
    lines = spark.createDataFrame([("a", "x", 10.0, None, None, None), ("b", "x", 0.0, 0, 10.0, 100), ("c", "x", 1.0, 5, 2.0, 5)], "line string, symbol string, level double, time long, level2 double, time2 long")
    quotes = spark.createDataFrame([("x", t, t, b, m) for t, b, m in [(10, 9.0, 10.0), (20, 10.0, 9.0), (50, 9.0, 10.0), (60, 5.0, 7.0)]], "symbol string, t long, seq long, before double, mid double")
    got = sorted((r.line, r.t, r.crossed) for r in flow.crossings(quotes, lines, 30).collect())
    assert got == [("a", 10, 1), ("a", 50, 1), ("b", 60, 1)]


def test_zip_archives_are_read_where_they_lie(spark, tmp_path):
    """Two archives, two members, odd lines, another product and another month."""
    import zipfile

    heading = "成交日期,商品代號,到期月份,成交時間,成交價格,成交數量"
    for n, members in enumerate([{"a.csv": ["20240102,MTX    ,202401  ,84500,17000,4", "20240102,MTX,202401,084559,17010,2", "20240102,MTX,202402,84500,1,2", "short,line", "20240102,TX,202401,84500,1,2"]}, {"b.csv": ["20240102,MTX,202401,084559,16990,6", "20240102,MTX,202401,84600,x,2"], "c.csv": ["20240103,MTX,202401,10,17100,2"]}]):
        with zipfile.ZipFile(tmp_path / f"Daily_{n}.zip", "w") as z:
            for name, lines in members.items():
                z.writestr(name, "\r\n".join([heading, *lines]).encode("cp950"))
    (tmp_path / "notes.txt").write_text("no archive")
    contracts = spark.createDataFrame([("MXFA4",)], "symbol string")
    got = files.archive_bars(files.archives(spark, str(tmp_path)), contracts).orderBy("t").collect()
    assert [tuple(r) for r in got] == [("MXFA4", 1704156300, 17000.0, 17010.0, 16990.0, 16990.0, 6.0), ("MXFA4", 1704211200, 17100.0, 17100.0, 17100.0, 17100.0, 1.0)]
    assert files.zipped_lines(files.archives(spark, str(tmp_path))).where("place = 0 and line = '" + heading + "'").count() == 3


def test_a_session_gates_by_what_its_trades_made():
    """Loss streak, half lots, stop, protection of profit and the cap of each part."""
    from tidebar.operators.risk import RULES, Session

    def walk(rows, **kw):
        s = Session(**kw)
        return [(RULES[int(r[0])][0], r[1], r[2]) for r in (s.step(*x) for x in rows)]

    sure = lambda close, way, part=0: (close, way, 0.9, 0, part)
    got = walk([sure(100.0, 1.0), sure(90.0, 1.0), sure(80.0, 1.0), sure(70.0, 1.0), sure(60.0, 1.0)])
    assert got == [("full", 1.0, None), ("full", 1.0, -10.0), ("reduce", 0.5, -10.0), ("consec_loss_stop", 0.0, -10.0), ("consec_loss_stop", 0.0, None)]
    got = walk([sure(100.0, 1.0), sure(150.0, None), (150.0, -1.0, 0.9, 1, 0), sure(150.0, 0.0)], protect=50.0)
    assert got == [("full", 1.0, None), ("full", 1.0, 50.0), ("profit_protect", 0.0, None), ("flat", 0.0, None)]
    got = walk([(1.0, 1.0, 0.7, 0, 0), (1.0, 1.0, None, 1, 0), sure(1.0, -1.0, 0), sure(1.0, -1.0, 1)], cap=2)
    assert got == [("reduce", 0.5, None), ("volatile", 0.5, 0.0), ("max_follow_day", 0.0, 0.0), ("full", 1.0, None)]


def moving_ticks(spark, n=1500, seconds=9000):
    """Ticks of three symbols, one of them NULL: many in a second, some far apart, some without a time or an amount; and their rows in order."""
    rnd, rows = random.Random(11), []
    for k in range(n):
        t = rnd.choice([rnd.randrange(-200, 200), rnd.randrange(seconds), 10 * rnd.randrange(seconds), None if k % 97 == 0 else 50])
        rows.append((rnd.choice(["a", "b", None]), t, k, float(rnd.choice([5, 5, 20, 70, 130])), None if k % 41 == 0 else float(rnd.choice([5, 20, 70, 130]))))
    rows.sort(key=lambda r: (r[0] or "", -(1 << 40) if r[1] is None else r[1], r[2]))
    return spark.createDataFrame(rows, "symbol string, t long, seq long, price double, amount double").repartition(7), rows


def test_direction_goes_on_over_spans(spark):
    ticks, rows = moving_ticks(spark)
    got = {r.seq: r.dir for r in flow.with_direction(ticks, width=100).collect()}
    want = {}
    for s in ("a", "b", None):
        way, last = 0, None
        for r in rows:
            if r[0] == s:
                way = way if last is None or r[3] == last else 1 if r[3] > last else -1
                want[r[2]], last = way, r[3]
    assert got == want


def test_recent_equals_a_walk(spark):
    ticks, rows = moving_ticks(spark, 800)
    got = {r.seq: (r.n, r.total, r.low, r.high) for r in spans.recent(ticks, {"n": (F.count, F.col("amount")), "total": (F.sum, F.col("amount")), "low": (F.min, F.col("amount")), "high": (F.max, F.col("amount"))}, 60).collect()}
    for s, t, seq, _, _ in rows:
        near = [r[4] for r in rows if r[0] == s and r[4] is not None and (r[1] is None if t is None else r[1] is not None and t - 60 <= r[1] <= t)]
        assert got[seq] == (len(near), sum(near) if near else None, min(near, default=None), max(near, default=None))
    assert len(got) == len(rows)


def frames_of(df):
    """Window frames of a plan that slide by a range, which Spark works out anew for each row."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "RangeFrame, -" in x]


def test_reversals_have_no_frame_that_is_read_again_for_each_tick(spark):
    ticks = flow.with_direction(moving_ticks(spark, 10)[0])
    assert not frames_of(flow.reversals(flow.net_flow(ticks, 20.0, 3600), 100.0, 70.0, 60))


def test_tiered_prints_equal_a_walk(spark):
    """Tiers by the first price, and clusters over ticks of one second in their order."""
    rnd = random.Random(3)
    rows = [(s, rnd.randrange(40) if k % 3 else 7 * rnd.randrange(400), k, float(rnd.choice([5, 20, 70])), float(rnd.choice([5, 20, 70, 130])), rnd.choice([-1, 0, 1, 1, 1])) for s in ("a", None) for k in range(300)]
    rows.sort(key=lambda r: (r[0] or "", r[1], r[2]))
    ticks = spark.createDataFrame(rows, "symbol string, t long, seq long, price double, amount double, dir int").repartition(5)
    out = flow.tiered_prints(ticks, [(50.0, 100.0, 0.0, 60.0, 0.0), (0.0, 120.0, 60.0, 20.0, 0.0)], 3, 10)
    assert not frames_of(out)
    got = {(r.symbol, r.seq): (r.is_l1, r.is_l1_lite, r.is_l2, r.l2_cluster) for r in out.collect()}
    for s in ("a", None):
        own = [r for r in rows if r[0] == s]
        l1, lite, l2 = (100, 0, 60) if own[0][3] >= 50 else (120, 60, 20)
        at = [1_000_000 * r[1] + sum(x[1] == r[1] for x in own[: n + 1]) for n, r in enumerate(own)]
        for n, r in enumerate(own):
            ways = [x[5] for x, p in zip(own, at, strict=True) if x[4] >= l2 and at[n] - 10_999_999 <= p <= at[n]]
            assert got[s, r[2]] == (r[4] >= l1, 0 < lite <= r[4] < l1, r[4] >= l2, r[4] >= l2 and len(ways) >= 3 and (min(ways) >= 0 or max(ways) <= 0))
    assert len(got) == len(rows) and any(v[3] for v in got.values())


def test_large_prints_equal_a_walk(spark):
    """Streaks that go on over spans of time, and clusters of one direction."""
    ticks, rows = moving_ticks(spark, 900)
    ticks = flow.with_direction(ticks.withColumn("amount", F.when(F.col("seq") % 5 > 0, 70.0).otherwise(F.col("amount"))))
    rows = [(*r[:4], 70.0 if r[2] % 5 else r[4]) for r in rows]
    way = {r.seq: r.dir for r in ticks.collect()}
    out = flow.large_prints(ticks, 100.0, 60.0, 3, 60, width=30)
    assert not frames_of(out)
    got = {r.seq: (r.streak, r.print) for r in out.collect()}
    for s in ("a", "b", None):
        streak, own = 0, [r for r in rows if r[0] == s]
        for _, t, seq, _, amount in own:
            big = amount is not None and amount >= 60
            streak = streak + 1 if big else 0
            near = [way[r[2]] for r in own if r[4] is not None and r[4] >= 60 and (r[1] is None if t is None else r[1] is not None and t - 60 <= r[1] <= t)]
            assert got[seq] == (streak, "L1" if amount is not None and amount >= 100 else "L2" if big and len(near) >= 3 and set(near) in ({1}, {-1}) else None)
    assert len(got) == len(rows) and {p for _, p in got.values()} == {"L1", "L2", None} and max(n for n, _ in got.values()) > 10


@pytest.mark.parametrize("forward", [False, True])
def test_asof_dealt_by_time_equals_a_walk(spark, forward):
    """Spans without rows of one side, NULL groups and NULL values; a struct's NULL is found."""
    rnd = random.Random(8)
    left = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(-300, 300), rnd.randrange(30_000)]), k) for k in range(400)]
    right = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(-300, 0), 9_000 + rnd.randrange(9_000)]), rnd.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)]
    right = list({(s, t): (s, t, v) for s, t, v in right}.values())
    ours, theirs = spark.createDataFrame(left, "symbol string, t long, n long").repartition(5), spark.createDataFrame(right, "symbol string, t long, v double").repartition(5)
    for value, nulls in ((F.struct("v"), True), (F.col("v"), False)):
        out = align.asof(ours, theirs, F.col("t"), F.col("t"), value, "x", ["symbol"], forward, (F.col("t"), F.col("t")), 100)
        got = {r.n: r.x for r in out.collect()}
        assert len(got) == len(left)
        for s, t, n in left:
            near = sorted(((u, v) for z, u, v in right if z == s and (u >= t if forward else u <= t) and (nulls or v is not None)), key=lambda r: r[0])
            want = (near[0] if forward else near[-1])[1] if near else None
            assert (got[n].v if nulls and got[n] else got[n]) == want and (not nulls or (got[n] is None) == (not near))


def test_forward_returns_equal_a_walk(spark):
    """Deadlines far beyond the last tick before them, equal events, and windows that are all dealt by time."""
    rnd = random.Random(5)
    ticks = sorted({(s, t): (s, t, float(rnd.choice([0, 5, 20, 70]))) for s in ("a", "b") for t in [rnd.choice([rnd.randrange(9_000), 200_000 + rnd.randrange(90_000)]) for _ in range(150)]}.values())
    events = ticks + ticks[:3]
    out = flow.forward_returns(spark.createDataFrame(events, "symbol string, t long, price double").repartition(3), spark.createDataFrame(ticks, "symbol string, t long, price double").repartition(3), (1, 1440))
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition" in x]
    assert windows and all("_span" in x for x in windows)

    def change(s, t, price, m):
        later = [p for z, u, p in ticks if z == s and u >= t + 60 * m]
        return 100 * (later[0] - price) / price if later and price else None

    want = sorted(((s, t, p, change(s, t, p, 1), change(s, t, p, 1440)) for s, t, p in events), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
