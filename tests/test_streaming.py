from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tidebar.operators import folds
from tidebar.streaming import bars as S


def ticks(spark, tmp_path, files):
    schema = "symbol string, ts timestamp, seq long, price double, volume double"
    start = datetime(2024, 1, 1)
    for k, rows in enumerate(files):
        spark.createDataFrame([(s, start + timedelta(seconds=t), n, p, 1.0) for s, t, n, p in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_minute_bars_with_late_ticks(spark, tmp_path):
    stream = ticks(spark, tmp_path, [[("x", 5, 1, 10.0), ("x", 70, 3, 12.0)], [("x", 40, 2, 9.0), ("x", 600, 4, 11.0)], [("x", 1200, 5, 13.0)]])
    got = run(S.minute_bars(stream), "minute_bars", "append", tmp_path).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got][:2] == [(10.0, 10.0, 9.0, 9.0, 2.0), (12.0, 12.0, 12.0, 12.0, 1.0)]


def test_dedup(spark, tmp_path):
    stream = ticks(spark, tmp_path, [[("x", 5, 1, 10.0), ("x", 6, 2, 10.0)], [("x", 5, 1, 10.0), ("x", 7, 3, 10.0)]])
    assert run(S.dedup(stream, ["symbol", "seq"]), "dedup", "append", tmp_path).count() == 3


def test_averages_go_on_between_batches(spark, tmp_path):
    stream = ticks(spark, tmp_path, [[("x", 60 * i, i, float(i % 7)) for i in range(k * 10, k * 10 + 10)] for k in range(3)])
    got = run(S.averages(stream.select("symbol", "ts", F.col("price").alias("close")), 5), "averages", "append", tmp_path).orderBy("ts").collect()
    ema, rma = folds.Ema(5), folds.Rma(5)
    order = [r.close for r in got]
    assert len(got) >= 10
    for r, x in zip(got, order, strict=True):
        for v, w in ((r.ema, ema.step(x)[0]), (r.rma, rma.step(x)[0])):
            assert (v is None) == (w is None) and (v is None or abs(v - w) < 1e-9)


class Fed:
    """Streams whose input is written round by round; each round runs a query of its own on the same checkpoint until all input is read."""

    def __init__(self, spark, at):
        self.spark, self.at = spark, at

    def stream(self, name, schema):
        self.spark.createDataFrame([], schema).write.parquet(str(self.at / name))
        return self.spark.readStream.schema(schema).parquet(str(self.at / name))

    def feed(self, name, schema, rows):
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(self.at / name))

    def run(self, df, mode):
        seen: list = []
        q = df.writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())).outputMode(mode).option("checkpointLocation", str(self.at / "checkpoint")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return seen


PRICES = "symbol string, t long, seq long, price double, volume double"


def test_forming_bars_equal_the_batch_fold_after_every_batch(spark, tmp_path):
    from tidebar.operators import bars as B
    from tidebar.streaming import state as T

    kernels = [(["ema"], lambda: folds.Ema(3), ["close"]), (["zz", "way"], lambda: folds.ZigZag(10.0, 1), ["high", "low"])]
    data = [("x", 25 * i, i, 100.0 + (i * 37) % 31, 1.0) for i in range(24)] + [("y", 200, 1, 5.0, 1.0)]
    files = [[r for r in data if 200 * k <= r[1] < 200 * k + 200] for k in range(3)]
    fed = Fed(spark, tmp_path)
    stream = T.forming_bars(fed.stream("prices", PRICES), kernels, 60)
    newest = {}
    for k in range(3):
        fed.feed("prices", PRICES, files[k])
        newest |= {(r.symbol, r.t): r for r in fed.run(stream, "update")}
        whole = B.from_ticks(spark.createDataFrame([r for f in files[: k + 1] for r in f], PRICES), "1")
        want = {(r.symbol, r.t): r for r in folds.fold(whole, kernels).collect()}
        assert set(newest) == set(want)
        for key, r in want.items():
            assert all(newest[key][c] == r[c] for c in ("open", "high", "low", "close", "volume", "ema", "zz", "way")), (k, key)


def test_pending_deadlines_expire_by_the_watermark(spark, tmp_path):
    from tidebar.streaming import state as T

    at = 1_000_000
    fed = Fed(spark, tmp_path)
    stream = T.forward_returns(fed.stream("prices", PRICES).selectExpr("*", "timestamp_seconds(t) as ts"), (1,), 600)

    def after(*ticks):
        fed.feed("prices", PRICES, [(s, at + t, n, p, 1.0) for n, (s, t, p) in enumerate(ticks)])
        return sorted((r.symbol, r.t - at, r.ret) for r in fed.run(stream, "append"))

    assert after(("x", 0, 10.0), ("x", 70, 11.0)) == [("x", 0, 10.0)]
    assert after(("z", 500, 1.0)) == []
    assert after(("x", 600, 22.0), ("z", 600, 2.0)) == [("x", 70, 100.0), ("z", 500, 100.0)]
    assert after(("w", 9000, 1.0)) == [("x", 600, None), ("z", 600, None)]
    assert after(("x", 9100, 1.0), ("w", 9100, 3.0)) == [("w", 9000, 200.0)]  # x and z are forgotten


def test_longer_bars_ahead_and_behind(spark, tmp_path):
    from tidebar.streaming import state as T

    hours, days = [("x", t) for t in range(0, 100, 10)], [("x", 25, 1.0), ("x", 50, None), ("x", 75, 3.0)]
    chart, longer = "symbol string, t long", "symbol string, at long, v double"
    for name, cuts in (("ahead", [(10, 0), (10, 2), (10, 3)]), ("behind", [(0, 2), (0, 3), (10, 3)]), ("even", [(3, 1), (6, 2), (10, 3)])):
        (tmp_path / name).mkdir()
        fed = Fed(spark, tmp_path / name)
        stream = T.refreshed(fed.stream("hours", chart), fed.stream("days", longer), ["v"])
        newest, a, b = {}, 0, 0
        for n, m in cuts:
            fed.feed("hours", chart, hours[a:n])
            fed.feed("days", longer, days[b:m])
            a, b = n, m
            newest |= {r.t: r.v for r in fed.run(stream, "update")}
        assert newest == {t: None if t < 25 or 50 <= t < 75 else 1.0 if t < 50 else 3.0 for _, t in hours}, name


def test_a_recorder_counts_no_batch_twice(spark, tmp_path):
    """Late ticks open a day again, a batch that is run again changes nothing, and old versions and days go."""
    from tidebar.operators import bars as B
    from tidebar.streaming import recorder as N

    path, day = str(tmp_path / "bars"), 86_400
    schema = "symbol string, t long, seq long, price double, volume double"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    first = [("TMFA", 60, 1, 10.0, 1.0), ("TMFA", 65, 2, 12.0, 1.0), ("TMFA", day + 5, 4, 11.0, 1.0)]
    second = [("TMFA", 62, 3, 9.0, 2.0), ("TMFA", 119, 6, 13.0, None), ("TMFB", 2 * day, 7, 5.0, 1.0)]

    def whole(rows):
        return {tuple(r) for r in B.from_ticks(N.valid(frame(rows)).fillna({"volume": 0.0}), "1").select("symbol", "t", "open", "high", "low", "close", "volume").collect()}

    got = lambda: {tuple(r) for r in N.recorded(spark, path).collect()}
    N.merge(frame(first), 0, path)
    assert got() == whole(first)
    for _ in range(2):
        N.merge(frame(second), 1, path)
        assert got() == whole(first + second)
    N.merge(frame([]), 2, path)
    for k in (3, 4):
        N.merge(frame([("TMFA", 70, 10 + k, 1.0, 1.0)]), k, path)
        N.prune(spark, path)
    later = first + second + [("TMFA", 70, 13, 1.0, 1.0), ("TMFA", 70, 14, 1.0, 1.0)]
    assert got() == whole(later) and len(list((tmp_path / "bars" / "day=0").iterdir())) == 2
    N.prune(spark, path, keep_days=2)
    assert {r[1] // day for r in got()} == {1, 2}


def test_a_recorder_takes_valid_ticks_only(spark):
    from tidebar.streaming import recorder as N

    rows = [("TMFA", 1, 5.0, False), ("TMFA", 1, 0.0, False), ("TMFA", None, 5.0, None), (None, 1, 5.0, None), ("MXFA", 1, 5.0, None), ("TMFB", 1, 5.0, True), ("TMFC", 2, 1.0, None), ("TMFD", 2, None, None)]
    ticks = spark.createDataFrame(rows, "symbol string, t long, price double, simtrade boolean")
    assert {r.symbol for r in N.valid(ticks, ("TMF",)).collect()} == {"TMFA", "TMFC"}
