"""Weekdays back, openings of sessions and periods some bars back, statistics of accounts, casts to colours and errors: against plain Python."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F
from tidebar.functions import color, na, times
from tidebar.operators import features


def back(day, n):
    while n:
        day -= dt.timedelta(1)
        n -= day.weekday() < 5
    return day


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 13])
def test_weekdays_before(spark, n):
    days = [dt.date(2024, 2, 20) + dt.timedelta(k) for k in range(21)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select("d", times.weekdays_before(F.col("d"), n).alias("x")).collect()
    assert [r.x for r in got] == [back(r.d, n) for r in got]


def test_openings(spark):
    begin = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    bars = spark.createDataFrame([("x", begin + 1800 * k) for k in range(48 * 40)], "symbol string, t long")
    got = bars.select("t", times.time("D", "0845-1345", bars_back=2).alias("two"), times.time("60", "0845-1345").alias("own"), times.time("M", bars_back=2).alias("month"), times.time("60", bars_back=3).alias("hours")).orderBy("t").collect()
    zone = dt.timezone(dt.timedelta(hours=8))
    months = []
    for r in got:
        at = dt.datetime.fromtimestamp(r.t, zone)
        inside = 525 <= at.hour * 60 + at.minute < 825
        opened = dt.datetime.combine(back(at.date(), 2), dt.time(8, 45), zone).timestamp() * 1000
        assert (r.two, r.own) == ((opened, r.t * 1000) if inside else (None, None))
        assert r.hours == ((r.t - 10_800) * 1000 if r.t % 3600 == 0 else None)
        if r.month is not None:
            months.append((r.t, r.month))
    first = lambda *d: int(dt.datetime(*d, tzinfo=dt.UTC).timestamp() * 1000)
    assert months == [(begin, first(2023, 11, 1)), (int(dt.datetime(2024, 2, 1, tzinfo=zone).timestamp()), first(2023, 11, 1))]


def test_statistics_of_accounts(spark):
    rows = [("a", 1, 1, 10.0), ("a", 2, 2, -4.0), ("a", 2, 3, -8.0), ("a", 3, 4, 0.0), ("a", 4, 5, None), ("b", 1, 1, -3.0), ("c", 1, 1, 5.0), ("c", 1, 2, 5.0), (None, 1, 1, 2.0)]
    got = {r.account: r for r in features.account_statistics(spark.createDataFrame(rows, "account string, closed int, id int, pnl double").repartition(3)).collect()}
    a, p = got["a"], [10.0, -4.0, -8.0, 0.0]
    assert (a.trades, a.win_rate, a.avg_win, a.avg_loss, a.best, a.worst, a.max_drawdown) == (4, 0.25, 10.0, 6.0, 10.0, -8.0, 12.0)
    assert a.profit_factor == pytest.approx(10 / 12) and a.sharpe == pytest.approx(statistics.mean(p) / statistics.stdev(p)) and a.expectancy == pytest.approx(-0.5)
    b, c = got["b"], got["c"]
    assert (b.win_rate, b.avg_win, b.profit_factor, b.sharpe, b.max_drawdown, b.expectancy) == (0.0, None, None, None, 3.0, -3.0)
    assert (c.avg_loss, c.profit_factor, c.sharpe, c.max_drawdown, c.expectancy) == (None, None, None, 0.0, 5.0)
    assert set(got) == {"a", "b", "c", None}
    assert features.account_statistics(spark.createDataFrame([], "account string, closed int, id int, pnl double")).collect() == []


def test_casts_to_colours_and_errors(spark):
    one = spark.range(1)
    assert tuple(one.select(color.cast(F.lit("#FF0000FF")), color.cast(F.lit(5)), color.cast(F.lit(2.5)), color.cast(F.lit(None).cast("string"))).first()) == ("#FF0000FF", "5", "2.5", None)
    assert one.select(na.check(F.col("id") == 0, F.col("id"), "no such id")).first()[0] == 0
    with pytest.raises(Exception, match="no such id"):
        one.select(na.check(F.col("id") > 0, F.col("id"), "no such id")).collect()
    with pytest.raises(Exception, match="no such id"):
        one.select(na.check(F.lit(None).cast("boolean"), F.col("id"), "no such id")).collect()
