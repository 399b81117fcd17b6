"""Calendar and session functions of epoch seconds, in a venue's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.bars import floor_to, next_of, seconds, timeframe

VENUE = "Asia/Taipei"


def local(t: Column, zone: str = VENUE) -> Column:
    """Wall-clock time, as a timestamp without zone."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), t)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def fields(t: Column, zone: str = VENUE) -> dict[str, Column]:
    """year to second, the weekday from Sunday = 1, and the ISO week."""
    x = local(t, zone)
    return {"year": F.year(x), "month": F.month(x), "dayofmonth": F.dayofmonth(x), "hour": F.hour(x), "minute": F.minute(x), "second": F.second(x), "dayofweek": F.dayofweek(x), "weekofyear": F.weekofyear(x)}


def timestamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: str = VENUE) -> Column:
    """Epoch milliseconds of wall-clock fields."""
    wall = F.make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), utc).cast("long") * 1000


def period_key(t: Column, tf: str, zone: str = VENUE) -> Column:
    """What changes when a new period opens: the UTC grid within a day, the venue's calendar from a day on; several days or weeks have none."""
    n, unit = timeframe(tf)
    if unit in ("D", "W") and n > 1:
        return F.lit(0).cast("long")
    if unit in ("D", "W", "M"):
        wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        seconds = F.timestamp_diff("SECOND", wall, local(t, zone)).cast("long")
        return floor_to(seconds, tf)
    return floor_to(t, tf)


def changed(tf: str, by: str = "symbol", zone: str = VENUE) -> Column:
    """True on the first bar of a period, and on a symbol's first bar."""
    key = period_key(F.col("t"), tf, zone)
    return F.coalesce(key != F.lag(key).over(Window.partitionBy(by).orderBy("t")), F.lit(True))


def in_session(t: Column, session: str, zone: str = VENUE) -> Column:
    """Whether the wall clock stands in hhmm-hhmm, which may run over midnight; days may follow as :1234567 (Sunday = 1)."""
    span, _, days = session.partition(":")
    begin, end = (int(x[:2]) * 60 + int(x[2:]) for x in span.split("-"))
    f = fields(t, zone)
    now = f["hour"] * 60 + f["minute"]
    inside = ((now >= begin) & (now < end)) if begin < end else ((now >= begin) | (now < end))
    return inside & f["dayofweek"].isin(*[int(d) for d in days]) if days else inside


def _at_wall(day: Column, minutes: int, zone: str) -> Column:
    """Epoch milliseconds of a minute of a local day."""
    return timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(minutes // 60), F.lit(minutes % 60), F.lit(0), zone)


def weekdays_before(day: Column, n: int) -> Column:
    """The n-th Monday to Friday before a date; for 0 the date itself."""
    if n == 0:
        return day
    w = F.weekday(day)
    friday, left = F.greatest(w - 4, F.lit(0)), n - (w > 4).cast("int")
    over = F.when(left % 5 > w - friday, 2).otherwise(0)
    return F.date_sub(day, (friday + F.floor(left / 5) * 7 + left % 5 + over).cast("int"))


def time(tf: str, session: str | None = None, zone: str = VENUE, bars_back: int = 0) -> Column:
    """Milliseconds of an opening, NULL where there is none.

    With a session (hhmm-hhmm within a day) and inside it: the session's opening
    where the timeframe is of days or more, or else the bar's own; ``bars_back``
    goes back that many openings of the session, Monday to Friday. Without: the
    bar's own opening where it opens a period, less so many periods; those of
    months end on the first of a month.
    """
    t = F.col("t")
    n, unit = timeframe(tf)
    if session:
        begin, end = (int(x[:2]) * 60 + int(x[2:]) for x in session.split("-"))
        day = F.to_date(local(t, zone))
        own = t * 1000 if unit not in ("D", "W", "M") and not bars_back else _at_wall(weekdays_before(day, bars_back), begin, zone)
        return F.when((t * 1000 >= _at_wall(day, begin, zone)) & (t * 1000 < _at_wall(day, end, zone)), own)
    if unit == "M" and bars_back:
        first = F.add_months(F.trunc(F.to_date(local(t, "UTC")), "MM"), -n * bars_back)
        return F.when(changed(tf, zone=zone), F.unix_date(first).cast("long") * 86_400_000)
    step = n * {"D": 1, "W": 7}.get(unit, 0) * 86_400 if unit in ("D", "W") else seconds(tf)
    return F.when(changed(tf, zone=zone), (t - bars_back * step if bars_back else t) * 1000)


def time_close(tf: str) -> Column:
    return next_of(floor_to(F.col("t"), tf), tf) * 1000


def trading_day(t: Column, zone: str = VENUE, turns_at: int = 15) -> Column:
    """The date of the trading day, which begins the evening before at ``turns_at`` o'clock."""
    return F.to_date(local(t + (24 - turns_at) * 3600, zone))


def open_days(days: DataFrame, holidays: DataFrame, column: str = "day") -> DataFrame:
    """Days that are neither a weekend nor in the table of holidays."""
    week = days.where(~F.dayofweek(column).isin(1, 7))
    return week.join(holidays, column, "left_anti")


def session_flags(t: Column, session: str | None, step: int, zone: str = VENUE) -> dict[str, Column]:
    """ismarket, isfirstbar, islastbar, the latter also as regular ones, ispremarket and ispostmarket; a venue without a session is always open."""
    never = {"ispremarket": F.lit(False), "ispostmarket": F.lit(False)}
    if session is None:
        return {"ismarket": F.lit(True), "isfirstbar": F.lit(False), "islastbar": F.lit(False), "isfirstbar_regular": F.lit(False), "islastbar_regular": F.lit(False)} | never
    now = in_session(t, session, zone)
    first, last = now & ~in_session(t - step, session, zone), now & ~in_session(t + step, session, zone)
    return {"ismarket": now, "isfirstbar": first, "islastbar": last, "isfirstbar_regular": first, "islastbar_regular": last} | never


def now_ms() -> Column:
    """The clock, in milliseconds."""
    return F.unix_millis(F.current_timestamp())
