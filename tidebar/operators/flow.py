"""Tick flow: direction, size bands, rolling statistics, large prints, forward returns.

Ticks are rows of (symbol, t, seq, price, volume, amount); t in seconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .accepted import apart, last_accepted, within
from .align import asof
from .folds import Reversal, fold
from .scans import BLOCK
from .spans import SPAN, dealt, recent, spans_before, with_carried

#: Bands of a print's amount, largest first: name and least amount.
BANDS = [("xl", 400.0), ("large", 200.0), ("mid", 100.0), ("small", 40.0), ("retail", 0.0)]


def in_order():
    """Ticks of a symbol in the order in which they came."""
    return Window.partitionBy("symbol").orderBy("t", "seq")


def with_direction(ticks: DataFrame, side: str | None = None, width: int = SPAN) -> DataFrame:
    """Adds dir: 1 up, -1 down, as before if the price stays; a side column (1 buy, 2 sell) overrules.

    Ticks are dealt by spans of time; a row for each span tells the next ones its last price and direction.
    """
    rows, inside = dealt(ticks, ["symbol"], F.col("t"), width), Window.partitionBy("_key", "_span").orderBy("t", "seq")
    sign = lambda move: F.when(move != 0, move)
    own = sign(F.signum(F.col("price") - F.lag("price").over(inside)))
    if side:
        own = F.when(F.col(side) == 1, 1.0).when(F.col(side) == 2, -1.0).otherwise(own)
    rows = rows.withColumn("_s", own)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_dir", F.last("_s", ignorenulls=True).over(upto))
    marked = rows.withColumns({"_first": F.first("price").over(upto), "_more": F.lead(F.lit(1)).over(inside)})
    ends, spans = marked.where("_more is null"), Window.partitionBy("_key").orderBy("_span")
    ends = ends.withColumn("_turn", sign(F.signum(F.col("_first") - F.lag("price").over(spans))))
    ends = ends.withColumn("_was", F.last(F.coalesce("_dir", "_turn"), ignorenulls=True).over(spans_before()))
    out = with_carried(rows, ends, {"_came": F.coalesce("_turn", "_was")})
    return out.select(*ticks.columns, F.coalesce("_dir", "_came", F.lit(0.0)).cast("int").alias("dir"))


def true_volume(ticks: DataFrame, total: str = "total_volume", auction: str = "volume") -> Column:
    """Volume of a tick from the running total; while the total stands still, the running auction volume's own step."""
    step = F.col(total) - F.lag(total).over(in_order())
    own = F.col(auction) - F.lag(auction).over(in_order())
    return F.when(step.isNull(), F.col(auction)).when(step > 0, step).otherwise(F.greatest(F.coalesce(own, F.lit(0)), F.lit(0)))


def sane(ticks: DataFrame, most: float = 0.05, block: int = BLOCK) -> DataFrame:
    """Ticks whose price is positive and no more than a share away from that of the last tick that was let through."""
    return last_accepted(ticks.where((F.col("price") > 0) & (F.col("price") < float("inf"))), "price", within(most), block=block)


def line_price(t: Column) -> Column:
    """Price of a line (level, or from (time, level) to (time2, level2)) at a time; NULL for a trend line without length."""
    slope = F.try_divide(F.col("level2") - F.col("level"), (F.col("time2") - F.col("time")).cast("double"))
    return F.when(F.col("time").isNull(), F.col("level")).otherwise(F.col("level") + slope * (t - F.col("time")))


def crossings(quotes: DataFrame, lines: DataFrame, cooldown: float = 30, block: int = BLOCK) -> DataFrame:
    """Quotes (symbol, t, seq, before, mid) that cross a line of the table (line, symbol, level, time, level2, time2): crossed is 1 up, -1 down. A line that fired is quiet for the cooldown.

    A level itself counts as above. Lines are few; Spark sends them to all tasks
    while they are small, and joins by symbol otherwise.
    """
    both = quotes.join(lines, "symbol").withColumn("at", line_price(F.col("t")))
    up, down = (F.col("before") < F.col("at")) & (F.col("mid") >= F.col("at")), (F.col("before") >= F.col("at")) & (F.col("mid") < F.col("at"))
    crossed = both.withColumn("crossed", F.when(up, 1).when(down, -1)).where("crossed is not null").withColumn("_fired", F.col("t"))
    return last_accepted(crossed, "_fired", apart(cooldown), "line", block=block).drop("_fired")


def band(amount: Column) -> Column:
    out = F.lit(BANDS[-1][0])
    for name, least in reversed(BANDS):
        out = F.when(amount >= least, F.lit(name)).otherwise(out)
    return out


def band_flow(ticks: DataFrame) -> DataFrame:
    """For each symbol and minute, signed volume by band and its running sum. Ticks need dir."""
    minute = (F.floor(F.col("t") / 60) * 60).cast("long").alias("minute")
    signed = F.col("dir") * F.col("volume")
    by = ticks.select("symbol", minute, band(F.col("amount")).alias("band"), signed.alias("signed")).groupBy("symbol", "minute")
    flow = by.agg(*[F.coalesce(F.sum(F.when(F.col("band") == b, F.col("signed"))), F.lit(0.0)).alias(b) for b, _ in BANDS])
    upto = Window.partitionBy("symbol").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return flow.withColumns({f"cum_{b}": F.sum(b).over(upto) for b, _ in BANDS})


def histogram(ticks: DataFrame, edges: list[float]) -> DataFrame:
    """Ticks per symbol and amount bin: bin k holds amounts from edge k - 1 up to edge k."""
    bin_ = reduce(lambda a, e: a + F.when(F.col("amount") >= e, 1).otherwise(0), edges, F.lit(0))
    return ticks.groupBy("symbol", bin_.alias("bin")).agg(F.count("*").alias("n"))


def rolling_statistics(bars: DataFrame, windows: tuple[int, ...] = (5, 15, 30, 60), unit: int = 60) -> DataFrame:
    """Adds for each window of complete bars before this one: volume, volume of rising and falling bars, and change of price in percent."""
    by = Window.partitionBy("symbol").orderBy("t")
    columns = {}
    for w in windows:
        span = by.rangeBetween(-w * unit, -1)
        rising = F.col("close") > F.col("open")
        falling = F.col("close") < F.col("open")
        columns |= {
            f"volume_{w}": F.coalesce(F.sum("volume").over(span), F.lit(0.0)), f"buy_{w}": F.coalesce(F.sum(F.when(rising, F.col("volume"))).over(span), F.lit(0.0)), f"sell_{w}": F.coalesce(F.sum(F.when(falling, F.col("volume"))).over(span), F.lit(0.0)),
            f"change_{w}": 100 * F.try_divide(F.last("close").over(span) - F.first("open").over(span), F.first("open").over(span)),
        }
    return bars.withColumns(columns)


def with_large(bars: DataFrame, ticks: DataFrame, least: float, unit: int = 60) -> DataFrame:
    """Adds ``large`` to bars: whether a tick of at least that amount lies in them."""
    start = (F.floor(F.col("t") / unit) * unit).cast("long").alias("t")
    marked = ticks.where(F.col("amount") >= least).select("symbol", start).distinct().withColumn("large", F.lit(True))
    return bars.join(marked, ["symbol", "t"], "left").withColumn("large", F.coalesce("large", F.lit(False)))


def rolling_at(ticks: DataFrame, bars: DataFrame, windows: tuple[int, ...] = (5, 15, 30, 60), unit: int = 60, lot: float = 1000.0) -> DataFrame:
    """Adds to ticks for each window of units: volume, bought and sold volume and amount, large bars up and not up, change in percent.

    They are over the complete bars that opened at most the window's length before the tick. A large bar that didn't rise
    counts as sold. The change is from the opening of the newest of these bars to the tick's price, 0 without a bar.
    Bars need large. Ticks and bars go in one order, so each row moves once.
    """
    start = (F.floor(F.col("t") / unit) * unit).cast("long")
    nothing = F.lit(None).cast(bars.schema["open"].dataType)
    ours = ticks.select("symbol", start.alias("_k"), F.struct(*ticks.columns).alias("_tick"), *[nothing.alias(f"_{c}") for c in ("open", "close", "volume")], F.lit(None).cast("boolean").alias("_large"))
    theirs = bars.select("symbol", F.col("t").alias("_k"), F.lit(None).cast(ours.schema["_tick"].dataType).alias("_tick"), *[F.col(c).cast(nothing_type).alias(f"_{c}") for c, nothing_type in ((c, bars.schema["open"].dataType) for c in ("open", "close", "volume"))], F.col("large").alias("_large"))
    both = ours.unionByName(theirs)
    up, down, amount = F.col("_close") > F.col("_open"), F.col("_close") < F.col("_open"), F.col("_volume") * F.col("_close") * lot
    order, inside = Window.partitionBy("symbol").orderBy("_k"), F.col("_tick.t") % unit != 0
    sums = {"volume": F.col("_volume"), "buy": F.when(up, F.col("_volume")), "sell": F.when(down, F.col("_volume")), "buy_amount": F.when(up, amount), "sell_amount": F.when(down, amount), "large_buy": F.when(F.col("_large") & up, 1), "large_sell": F.when(F.col("_large") & (F.col("_close") <= F.col("_open")), 1)}
    columns = {}
    for w in windows:
        # a tick within a unit reaches one bar less far back than one at its start
        short, whole = order.rangeBetween((1 - w) * unit, -1), order.rangeBetween(-w * unit, -1)
        at = lambda f, short=short, whole=whole: F.when(inside, f(short)).otherwise(f(whole))
        columns |= {f"{n}_{w}": F.coalesce(at(lambda span, x=x: F.sum(x).over(span)), F.lit(0)) for n, x in sums.items()}
        opened = at(lambda span: F.last("_open", ignorenulls=True).over(span))
        columns[f"change_{w}"] = F.coalesce(100 * F.try_divide(F.col("_tick.price") - opened, opened), F.lit(0.0))
    return both.withColumns(columns).where("_tick is not null").select("_tick.*", *columns)


def large_prints(ticks: DataFrame, first: float, second: float, cluster: int = 3, span: int = 300, width: int = SPAN) -> DataFrame:
    """Ticks at or over a level: L1, or L2 where at least ``cluster`` second-level prints of one direction stand within ``span`` seconds. Adds the streak of large prints."""
    large = F.col("amount") >= second
    rows = dealt(ticks, ["symbol"], F.col("t"), width)
    upto = Window.partitionBy("_key", "_span").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    # a streak is what was counted since the last tick that wasn't large, which may lie in an earlier span
    rows = rows.withColumn("_counted", F.count(F.when(large, 1)).over(upto))
    rows = rows.withColumn("_broken", F.max(F.when(~F.coalesce(large, F.lit(False)), F.col("_counted"))).over(upto))
    ends = rows.groupBy("_key", "_span").agg(F.max("_counted").alias("_all"), F.max("_broken").alias("_last"))
    before = spans_before()
    total = F.coalesce(F.sum("_all").over(before), F.lit(0))
    ends = ends.withColumn("_total", total).withColumn("_came", F.col("_total") - F.coalesce(F.max(F.col("_total") + F.col("_last")).over(before), F.lit(0)))
    rows = with_carried(rows, ends, {"_came": F.col("_came")})
    rows = rows.select(*ticks.columns, (F.col("_counted") - F.coalesce("_broken", -F.col("_came"))).alias("streak"))
    way = F.when(large, F.col("dir"))
    rows = recent(rows, {"_n": (F.count, F.when(large, 1)), "_low": (F.min, way), "_high": (F.max, way)}, span)
    clustered = large & (F.col("_n") >= cluster) & (F.col("_low") == F.col("_high")) & (F.col("_low") != 0)
    return rows.withColumn("print", F.when(F.col("amount") >= first, "L1").when(clustered, "L2")).drop("_n", "_low", "_high")


def forward_returns(events: DataFrame, ticks: DataFrame, minutes: tuple[int, ...] = (5, 15, 30, 60)) -> DataFrame:
    """Adds ret_m: the change of price up to the first tick at least m minutes later, in percent; NULL if there is none.

    All deadlines of all events stand in one order with the ticks, dealt by spans of
    time; an event's deadlines come together in place.
    """
    # rows are many, so they carry nothing twice
    own = [c for c in events.columns if c != "symbol"]
    ours = events.select("symbol", F.struct(*own).alias("_event"), F.explode(F.array(*[F.lit(m) for m in minutes])).alias("_m"))
    theirs = ticks.select("symbol", F.col("t").cast("long").alias("t"), F.struct(F.col("price").cast("double").alias("price")).alias("_v"))
    at = (F.col("_event.t") + 60 * F.col("_m")).cast("long")
    later = asof(ours, theirs, at, F.col("t"), F.col("_v"), "_later", ["symbol"], forward=True, times=(at, F.col("t")))
    by_event = later.groupBy("symbol", "_event").agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("_m") == m, F.col("_later.price"))).alias(f"_{m}") for m in minutes])
    # equal events come out as many times as they went in
    times = F.explode(F.sequence(F.lit(1), (F.col("_n") / len(minutes)).cast("int")))
    price = F.col("_event.price")
    returns = [(100 * F.try_divide(F.col(f"_{m}") - price, price)).alias(f"ret_{m}") for m in minutes]
    return by_event.withColumn("_time", times).select(*[F.col(f"_event.{c}" if c in own else c) for c in events.columns], *returns)


def net_flow(ticks: DataFrame, least: float, seconds: int = 3600) -> DataFrame:
    """Adds net: the signed amount of large prints of the last hour."""
    signed = F.when(F.col("amount") >= least, F.col("amount") * F.col("dir"))
    return recent(ticks, {"net": (F.sum, signed)}, seconds).withColumn("net", F.coalesce("net", F.lit(0.0)))


def reversals(ticks: DataFrame, least: float, print_level: float, opposite: int = 60, span: int = 1800, quiet: int = 300) -> DataFrame:
    """Alerts over ticks with net, dir and amount: 1 where buying is exhausted, -1 where selling relents.

    An alert needs a print of ``print_level`` against the flow within the last ``opposite`` seconds.
    """
    large = lambda way: F.when((F.col("amount") >= print_level) & (F.col("dir") == way), 1)
    rows = recent(ticks, {"_bought": (F.max, large(1)), "_sold": (F.max, large(-1))}, opposite).fillna(0, ["_bought", "_sold"])
    if quiet > 0:
        # a tick of the same second and net as the one before it finds what that one found, or the quiet after its alert
        inside = Window.partitionBy("symbol", "t").orderBy("seq")
        rows = rows.withColumn("_same", F.lag(F.struct("net")).over(inside).eqNullSafe(F.struct("net"))).where("not _same").drop("_same")
    return fold(rows, [(["alert"], lambda: Reversal(least, span=span, quiet=quiet), ["t", "net", "_bought", "_sold"])], order=("t", "seq")).where("alert != 0").drop("_bought", "_sold")


#: Price tiers, fixed values: (least price, L1, L1-lite, L2, least reversal); an L1-lite of 0 is none.
TIERS = [(1000.0, 100e6, 0.0, 30e6, 90e6), (100.0, 50e6, 0.0, 15e6, 45e6), (0.0, 30e6, 8e6, 10e6, 30e6)]


def tier(price: Column, tiers: list[tuple] = TIERS) -> dict[str, Column]:
    """The levels l1, l1_lite, l2 and l3 that hold for a price."""
    def level(k: int) -> Column:
        out = F.lit(tiers[-1][k])
        for row in reversed(tiers[:-1]):
            out = F.when(price >= row[0], F.lit(row[k])).otherwise(out)
        return out

    return {"l1": level(1), "l1_lite": level(2), "l2": level(3), "l3": level(4)}


def tiered_prints(ticks: DataFrame, tiers: list[tuple] = TIERS, cluster: int = 3, span: int = 300) -> DataFrame:
    """Adds for each tick, by the tier of its symbol's first price: is_l1, is_l1_lite, is_l2, and l2_cluster where at least ``cluster`` L2 ticks stand within ``span`` seconds up to it and none of them is against another."""
    # a row for each symbol: where its ticks begin
    begun = ticks.groupBy(F.col("symbol").alias("_of")).agg(F.min_by(F.struct(F.col("price").alias("at")), F.struct("t", "seq")).alias("_begun"))
    columns, levels, amount = ticks.columns, tier(F.col("_begun.at"), tiers), F.col("amount")
    ticks = ticks.join(F.broadcast(begun), F.col("symbol").eqNullSafe(F.col("_of")), "left")
    ticks = ticks.select(*columns, (amount >= levels["l1"]).alias("is_l1"), ((levels["l1_lite"] > 0) & (amount >= levels["l1_lite"]) & (amount < levels["l1"])).alias("is_l1_lite"), (amount >= levels["l2"]).alias("is_l2"))
    # ticks of one second count in the order in which they came
    at = (F.col("t") * 1_000_000 + F.row_number().over(Window.partitionBy("symbol", "t").orderBy("seq"))).cast("long")
    way = F.when(F.col("is_l2"), F.col("dir"))
    ticks = recent(ticks.withColumn("_at", at), {"_n": (F.count, way), "_low": (F.min, way), "_high": (F.max, way)}, span * 1_000_000 + 999_999, at="_at")
    alike = (F.col("_low") >= 0) | (F.col("_high") <= 0)
    return ticks.withColumn("l2_cluster", F.col("is_l2") & (F.col("_n") >= cluster) & alike).drop("_at", "_n", "_low", "_high")
