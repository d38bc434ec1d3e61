"""As-of, interval and window joins. Each has an equality key, so it shuffles or broadcasts by key and filters the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of the inner list of a fold.
_FOLD = 256
#: Dates that are sent to every task, with a row per month that they look back on.
BROADCAST_DATES = 20_000


def as_of(left: DataFrame, right: DataFrame, by: list[str], when: str, known: str, take: list[str], strict: bool = False, within_days: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """``left`` and, from the latest row of ``right`` known by ``when``, the columns ``take`` (null without one).

    ``strict`` leaves out rows of the same day; ``within_days`` bounds their age; of rows known on one day the one with
    the largest ``ties`` wins, whole, nulls in it included. Right rows become intervals until the next known day, and
    intervals are dealt to the months that they reach into. So the join's key is the key and the month: a left row meets
    the intervals of one month only, 32 at most, and the rows of a hot key are spread over its months. The last interval
    of a key has no end; it is one row per key and joined by the key.
    """
    order = [known, *(ties or [])]
    last = right.groupBy(*by, known).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_row")) if ties else right.groupBy(*by, known).agg(F.max(F.struct(*take)).alias("_row"))
    spans = last.withColumn("_next", F.lead(known).over(Window.partitionBy(*by).orderBy(known))).withColumnRenamed(known, "_known")
    spans = spans.withColumnsRenamed({k: f"_r_{k}" for k in by})
    until = F.col("_next").cast("date") if within_days is None else F.least(F.col("_next").cast("date"), F.date_add("_known", within_days))
    closed = spans.filter("_next IS NOT NULL").withColumn("_m", F.explode(F.sequence(month_of(F.col("_known")), month_of(until))))
    after = lambda day: F.col(when) > day if strict else F.col(when) >= day
    before = F.col(when) <= F.col("_next") if strict else F.col(when) < F.col("_next")
    near = lambda day: F.lit(True) if within_days is None else F.datediff(F.col(when), day) <= within_days
    same = F.lit(True)
    for k in by:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    inside = same & (month_of(F.col(when)) == F.col("_m")) & after(F.col("_known")) & before & near(F.col("_known"))
    names = [*left.columns, F.col("_row").alias("_inside")]
    held = left.join(closed, inside, "left").select(*names)
    ended = spans.filter("_next IS NULL").select(*(f"_r_{k}" for k in by), F.col("_known").alias("_last"), F.col("_row").alias("_after"))
    out = held.join(ended, same & after(F.col("_last")) & near(F.col("_last")), "left")
    return out.select(*left.columns, *(F.when(F.col("_last").isNotNull(), F.col(f"_after.{c}")).otherwise(F.col(f"_inside.{c}")).alias(c) for c in take))


def month_of(day: Column) -> Column:
    """Months in sequence, as whole numbers."""
    return F.year(day) * 12 + F.month(day)


def members_as_of(days: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(day, ticker) for the snapshot in force on each day; a day before the first snapshot fails.

    ``snapshots``: (snap_date, ticker). Days are few; the calendar of snapshots is broadcast-joined through a month key.
    """
    dates = snapshots.select("snap_date").distinct()
    first = dates.agg(F.min("snap_date")).first()[0]
    early = days.filter(F.col("day") < F.lit(first)).limit(1).count() if first else 1
    if early:
        raise ValueError("a day lies before the first membership snapshot")
    tagged = days.select("day").distinct().withColumn("_d", F.col("day")).withColumn("_s", F.lit(None).cast("date"))
    both = tagged.union(dates.select(F.col("snap_date").alias("day"), F.lit(None).cast("date"), F.col("snap_date")))
    latest = Window.orderBy("day", F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # a row per day or snapshot
    force = both.withColumn("snap_date", F.last("_s", ignorenulls=True).over(latest)).filter("_d IS NOT NULL").select("day", "snap_date")
    return force.join(snapshots, "snap_date").select("day", "ticker").distinct()


def members_in_window(snapshots: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Tickers of every snapshot in force between start and stop, the one in force at the start included."""
    dates = snapshots.select("snap_date").distinct().withColumn("until", F.lead("snap_date").over(Window.orderBy("snap_date")))  # a row per snapshot
    held = dates.filter((F.col("snap_date") <= stop) & (F.col("until").isNull() | (F.col("until") > start)))
    return snapshots.join(held.select("snap_date"), "snap_date", "left_semi").select("ticker").distinct()


def bars_of(calendar: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last bar with the index of the bar on or after it (next_ix) and of the
    bar on or before it (last_ix). An equality join on the day then replaces a range join."""
    ends = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = days.join(calendar.select(F.col("date").alias("day"), "bar_ix"), "day", "left")
    ahead, back = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row per day
    return grid.select("day", F.first("bar_ix", ignorenulls=True).over(ahead).alias("next_ix"), F.last("bar_ix", ignorenulls=True).over(back).alias("last_ix"))


def next_bar(events: DataFrame, calendar: DataFrame, when: str = "when") -> DataFrame:
    """``events`` with event_ix, the first bar on or after the event; events past the last bar are dropped."""
    days = bars_of(calendar).select(F.col("day").alias(when), F.col("next_ix").alias("event_ix"))
    return events.join(days, when)


def window_events(dates: DataFrame, events: DataFrame, window_days: int, on: list[str] | None = None) -> DataFrame:
    """Events with ``as_of - window <= when < as_of`` for every as_of date. Dates are dealt to the months that they look
    back on, so the join has an equality key; up to BROADCAST_DATES dates, which are counted, are broadcast, so that no
    month's events gather in one task."""
    few = F.broadcast if dates.select("as_of").distinct().count() <= BROADCAST_DATES else (lambda df: df)
    spread = dates.select("as_of").distinct().withColumn("_m", F.explode(F.sequence(month_of(F.date_sub("as_of", window_days)), month_of(F.col("as_of")))))
    held = events.withColumn("_m", month_of(F.col("when"))).join(few(spread), "_m")
    return held.filter((F.col("when") < F.col("as_of")) & (F.col("when") >= F.date_sub("as_of", window_days))).drop("_m")


def nearest_prior(events: DataFrame, bars: DataFrame, by: str = "ticker", when: str = "when") -> DataFrame:
    """The bar on or before each event, else the ticker's first bar: columns snap_date and snap_close."""
    got = as_of(events, bars.withColumn("snap_date", F.col("date")).withColumn("snap_close", F.col("close")), [by], when, "date", ["snap_date", "snap_close"])
    first = bars.groupBy(by).agg(F.min_by(F.struct("date", "close"), "date").alias("_f"))
    got = got.join(first, by, "left")
    return got.withColumn("snap_date", F.coalesce("snap_date", "_f.date")).withColumn("snap_close", F.coalesce("snap_close", "_f.close")).drop("_f")


def overlap_collapse(events: DataFrame, span: int, by: str = "ticker", ix: str = "event_ix") -> DataFrame:
    """Per key and event kept: first event, then each that lies ``span`` bars or more after the last one kept. A fold
    over the key's places, of which repeats are counted before; so a key holds a number per bar of the calendar at most.
    A day that occurs twice counts once more as collapsed. Adds n_collapsed."""
    places = events.groupBy(by, F.col(ix).cast("int").alias(ix)).agg(F.count("*").alias("_n"))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(None).cast("int").alias("last"), none.alias("kept"), F.array(none).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["last"].isNull() | (x - acc["last"] >= span)
        full = F.size(acc["kept"]) >= _FOLD  # appending copies, so long lists are set aside in parts
        kept = F.when(full, F.array(x)).otherwise(F.concat(acc["kept"], F.array(x)))
        done = F.when(full, F.concat(acc["done"], F.array(acc["kept"]))).otherwise(acc["done"])
        return F.when(fits, F.struct(x.alias("last"), kept.alias("kept"), done.alias("done"))).otherwise(acc)

    folded = places.groupBy(by).agg(F.array_sort(F.collect_list(ix)).alias("_all"), F.sum("_n").alias("_events"))
    folded = folded.withColumn("_kept", F.aggregate("_all", start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["kept"])))
    return folded.select(by, F.explode("_kept").alias(ix), (F.col("_events") - F.size("_kept")).cast("int").alias("n_collapsed"))
