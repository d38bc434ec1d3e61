"""Event studies: abnormal returns, market models per event, cumulative abnormal returns and their day-by-day means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import overlap_collapse
from tidemark.operators.stats import newey_west
from tidemark.storage import stored

WINDOWS = ((0, 5), (0, 20), (0, 60), (0, 120), (-5, -1))


def returns(grid: DataFrame) -> DataFrame:
    """(ticker, bar_ix, ret, market, abnormal): the market is the equal-weighted mean of all names on the bar."""
    by = Window.partitionBy("ticker").orderBy("bar_ix")
    out = grid.select("ticker", "bar_ix", (F.col("close") / F.lag("close").over(by) - 1).alias("ret"))
    out = out.withColumn("market", F.avg("ret").over(Window.partitionBy("bar_ix")))
    return out.withColumn("abnormal", F.col("ret") - F.col("market"))


def market_models(events: DataFrame, rets: DataFrame, gap: int = 30, length: int = 252, least: int = 120) -> DataFrame:
    """(ticker, event_ix, alpha, beta, n): sample covariance over population variance on the bars from
    ``event - gap - length`` to before ``event - gap``; null for fewer than ``least`` bars or a flat market.

    Sums over the bars are differences of running sums per ticker, so an event meets two rows, whatever the window.
    """
    by = Window.partitionBy("ticker")
    whole = rets.select("ticker", "bar_ix", F.col("ret").isNotNull() & F.col("market").isNotNull(), "ret", "market").toDF("ticker", "bar_ix", "_ok", "_y", "_x")
    held = [(c, F.when(F.col("_ok"), F.col(c) - F.avg(F.when(F.col("_ok"), F.col(c))).over(by)).otherwise(0.0)) for c in ("_y", "_x")]  # centred, as sums are subtracted
    means = {f"_m{c}": F.avg(F.when(F.col("_ok"), F.col(c))).over(by) for c in ("_y", "_x")}
    rows = whole.withColumns(means).withColumns(dict(held))
    run = by.orderBy("bar_ix").rowsBetween(Window.unboundedPreceding, 0)
    parts = {"n": F.col("_ok").cast("long"), "y": F.col("_y"), "x": F.col("_x"), "xy": F.col("_x") * F.col("_y"), "xx": F.col("_x") * F.col("_x")}
    sums = rows.select("ticker", "bar_ix", "_m_y", "_m_x", F.struct(*(F.sum(c).over(run).alias(k) for k, c in parts.items())).alias("s"))
    ends = sums.groupBy("ticker").agg(F.max("bar_ix").alias("_last"), F.max("_m_y").alias("my"), F.max("_m_x").alias("mx"))
    e = events.select("ticker", "event_ix").distinct()
    at = lambda bars: F.least(F.col("event_ix") - bars - 1, F.col("_last"))
    placed = e.join(ends, "ticker", "left").withColumn("_high", at(gap)).withColumn("_low", at(gap + length)).drop("_last")
    side = lambda k: sums.select("ticker", F.col("bar_ix").alias(k), F.col("s").alias(f"{k}_s"))
    both = placed.join(side("_high"), ["ticker", "_high"], "left").join(side("_low"), ["ticker", "_low"], "left")
    d = {k: F.coalesce(F.col(f"_high_s.{k}"), F.lit(0)) - F.coalesce(F.col(f"_low_s.{k}"), F.lit(0)) for k in parts}
    fit = both.select("ticker", "event_ix", "my", "mx", *(c.alias(k) for k, c in d.items()))
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))
    spread, common = F.col("xx") / n - (F.col("x") / n) * (F.col("x") / n), (F.col("xy") - F.col("x") * F.col("y") / n) / F.when(n > 1, n - 1)
    fit = fit.withColumn("beta", F.when((F.col("n") >= least) & (spread > 1e-9 * F.col("xx") / n) & (spread > 1e-18), common / spread))
    alpha = (F.col("my") + F.col("y") / n) - F.col("beta") * (F.col("mx") + F.col("x") / n)
    return fit.select("ticker", "event_ix", alpha.alias("alpha"), "beta", F.col("n").cast("long").alias("n"))


def window_sums(kept: DataFrame, rets: DataFrame, first: int, last: int, models: DataFrame | None = None) -> DataFrame:
    """Per kept event: car, null where a bar of the window is missing; with ``models`` against alpha + beta market, or
    the plain market for events without a model."""
    e = kept.select("ticker", "event_ix")
    if models is not None:
        e = e.join(models.select("ticker", "event_ix", "alpha", "beta"), ["ticker", "event_ix"], "left")
    bars = e.withColumn("bar_ix", F.explode(F.sequence(F.col("event_ix") + first, F.col("event_ix") + last)))
    held = bars.join(rets, ["ticker", "bar_ix"], "left")
    value = F.col("abnormal") if models is None else F.coalesce(F.col("ret") - F.col("alpha") - F.col("beta") * F.col("market"), F.col("abnormal"))
    out = held.groupBy("ticker", "event_ix").agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    return out.select("ticker", "event_ix", F.when(F.col("_n") == last - first + 1, F.col("_s")).alias("car"))


def purchases(events: DataFrame, from_year: int) -> DataFrame:
    """Events that a study takes: of positive weight, from the first day of a year on. ``events``: when, signed_weight."""
    return events.filter((F.col("signed_weight") > 0) & (F.col("when") >= F.make_date(F.lit(from_year), F.lit(1), F.lit(1))))


def report(events: DataFrame, rets: DataFrame, windows: tuple[tuple[int, int], ...] = WINDOWS, gap: int = 30, length: int = 252, least: int = 120) -> DataFrame:
    """Per window: n, mean CAR against the market and the market model, t, hit rate, collapsed, skipped, no_beta, and the
    number of all events. ``events``: ticker, event_ix. CARs are ordered by event place and ticker."""
    events, rets = stored(events.select("ticker", "event_ix"), "events"), stored(rets, "returns")  # each window reads them again
    models = stored(market_models(events, rets, gap, length, least), "models")
    counts = models.filter("beta IS NULL").agg(F.count("*").alias("no_beta"), F.lit(events.count()).cast("long").alias("n_events_total"))
    out = None
    for first, last in windows:
        label = f"{first}..{last}"
        kept = stored(overlap_collapse(events, last - first + 1), "kept")
        cars = window_sums(kept, rets, first, last).join(window_sums(kept, rets, first, last, models).withColumnRenamed("car", "car_mm"), ["ticker", "event_ix"])
        cars = stored(cars.withColumn("series", F.lit(label)), "cars")
        t = newey_west(cars, "car", order=("event_ix", "ticker")).select("series", "t")
        collapsed = kept.groupBy("ticker").agg(F.max("n_collapsed").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_collapsed"))
        one = cars.groupBy("series").agg(F.count("car").alias("n"), F.avg("car").alias("mean_car"), F.avg("car_mm").alias("mean_car_mm"), F.avg((F.col("car") > 0).cast("double")).alias("hit_rate"), F.sum(F.col("car").isNull().cast("long")).alias("n_skipped"))
        one = one.join(t, "series", "left").join(collapsed.withColumn("series", F.lit(label)), "series").join(counts.withColumn("series", F.lit(label)), "series")
        out = one if out is None else out.union(one)
    return out.withColumnRenamed("series", "window")


def daily_path(events: DataFrame, rets: DataFrame, last: int) -> DataFrame:
    """Per day 0..last: mean cumulative abnormal return and its standard error, over events with the whole window."""
    end = rets.agg(F.max("bar_ix").alias("end"))
    held = events.join(F.broadcast(end), F.col("event_ix") + last <= F.col("end"))
    kept = overlap_collapse(held, last + 1).select("ticker", "event_ix")
    bars = kept.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("bar_ix", F.col("event_ix") + F.col("day"))
    path = bars.join(rets.select("ticker", "bar_ix", "abnormal"), ["ticker", "bar_ix"], "left")
    by = Window.partitionBy("ticker", "event_ix")
    path = path.withColumn("_n", F.count("abnormal").over(by)).filter(F.col("_n") == last + 1)
    path = path.withColumn("car", F.sum("abnormal").over(by.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    return path.groupBy("day").agg(F.count("*").alias("n"), F.avg("car").alias("mean_car"), (F.stddev_pop("car") / F.sqrt(F.count("*").cast("double"))).alias("se"))


def price_reaction(events: DataFrame, bars: DataFrame, proxy: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Per event: return over each horizon minus the market proxy's. ``bars``: ticker, bar_ix, close; ``proxy``: bar_ix, close."""
    by, whole = Window.partitionBy("ticker").orderBy("bar_ix"), Window.orderBy("bar_ix")  # the proxy is one series
    ahead = bars.withColumns({f"r{h}": F.lead("close", h).over(by) / F.col("close") - 1 for h in horizons})
    market = proxy.withColumns({f"m{h}": F.lead("close", h).over(whole) / F.col("close") - 1 for h in horizons}).drop("close")
    out = events.withColumn("bar_ix", F.col("event_ix")).join(ahead, ["ticker", "bar_ix"]).join(market, "bar_ix")
    return out.select("ticker", "event_ix", *((F.col(f"r{h}") - F.col(f"m{h}")).alias(f"abn_{h}") for h in horizons))
