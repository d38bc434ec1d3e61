"""The price panel in long form: a global calendar, a dense grid, window features and rebalance dates.

A gap is a null, never a NaN. Features that must have no gap count their frame's values. Every window is partitioned by
ticker and shares one order, so a panel is sorted once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of the inner list of a fold.
_FOLD = 256


@dataclass(frozen=True)
class Lookbacks:
    """Bars that the features look back; the defaults are a daily panel's."""

    skip: int = 21
    momentum: int = 252
    trend: int = 200
    volatility: int = 251
    volume: int = 60
    warm_up: int = 252
    per_year: float = 252.0


MONTHLY = Lookbacks(skip=1, momentum=12, trend=10, volatility=11, volume=6, warm_up=12, per_year=12.0)


def no_nan(df: DataFrame) -> DataFrame:
    """Floating NaNs become nulls."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def read_panel(prices: DataFrame, start: Column, stop: Column, tickers: DataFrame | None = None) -> DataFrame:
    """Six columns of the bars in a range, for the given tickers."""
    rows = prices.select("ticker", "date", "close", "high", "low", "volume").filter(F.col("date").between(start, stop))
    return no_nan(rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi") if tickers is not None else rows)


def calendar(prices: DataFrame) -> DataFrame:
    """(date, bar_ix) of the days on which any ticker has a close; a row per day."""
    days = prices.filter("close IS NOT NULL").select("date").distinct()
    return days.withColumn("bar_ix", F.row_number().over(Window.orderBy("date")) - 1)


def dense_grid(prices: DataFrame, cal: DataFrame) -> DataFrame:
    """Every bar of the calendar from a ticker's first to its last bar; gaps have null values.

    A row is repeated up to the ticker's next one, so the grid is dealt by ticker like the windows that follow, and no
    task's share is settled by the few rows that a ticker's ends are."""
    rows = prices.join(F.broadcast(cal), "date").drop("date")  # a row per day
    rest = [c for c in rows.columns if c not in ("ticker", "bar_ix")]
    after = F.lead("bar_ix").over(Window.partitionBy("ticker").orderBy("bar_ix"))
    until = F.greatest(F.col("bar_ix"), F.coalesce(after - 1, F.col("bar_ix")))
    cells = rows.withColumn("_until", until).withColumn("_cell", F.explode(F.sequence("bar_ix", "_until")))
    own = F.col("_cell") == F.col("bar_ix")
    cells = cells.select("ticker", F.col("_cell").alias("bar_ix"), *(F.when(own, F.col(c)).alias(c) for c in rest))
    return cells.join(F.broadcast(cal), "bar_ix").select("bar_ix", "ticker", *rest, "date")


def features(grid: DataFrame, look: Lookbacks = Lookbacks()) -> DataFrame:
    """Columns mom, trend, vol, dollar_volume on every bar of the grid."""
    by = Window.partitionBy("ticker").orderBy("bar_ix")
    back = lambda n: by.rowsBetween(-(n - 1), 0)
    full = lambda c, n: F.count(c).over(back(n)) == n
    close = F.col("close")
    out = grid.withColumn("log_ret", F.log(close / F.lag("close").over(by)))
    mom = F.log(F.lag("close", look.skip).over(by) / F.lag("close", look.momentum).over(by))
    trend = F.when(full("close", look.trend), close / F.avg("close").over(back(look.trend)) - 1)
    deviation = F.stddev_pop("log_ret").over(back(look.volatility))
    vol = F.when(full("log_ret", look.volatility) & (deviation != 0), deviation * F.sqrt(F.lit(look.per_year)))
    turnover = F.percentile(close * F.col("volume"), F.lit(0.5)).over(back(look.volume))
    return out.withColumn("mom", mom).withColumn("trend", trend).withColumn("vol", vol).withColumn("dollar_volume", turnover)


def rebalance_bars(cal: DataFrame, look: Lookbacks = Lookbacks()) -> DataFrame:
    """(as_of, bar_ix, month_ix): the last bar of each month, past the warm-up and strictly before the last bar."""
    ends = cal.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("bar_ix").alias("bar_ix"), F.max("date").alias("as_of"))
    last = cal.agg(F.max("bar_ix").alias("last"))
    held = ends.join(F.broadcast(last), F.col("bar_ix") < F.col("last")).filter(F.col("bar_ix") >= look.warm_up)
    return held.select("as_of", "bar_ix", (F.row_number().over(Window.orderBy("as_of")) - 1).alias("month_ix"))  # a row per month


def forward_returns(at_rebalance: DataFrame) -> DataFrame:
    """``at_rebalance`` (ticker, month_ix, close) and fwd: the return to the next rebalance, null across a missing month."""
    by = Window.partitionBy("ticker").orderBy("month_ix")
    follows = F.lead("month_ix").over(by) == F.col("month_ix") + 1
    return at_rebalance.withColumn("fwd", F.when(follows & (F.col("close") > 0), F.lead("close").over(by) / F.col("close") - 1))


def moving_average(bars: DataFrame, n: int, by: str = "ticker") -> DataFrame:
    over = Window.partitionBy(by).orderBy("date").rowsBetween(-(n - 1), 0)
    return bars.withColumn("sma", F.when(F.count("close").over(over) == n, F.avg("close").over(over)))


def wilder_rsi(bars: DataFrame, n: int = 14, by: str = "ticker") -> DataFrame:
    """(ticker, date, rsi) per bar: a simple mean of the first n moves, then recursive smoothing. A fold over each
    ticker's sorted bars, of which there are as many as the calendar has; results are set aside in parts, as appending
    copies a list."""
    bar = F.array_sort(F.collect_list(F.struct("date", "close")))
    none = F.array().cast("array<struct<date:date,rsi:double>>")
    zero = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"), none.alias("out"), F.array(none).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        move = F.coalesce(x["close"] - acc["last"], F.lit(0.0))
        up, down = F.greatest(move, F.lit(0.0)), F.greatest(-move, F.lit(0.0))
        k = F.when(acc["last"].isNull(), acc["n"]).otherwise(acc["n"] + 1)
        smooth = lambda old, new: F.when(k <= n, old + new / n).otherwise((old * (n - 1) + new) / n)
        gain, loss = smooth(acc["gain"], up), smooth(acc["loss"], down)
        rsi = F.when(k >= n, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)))
        row, full = F.array(F.struct(x["date"].alias("date"), rsi.alias("rsi"))), F.size(acc["out"]) >= _FOLD
        out, done = F.when(full, row).otherwise(F.concat(acc["out"], row)), F.when(full, F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"])
        return F.struct(gain.alias("gain"), loss.alias("loss"), x["close"].alias("last"), k.alias("n"), out.alias("out"), done.alias("done"))

    folded = bars.filter("close IS NOT NULL").groupBy(by).agg(bar.alias("bars"))
    folded = folded.select(by, F.explode(F.aggregate("bars", zero, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["out"]))).alias("x"))
    return folded.select(by, "x.date", "x.rsi")


def bar_state(bars: DataFrame, k: int, fast: int, slow: int, by: str = "ticker") -> DataFrame:
    """k-bar return in percent, trailing mean volume and the trend state of two averages."""
    w = Window.partitionBy(by).orderBy("date")
    mean = lambda c, n: F.when(F.count(c).over(w.rowsBetween(-(n - 1), 0)) == n, F.avg(c).over(w.rowsBetween(-(n - 1), 0)))
    out = bars.withColumn("ret_pct", (F.col("close") / F.lag("close", k).over(w) - 1) * 100).withColumn("avg_volume", mean("volume", k)).withColumn("_f", mean("close", fast)).withColumn("_s", mean("close", slow))
    above, rising = F.col("close") >= F.col("_f"), F.col("_f") >= F.col("_s")
    state = F.when(F.col("_s").isNull(), None).when(above & rising, "UPTREND").when(~above & ~rising, "DOWNTREND").when(rising, "PULLING BACK").otherwise("RECOVERING")
    return out.withColumn("state", state).drop("_f", "_s")


def swing_metrics(bars: DataFrame, length: int, least: int = 10, by: str = "ticker") -> DataFrame:
    """Range, consistency, oscillation, drift, direction changes and score over each ticker's last ``length`` bars."""
    w = Window.partitionBy(by).orderBy("date")
    held = bars.filter("close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("date")))).filter(F.col("_n") <= length)
    held = held.withColumn("_d", F.col("close") - F.lag("close").over(w)).withColumn("_rng", (F.col("high") - F.col("low")) / F.col("close"))
    held = held.withColumn("_flip", F.when(F.signum("_d") != F.lag(F.signum("_d")).over(w), 1).otherwise(0))
    net, path = F.max_by("close", "date") - F.min_by("close", "date"), F.sum(F.abs("_d"))
    out = held.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("_rng").alias("range_mean"), F.stddev_samp("_rng").alias("range_std"), F.max("_rng").alias("range_max"), F.sum("_flip").cast("long").alias("direction_changes"),
        F.when(path > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(net) / path))).otherwise(0.0).alias("oscillation"), (net / F.min_by("close", "date")).alias("drift"),
        F.when(F.max("high") > F.min("low"), (F.max_by("close", "date") - F.min("low")) / (F.max("high") - F.min("low"))).alias("position"), F.avg("volume").alias("avg_volume"),
    ).filter(F.col("n") >= least)
    consistency = F.when(F.col("range_mean") > 0, 1 / (1 + F.col("range_std") / F.col("range_mean"))).otherwise(0.0)
    out = out.withColumn("consistency", consistency)
    return out.withColumn("score", F.col("range_mean") * 100 * F.col("consistency"))


def live_factors(bars: DataFrame, look: Lookbacks = Lookbacks(), least: int = 60, by: str = "ticker") -> DataFrame:
    """Latest momentum, volatility (sample), Sharpe and trend of each ticker over its own bars."""
    w = Window.partitionBy(by).orderBy("date")
    held = bars.filter("close IS NOT NULL").withColumn("_r", F.log(F.col("close") / F.lag("close").over(w))).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("date"))))
    held = held.withColumn("_all", F.count("*").over(Window.partitionBy(by)))
    at = lambda k: F.max(F.when(F.col("_n") == F.least(F.lit(k), F.col("_all")), F.col("close")))
    inside = lambda k: F.col("_n") <= k
    last = F.max(F.when(F.col("_n") == 1, F.col("close")))
    out = held.groupBy(by).agg(
        F.max("_all").alias("n"), last.alias("close"), (at(look.skip) / at(look.momentum) - 1).alias("momentum"),
        F.stddev_samp(F.when(inside(look.momentum), F.col("_r"))).alias("_sd"), F.avg(F.when(inside(look.momentum), F.col("_r"))).alias("_mean"), F.avg(F.when(inside(look.trend), F.col("close"))).alias("_sma"),
    ).filter(F.col("n") >= least)
    return out.select(by, "n", "close", "momentum", (F.col("_sd") * F.sqrt(F.lit(look.per_year))).alias("vol"), F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * F.sqrt(F.lit(look.per_year))).alias("sharpe"),
                      F.when(F.col("n") >= look.trend, F.col("close") > F.col("_sma")).alias("above_trend"), F.when(F.col("n") >= look.trend, F.col("close") / F.col("_sma") - 1).alias("trend_distance"))
