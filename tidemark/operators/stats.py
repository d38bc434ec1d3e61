"""Statistics of monthly series, grouped: Newey-West and naive t, correlation matrices, trials and false discoveries."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators.ranks import numbered
from tidemark.storage import stored

#: Values of a series that one task takes, and so many more as there are lags.
BLOCK = 100_000


def newey_west(series: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("month_ix",), denominator: str = "overlap") -> DataFrame:
    """Mean, lag and t of each series with Bartlett weights; autocovariances are means of the overlapping products
    (``denominator='n'`` divides by n). t is zero for fewer than 3 values or a long-run variance of zero or less.

    Values are numbered by counts per first column of ``order``, and lagged within blocks that begin with the last values
    of the block before; so no series is one task's, and there are as many lags as the longest one asks for.
    """
    held = stored(series.filter(F.col(value).isNotNull()).select(*by, *order, F.col(value).alias("_v")), "series")
    sums = held.groupBy(*by, order[0]).agg(F.count("*").alias("_c"), F.sum("_v").alias("_s"))
    run, whole = Window.partitionBy(*by).orderBy(order[0]), Window.partitionBy(*by)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(whole))
    sums = sums.withColumn("_m", F.sum("_s").over(whole) / F.col("_n")).drop("_s", "_c")  # a row per value of the first order column
    longest = sums.agg(F.max("_n")).first()[0] or 0
    most = lag_of(longest)
    placed = held.join(sums, [*by, order[0]]).withColumn("_e", F.col("_v") - F.col("_m"))
    placed = placed.withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(*by, order[0]).orderBy(*order)) - 1)
    block = F.floor(F.col("_i") / BLOCK)
    spread = placed.withColumn("_b", F.explode(F.array_distinct(F.array(block, F.floor((F.col("_i") + most) / BLOCK))))).withColumn("_own", F.col("_b") == block)
    inside = Window.partitionBy(*by, "_b").orderBy("_i")
    lags = range(most + 1)
    product = {f"_p{k}": F.when(F.col("_own"), F.col("_e") * (F.lag("_e", k).over(inside) if k else F.col("_e"))) for k in lags}
    out = spread.withColumns(product).filter("_own").groupBy(*by).agg(
        F.max("_n").alias("n"), F.max("_m").alias("mean"), *(F.count(f"_p{k}").alias(f"_c{k}") for k in lags), *(F.sum(f"_p{k}").alias(f"_g{k}") for k in lags)
    )
    covered = (lambda k: F.col(f"_c{k}")) if denominator == "overlap" else (lambda k: F.col("n"))
    lag = F.greatest(F.lit(1), F.least(F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))), F.col("n") - 1)).cast("int")
    out = out.withColumn("lag", lag)
    lrv = F.col("_g0") / covered(0)
    for k in lags[1:]:
        lrv = lrv + F.when((F.col("lag") >= k) & (F.col(f"_c{k}") > 0), 2 * (1 - F.lit(float(k)) / (F.col("lag") + 1)) * F.col(f"_g{k}") / covered(k)).otherwise(0.0)
    out = out.withColumn("_lrv", lrv)
    return out.select(*by, "n", "mean", "lag", F.when((F.col("n") >= 3) & (F.col("_lrv") > 1e-300), F.col("mean") / F.sqrt(F.col("_lrv") / F.col("n"))).otherwise(0.0).alias("t"))


def lag_of(n: int) -> int:
    """Lags for a series of n values."""
    return max(1, min(math.floor(4 * (n / 100) ** (2 / 9) + 1e-9), n - 1))


def naive_t(series: DataFrame, value: str = "value", by: tuple[str, ...] = ("series",)) -> DataFrame:
    out = series.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("_s"))
    return out.select(*by, "n", "mean", F.when(F.col("_s") > 0, F.col("mean") / F.col("_s") * F.sqrt(F.col("n").cast("double"))).otherwise(0.0).alias("t"))


def series_correlation(series: DataFrame, value: str = "value", name: str = "series", order: str = "month_ix", least: int = 6) -> DataFrame:
    """Correlation of every pair of series over their common months; null under ``least`` months or without spread."""
    held = series.filter(F.col(value).isNotNull())
    a = held.select(order, F.col(name).alias("a"), F.col(value).alias("x"))
    b = held.select(order, F.col(name).alias("b"), F.col(value).alias("y"))
    out = a.join(b, order).groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("_c"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"))
    return out.select("a", "b", "n", F.when((F.col("n") >= least) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_c")).alias("corr"))


def bonferroni_t(n: int, alpha: float = 0.05) -> float:
    return NormalDist().inv_cdf(1 - alpha / (2 * n))


def harmonic(n: int) -> float:
    return sum(1 / k for k in range(1, n + 1))


def step_up_t(n: int, k: int, alpha: float = 0.05) -> float:
    """The |t| that rank k of n tests must reach under a step-up procedure for dependent tests."""
    return NormalDist().inv_cdf(1 - k * alpha / (2 * n * harmonic(n)))


def step_up(tests: DataFrame, alpha: float = 0.05, family: str = "family", name: str = "name") -> DataFrame:
    """Per test: p, rank by |t|, critical |t|, and whether it passes: all ranks up to the largest that reaches its own bar.

    Bars and p-values are column expressions and ranks are numbered by ranges, so a family may be of any size. Tests
    without a t have no rank and take no part.
    """
    held = tests.filter(F.col("t").isNotNull()).withColumn("_a", -F.abs("t"))
    ranked = numbered(held, ["_a", name], (family,), "rank").drop("_a")
    sizes = ranked.groupBy(family).agg(F.count("*").alias("n"))
    out = ranked.join(sizes, family).withColumn("p", normal.two_sided_p(F.col("t")))
    bar = normal.upper_quantile(F.col("rank") * F.lit(alpha) / (2 * F.col("n") * normal.harmonic(F.col("n"))))
    out = stored(out.withColumn("critical_t", bar), "step-up")
    last = out.filter(F.abs("t") >= F.col("critical_t")).groupBy(family).agg(F.max("rank").alias("_last"))
    return out.join(last, family, "left").withColumn("passes", F.coalesce(F.col("rank") <= F.col("_last"), F.lit(False))).drop("_last")


def gate(series_t: DataFrame, own_tests: int, published_tests: int = 316, alpha: float = 0.05) -> DataFrame:
    """Verdict on |t| against the family's own bar and the published zoo's."""
    t = F.abs("t")
    own, zoo = step_up_t(own_tests, 1, alpha), step_up_t(published_tests, 1, alpha)
    return series_t.withColumn("own_bar", F.lit(own)).withColumn("zoo_bar", F.lit(zoo)).withColumn("verdict", F.when(t >= zoo, "passes both").when(t >= own, "passes own").otherwise("fails"))


def trials(log: DataFrame) -> DataFrame:
    """Cumulative number of tests and the next run's id."""
    return log.agg(F.coalesce(F.sum("n_tests"), F.lit(0)).alias("n_tests"), (F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("next_id"))
