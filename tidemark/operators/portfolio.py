"""Portfolios over scored months: holdings, turnover, net returns, growth and drawdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_COST, BOTTOM_COST = 0.0010, 0.0025


def holdings(rows: DataFrame, score: str, side: str = "top", q: float = 0.1, least: int = 20, month: str = "month_ix", tie: str = "ticker") -> DataFrame:
    """(month, seq, ticker, ret): the bucket of each scored month; seq numbers the scored months, so that the holdings
    before a skipped month are the ones to compare with."""
    held = rows.filter(F.col(score).isNotNull())
    w = Window.partitionBy(month)
    order = w.orderBy(F.desc(score), tie) if side == "top" else w.orderBy(score, tie)
    held = held.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least).withColumn("_r", F.row_number().over(order))
    held = held.filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * q)))
    months = held.select(month).distinct().withColumn("seq", F.row_number().over(Window.orderBy(month)))  # a row per month
    return held.join(months, month).select(month, "seq", tie, "fwd")


def turnover(held: DataFrame, month: str = "month_ix", key: str = "ticker") -> DataFrame:
    """Per scored month: the mean return, and the share of names that weren't held the scored month before (1 at first)."""
    before = held.select((F.col("seq") + 1).alias("seq"), key, F.lit(1).alias("_was"))
    both = held.join(before, ["seq", key], "left")
    out = both.groupBy(month, "seq").agg(F.avg("fwd").alias("gross"), F.count("*").alias("n"), (1 - F.sum(F.coalesce("_was", F.lit(0))) / F.count("*")).alias("turnover"))
    return out.withColumn("turnover", F.when(F.col("seq") == 1, 1.0).otherwise(F.col("turnover")))


def net_of_cost(months: DataFrame, cost: float = TOP_COST) -> DataFrame:
    return months.withColumn("net", F.col("gross") - F.col("turnover") * cost)


def long_short(top: DataFrame, bottom: DataFrame, month: str = "month_ix") -> DataFrame:
    """Gross and net spread of the top over the bottom bucket."""
    b = bottom.select(month, F.col("gross").alias("_g"), F.col("turnover").alias("_t"))
    return top.join(b, month).select(month, (F.col("gross") - F.col("_g")).alias("gross"), (F.col("gross") - F.col("_g") - F.col("turnover") * TOP_COST - F.col("_t") * BOTTOM_COST).alias("net"))


def drawdowns(series: DataFrame, ret: str = "net", by: tuple[str, ...] = (), month: str = "month_ix") -> DataFrame:
    """Growth, its running peak (which starts at the first value) and the drawdown; a row per month of each series."""
    w = Window.partitionBy(*by).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    out = series.withColumn("growth", F.exp(F.sum(F.log1p(ret)).over(w)))
    return out.withColumn("peak", F.max("growth").over(w)).withColumn("drawdown", F.col("growth") / F.col("peak") - 1)


def annualise(series: DataFrame, ret: str = "net", by: tuple[str, ...] = ("series",), month: str = "month_ix", per_year: int = 12) -> DataFrame:
    """CAGR, Sharpe (population deviation) and largest drawdown per series."""
    deep = drawdowns(series, ret, by, month)
    out = deep.groupBy(*by).agg(F.count(ret).alias("n"), F.exp(F.sum(F.log1p(ret))).alias("_g"), F.avg(ret).alias("_m"), F.stddev_pop(ret).alias("_s"), F.min("drawdown").alias("max_drawdown"))
    return out.select(*by, "n", (F.pow("_g", F.lit(float(per_year)) / F.col("n")) - 1).alias("cagr"), F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(per_year)))).alias("sharpe"), "max_drawdown")


def hit_rate(series: DataFrame, benchmark: DataFrame, ret: str = "net", month: str = "month_ix", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Share of months above the benchmark, joined on the month, and mean turnover."""
    both = series.join(benchmark.select(month, F.col("ret").alias("_b")), month)
    return both.groupBy(*by).agg(F.avg((F.col(ret) > F.col("_b")).cast("double")).alias("hit_rate"), F.avg("turnover").alias("avg_turnover"), F.count("*").alias("n"))


def proxy_returns(at_rebalance: DataFrame, proxy: str) -> tuple[DataFrame, DataFrame]:
    """(the proxy's own forward returns by month, the cross-section without it). The proxy is a column of the prices that
    stands for the cap-weighted market and never takes part in a ranking."""
    own = at_rebalance.filter((F.col("ticker") == proxy) & F.col("fwd").isNotNull()).select("month_ix", F.col("fwd").alias("ret"))
    return own, at_rebalance.filter(F.col("ticker") != proxy)
