"""Cross-sections: eligibility, winsorised z-scores, block composites, demeaned returns, rank IC, tails, deciles.

All take long rows keyed by month (and factor), so each is one shuffle by month however many factors are stacked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import null_mean
from tidemark.operators.ranks import numbered


def eligible(rows: DataFrame, needed: list[str], least: int, month: str = "month_ix") -> DataFrame:
    """Rows with all ``needed`` columns, of months that have ``least`` such rows."""
    for c in needed:
        rows = rows.filter(F.col(c).isNotNull())
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(month))).filter(F.col("_n") >= least).drop("_n")


def winsor_z(rows: DataFrame, value: str = "value", out: str = "z", by: tuple[str, ...] = ("month_ix", "factor"), clip: float = 3.0, least: int = 5) -> DataFrame:
    """Population z-score clipped at ``clip``: null for fewer than ``least`` values, zero if all are equal."""
    w = Window.partitionBy(*by)
    mean, deviation, n = F.avg(value).over(w), F.stddev_pop(value).over(w), F.count(value).over(w)
    z = F.when(deviation > 0, F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(value) - mean) / deviation))).otherwise(0.0)
    return rows.withColumn(out, F.when((n >= least) & F.col(value).isNotNull(), z))


def composite(wide: DataFrame, blocks: dict[str, list[str]], variants: dict[str, list[str]]) -> DataFrame:
    """Null-skipping mean of each block's columns, then of each variant's blocks."""
    wide = wide.withColumns({f"block_{b}": null_mean(*map(F.col, cols)) for b, cols in blocks.items()})
    return wide.withColumns({v: null_mean(*(F.col(f"block_{b}") for b in names)) for v, names in variants.items()})


def sector_demean(rows: DataFrame, value: str = "fwd", out: str = "fwd_dm", least: int = 5, month: str = "month_ix") -> DataFrame:
    """Value minus its sector's mean; sectors with fewer than ``least`` values, and rows without one, take the month's."""
    sector, whole = Window.partitionBy(month, "sector"), Window.partitionBy(month)
    use = F.col("sector").isNotNull() & (F.count(value).over(sector) >= least)
    return rows.withColumn(out, F.col(value) - F.when(use, F.avg(value).over(sector)).otherwise(F.avg(value).over(whole)))


def rank_ic(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ("month_ix",), least: int = 10, tie: str = "ticker", spread: bool = False) -> DataFrame:
    """Spearman correlation by ordinal ranks, ties broken by ``tie``: null for fewer than ``least`` pairs. A month's names
    are ranked in one task each; with ``spread`` they are numbered by ranges, for cross-sections of any size."""
    held = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if spread:
        ranked = numbered(numbered(held.select(*dict.fromkeys((*by, x, y, tie))), [x, tie], by, "_x"), [y, tie], by, "_y")
        return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("_ic")).select(*by, "n", F.when(F.col("n") >= least, F.col("_ic")).alias("ic"))
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, tie)).cast("double")
    ranked = held.withColumn("_x", rank(x)).withColumn("_y", rank(y))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("_ic")).select(*by, "n", F.when(F.col("n") >= least, F.col("_ic")).alias("ic"))


def coverage(rows: DataFrame, by: tuple[str, ...] = ("month_ix", "factor"), z: str = "z") -> DataFrame:
    return rows.groupBy(*by).agg((F.count(z) / F.count("*")).alias("coverage"))


def tails(rows: DataFrame, score: str, ret: str, by: tuple[str, ...] = ("month_ix",), q: float = 0.1, least: int = 20, tie: str = "ticker") -> DataFrame:
    """Mean return of the top and of the bottom bucket of ``max(1, int(n q))`` names, over the cross-section's."""
    held = rows.filter(F.col(score).isNotNull() & F.col(ret).isNotNull())
    w = Window.partitionBy(*by)
    held = held.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * q)))
    held = held.withColumn("_top", F.row_number().over(w.orderBy(F.desc(score), tie))).withColumn("_low", F.row_number().over(w.orderBy(score, tie)))
    mean = F.avg(ret)
    out = held.groupBy(*by).agg(F.max("_n").alias("n"), (F.avg(F.when(F.col("_top") <= F.col("_k"), F.col(ret))) - mean).alias("top_excess"), (F.avg(F.when(F.col("_low") <= F.col("_k"), F.col(ret))) - mean).alias("bottom_excess"))
    return out.filter(F.col("n") >= least)


def size_halves(rows: DataFrame, size: str = "dollar_volume", by: tuple[str, ...] = ("month_ix",), least: int = 50) -> DataFrame:
    """Adds half: large at the month's own median size or more; months of fewer than ``least`` sized names are left out."""
    mid = rows.groupBy(*by).agg(F.count(size).alias("_n"), F.percentile(size, F.lit(0.5)).alias("_mid")).filter(F.col("_n") >= least)
    return rows.filter(F.col(size).isNotNull()).join(mid, list(by)).withColumn("half", F.when(F.col(size) >= F.col("_mid"), "large").otherwise("small")).drop("_n", "_mid")


def deciles(rows: DataFrame, score: str, ret: str, by: tuple[str, ...] = ("month_ix",), n: int = 10, least: int = 100, tie: str = "ticker") -> DataFrame:
    """Mean return per decile (1 lowest), for months of ``least`` names."""
    held = rows.filter(F.col(score).isNotNull() & F.col(ret).isNotNull())
    w = Window.partitionBy(*by)
    held = held.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least).withColumn("decile", F.ntile(n).over(w.orderBy(score, tie)))
    return held.groupBy(*by, "decile").agg(F.avg(ret).alias("ret"), F.count("*").alias("n"))
