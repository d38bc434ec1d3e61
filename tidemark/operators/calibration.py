"""Forecast calibration: Brier scores, buckets, trends, decisions, and the review queue. Dates are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import running_sums

#: Reviews of a block of rolling means.
BLOCK = 100_000
#: What losses are added as: the digits that a double has, so a mean is the same however rows are dealt, and one that lies
#: halfway between two rounded values goes up.
_LOSS = "CAST(loss AS DECIMAL(20,15))"


def graded(reviews: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Reviews with an outcome of their own, or of forecasts that are closed; unclear ones are out. Adds prob and hit."""
    both = reviews.join(forecasts.select("thesis_id", "author", "conviction", "status"), "thesis_id")
    held = both.filter(F.col("status").isin("right", "wrong") | F.col("outcome").isin("right", "wrong")).filter(F.col("outcome") != "unclear")
    return held.withColumn("prob", F.col("conviction") / 5).withColumn("hit", (F.col("outcome") == "right").cast("double")).withColumn("loss", F.pow(F.col("prob") - F.col("hit"), F.lit(2.0)))


def brier(rows: DataFrame) -> DataFrame:
    """Per author, and over all (author null)."""
    return rows.rollup("author").agg(F.count("*").alias("n"), (F.sum(F.expr(_LOSS)) / F.count("loss")).cast("double").alias("brier"))


def buckets(rows: DataFrame, least: int = 5, margin: float = 0.10) -> DataFrame:
    """Hit rate per conviction; a bucket of ``least`` and more that hits under prob - margin is overconfident."""
    out = rows.groupBy("conviction").agg(F.count("*").alias("n"), F.avg("hit").alias("hit_rate"), F.avg("prob").alias("prob"))
    return out.withColumn("overconfident", (F.col("n") >= least) & (F.col("hit_rate") < F.col("prob") - margin))


def is_overconfident(bucket_rows: DataFrame) -> DataFrame:
    return bucket_rows.agg(F.coalesce(F.max("overconfident"), F.lit(False)).alias("overconfident"))


def trend(rows: DataFrame, by: str = "author", last: int = 10) -> DataFrame:
    """Cumulative and rolling Brier score of each author at each review."""
    w = Window.partitionBy(by).orderBy("reviewed_on", "thesis_id")
    rolling, so_far = w.rowsBetween(-(last - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    cumulative = (F.sum(F.expr(_LOSS)).over(so_far) / F.count("loss").over(so_far)).cast("double")
    return rows.select(by, "thesis_id", "reviewed_on", cumulative.alias("cumulative"), F.when(F.count("loss").over(rolling) == last, F.avg("loss").over(rolling)).alias("rolling"))


def trend_over_all(rows: DataFrame, last: int = 10, block: int = BLOCK) -> DataFrame:
    """Cumulative and rolling Brier score over all reviews, in the order of their day and forecast; those without a day
    take part in none.

    The order has no groups, so no window may hold it: sums run by ranges, and rolling means in blocks of ``block``
    reviews that each begin with the last reviews of the block before.
    """
    held = rows.filter("reviewed_on IS NOT NULL").select("author", "thesis_id", "reviewed_on", "loss")
    run = running_sums(held.withColumn("_exact", F.expr(_LOSS)), ["reviewed_on", "thesis_id", "loss"], {"_sum": "_exact"})
    own = F.floor((F.col("place") - 1) / block)
    spread = run.withColumn("_b", F.explode(F.array_distinct(F.array(own, F.floor((F.col("place") + last - 2) / block))))).withColumn("_own", F.col("_b") == own)
    back = Window.partitionBy("_b").orderBy("place").rowsBetween(-(last - 1), 0)
    spread = spread.withColumn("rolling", F.when(F.count("loss").over(back) == last, F.avg("loss").over(back))).filter("_own")
    return spread.select("author", "thesis_id", "reviewed_on", (F.col("_sum") / F.col("place")).cast("double").alias("cumulative"), "rolling")


def decisions(reviews: DataFrame) -> DataFrame:
    good, flawed = F.count_if(F.col("decision_quality") == "good"), F.count_if(F.col("decision_quality") == "flawed")
    return reviews.agg(good.alias("good"), flawed.alias("flawed"), F.when(good + flawed > 0, good / (good + flawed)).alias("process_score"))


def due(forecasts: DataFrame, as_of: Column) -> DataFrame:
    return forecasts.filter((F.col("status") == "open") & (F.col("review_date") <= as_of))


def digest(forecasts: DataFrame, as_of: Column, oldest: int = 3) -> DataFrame:
    """One row: counts due, pending and open, and the ids of the oldest open forecasts."""
    counts = forecasts.agg(F.count_if((F.col("status") == "open") & (F.col("review_date") <= as_of)).alias("n_due"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("status") == "open").alias("n_open"))
    first = forecasts.filter("status = 'open'").orderBy("opened", "thesis_id").limit(oldest)
    ids = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("opened", "thesis_id"))), lambda x: x["thesis_id"]).alias("oldest"))
    return counts.withColumn("_k", F.lit(0)).join(ids.withColumn("_k", F.lit(0)), "_k").drop("_k")  # one-row tables
