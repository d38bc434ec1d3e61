"""Grouped reports on disclosures, managers, run logs and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import amount_midpoint, known_on, lag_band, trade_sign


def sided(trades: DataFrame, dialect: str = "english") -> DataFrame:
    """``trades`` with sign, mid, lag, buy and sell dollars."""
    out = trades.withColumn("sign", trade_sign(F.col("transaction_type"), dialect)).withColumn("mid", amount_midpoint(F.col("amount"))).withColumn("lag", F.datediff("disclosure_date", "transaction_date"))
    return out.withColumn("buy", F.when(F.col("sign") > 0, F.col("mid")).otherwise(0.0)).withColumn("sell", F.when(F.col("sign") < 0, F.col("mid")).otherwise(0.0))


_SIDES = lambda: (F.count_if(F.col("sign") > 0).alias("n_buys"), F.count_if(F.col("sign") < 0).alias("n_sells"), F.sum("buy").alias("bought"), F.sum("sell").alias("sold"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_distinct("member").alias("members"), F.count_distinct("ticker").alias("tickers"), *_SIDES())


def by_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format(known_on(F.col("disclosure_date"), F.col("transaction_date")), "yyyy-MM")).groupBy("month").agg(F.count("*").alias("n"), *_SIDES())


def top_tickers(rows: DataFrame, n: int = 25, member: bool = False) -> DataFrame:
    keys = ["member", "ticker"] if member else ["ticker"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum("buy") - F.sum("sell")).alias("net"), F.max("transaction_date").alias("last_date"), *_SIDES())
    if member:
        return out.withColumn("place", F.row_number().over(Window.partitionBy("member").orderBy(F.desc(F.abs("net")), "ticker"))).filter(F.col("place") <= n)
    return out.orderBy(F.desc(F.abs("net")), "ticker").limit(n)


def top_members(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.groupBy("member").agg(F.count("*").alias("n"), *_SIDES()).orderBy(F.desc("n"), "member").limit(n)


def lag_histogram(rows: DataFrame) -> DataFrame:
    return rows.withColumn("band", lag_band(F.col("lag"))).filter("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("n"))


def upper_median(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The element at n // 2 of the sorted values, by counts of equal values rather than a collected list."""
    by = by or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row per distinct value
    counts = counts.withColumn("_cum", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    hit = counts.filter(F.col("_cum") > F.floor(F.col("_n") / 2))
    return hit.groupBy(*by).agg(F.min(value).alias("median"))


def member_profile(rows: DataFrame) -> DataFrame:
    lags = F.when(F.col("lag").between(0, 365), F.col("lag"))
    return rows.groupBy("member").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"), *_SIDES(), F.avg(lags).alias("mean_lag"), F.max("transaction_date").alias("last_date"))


def managers_by_ticker(moves: DataFrame) -> DataFrame:
    return moves.groupBy("ticker").agg(F.count_distinct("manager").alias("managers"), F.sum("value").alias("value"), F.count("*").alias("n"), F.max((F.col("action") == "NEW").cast("int")).alias("has_new"))


def tickers_by_manager(moves: DataFrame) -> DataFrame:
    return moves.groupBy("manager").agg(F.sum("value").alias("value"), F.count_if(F.col("action") == "NEW").alias("n_new"), F.count_if(F.col("action") != "NEW").alias("n_other"))


def crowded(moves: DataFrame, n: int = 10) -> DataFrame:
    return managers_by_ticker(moves).orderBy(F.desc("managers"), F.desc("value"), "ticker").limit(n)


def freshness(runs: DataFrame, thresholds: dict[str, int], now: Column, default: int = 86_400) -> DataFrame:
    """Per source: latest run, latest good run, age of the latter in seconds and whether it is stale."""
    out = runs.groupBy("source").agg(F.max("ran_at").alias("last_run"), F.max_by("ok", "ran_at").alias("last_ok"), F.max(F.when(F.col("ok"), F.col("ran_at"))).alias("last_good"))
    most = F.coalesce(F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))[F.col("source")], F.lit(default)) if thresholds else F.lit(default)
    age = F.unix_timestamp(now) - F.unix_timestamp("last_good")
    return out.withColumn("age_s", age).withColumn("stale", F.coalesce(age > most, F.lit(True)))


def forecast_kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("composite") >= 0.5).alias("strong"), F.count_if((F.col("composite") >= 0.2) & (F.col("composite") < 0.5)).alias("buy"), F.avg(F.col("hit")).alias("hit_rate"))


def active_tickers(forecasts: DataFrame, statuses: tuple[str, ...] = ("open",), least_conviction: int = 0) -> DataFrame:
    held = forecasts.filter(F.col("status").isin(*statuses) & (F.col("conviction") >= least_conviction))
    return held.select(F.explode("tickers").alias("ticker")).distinct()


def resolve_people(names: DataFrame, roster: DataFrame, key: Column, roster_key: Column) -> DataFrame:
    """(name, person_id): the exact normalised name, else the person of that last name with the smallest id."""
    left = names.select("name", key.alias("_k")).distinct().withColumn("_last", F.element_at(F.split("_k", " "), -1))
    r = roster.select("person_id", roster_key.alias("_rk")).withColumn("_rl", F.element_at(F.split("_rk", " "), -1))
    exact = r.groupBy(F.col("_rk").alias("_k")).agg(F.min("person_id").alias("_exact"))
    last = r.groupBy(F.col("_rl").alias("_last")).agg(F.min("person_id").alias("_same_last"))
    return left.join(exact, "_k", "left").join(last, "_last", "left").select("name", F.coalesce("_exact", "_same_last").alias("person_id"))


def committee_weight(rows: DataFrame, high: DataFrame, last_name: str = "last_name") -> DataFrame:
    """2 for members of a high committee, else 1."""
    held = high.select(last_name).distinct().withColumn("_w", F.lit(2.0))
    return rows.join(held, last_name, "left").withColumn("weight", F.coalesce("_w", F.lit(1.0))).drop("_w")
