"""Data-integrity audits, each a small table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import valid_symbol


def duplicate_groups(rows: DataFrame, natural_key: list[str], by: str = "chamber", url: str = "report_url") -> DataFrame:
    """Per chamber: groups of one natural key from several reports, their excess rows, and how many lack the mark."""
    amended = F.coalesce("amended", F.lit(False))
    groups = rows.groupBy(*natural_key).agg(F.count("*").alias("n"), F.count_distinct(url).alias("urls"), F.count_if(amended).alias("marked")).filter("urls > 1")
    out = groups.groupBy(by).agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("excess"), F.sum(F.greatest(F.lit(0), F.col("n") - 1 - F.col("marked"))).alias("unmarked"), F.sum("marked").alias("marked"))
    return out


def bad_symbols(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: distinct bad symbols, their rows, and rows of good symbols outside the universe."""
    seen = rows.select("ticker", valid_symbol(F.col("ticker")).alias("good")).join(universe.select("ticker").distinct().withColumn("_in", F.lit(True)), "ticker", "left")
    return seen.agg(F.count_distinct(F.when(~F.col("good"), F.col("ticker"))).alias("bad_distinct"), F.count_if(~F.col("good")).alias("bad_rows"), F.count_if(F.col("good") & F.col("_in").isNull()).alias("outside_rows"))


def top_bad_symbols(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.filter(~valid_symbol(F.col("ticker"))).groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(n)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def ranked_beyond(rows: DataFrame, rank: str, most: int = 30) -> DataFrame:
    """Rows whose rank lies beyond what a source can hold."""
    return rows.filter(F.col(rank) > most)


def event_yield(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per source: stored rows, events, and their ratio (null without rows). One pass over each table."""
    out = None
    for source, (stored, events) in pairs.items():
        part = stored.select(F.lit(source).alias("source"), F.lit(1).alias("s"), F.lit(0).alias("e")).union(events.select(F.lit(source), F.lit(0), F.lit(1)))
        out = part if out is None else out.union(part)
    return out.groupBy("source").agg(F.sum("s").alias("stored"), F.sum("e").alias("events")).withColumn("yield", F.when(F.col("stored") > 0, F.col("events") / F.col("stored")))
