"""Registration of queries: a function of the feeds, and the SQL that must give the same rows, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.standins import Feeds, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Feeds], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Feeds(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = duck_sql(sql)
        return f

    return register


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of an engine's additions doesn't show."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
