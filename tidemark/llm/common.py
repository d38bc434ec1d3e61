"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import dropped, stored

__all__ = ["dropped", "fresh", "row_key", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever extra columns it brings."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(text: str = "text") -> list[Column]:
    """A document's key: its id and a hash of its text, so that rows which share an id but not a text stay apart."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")]
