"""Feeds that come as delimited files, and the sinks. Parsers take rows of text, so the same code serves files and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import month_name_day, owner_role
from tidemark.storage import swap


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, with the file and the line's place in it (files are read whole lines at a time)."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def parse_membership(rows: DataFrame) -> DataFrame:
    """(snap_date, ticker) from ``date,"A,B,C"`` lines: comments and the header are skipped, dots in symbols become
    dashes. Fails without any member."""
    held = rows.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    held = held.select(F.try_to_timestamp(F.trim(F.regexp_extract("line", r"^([^,]*),", 1)), F.lit("yyyy-MM-dd")).cast("date").alias("snap_date"), F.regexp_replace(F.regexp_extract("line", r"^[^,]*,(.*)$", 1), '"', "").alias("list"))
    out = held.filter("snap_date IS NOT NULL").select("snap_date", F.explode(F.split("list", ",")).alias("t"))
    return out.select("snap_date", F.regexp_replace(F.upper(F.trim("t")), r"\.", "-").alias("ticker")).filter("ticker <> ''").distinct()


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    out = parse_membership(lines(spark, path))
    if not out.limit(1).count():
        raise ValueError(f"no members in {path}")
    return out


def read_sectors(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, header=header, comment="#", schema="ticker string, sector string").filter("ticker IS NOT NULL")


def parse_short_volume(rows: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """``Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market`` lines to typed rows; headers, short lines, bad
    numbers and totals of zero or less are out."""
    p = F.split("line", r"\|")
    held = rows.withColumn("_p", p).filter(F.size("_p") >= 5)
    at = lambda i: F.trim(F.col("_p")[i])
    out = held.select(F.try_to_timestamp(at(0), F.lit("yyyyMMdd")).cast("date").alias("date"), F.upper(at(1)).alias("ticker"), at(2).try_cast("double").cast("long").alias("short_volume"), at(4).try_cast("double").cast("long").alias("total_volume"))
    out = out.filter("date IS NOT NULL AND ticker <> '' AND short_volume IS NOT NULL AND total_volume > 0")
    return out.join(universe.select("ticker").distinct(), "ticker", "left_semi").select("date", "ticker", "short_volume", "total_volume") if universe is not None else out


def insider_buys(submissions: DataFrame, owners: DataFrame, trades: DataFrame, universe: DataFrame) -> DataFrame:
    """The quarter's three tables to purchases: form 4 of the universe, the first owner of each filing, code P, acquired or
    blank, positive shares and price, dates that can be read; value = shares x price. Owners with columns archive and line
    are taken in that order, as files have them, others by CIK. A filing without owners has an empty filer and role other."""
    filed = submissions.filter("DOCUMENT_TYPE = '4'").select("ACCESSION_NUMBER", F.upper(F.trim("ISSUERTRADINGSYMBOL")).alias("ticker"), month_name_day(F.col("FILING_DATE")).alias("filing_date"))
    filed = filed.filter("filing_date IS NOT NULL").join(universe.select("ticker").distinct(), "ticker", "left_semi")
    order = F.struct("archive", "line") if "line" in owners.columns else F.col("RPTOWNERCIK")
    first = owners.groupBy("ACCESSION_NUMBER").agg(F.min_by(F.struct("RPTOWNERNAME", "RPTOWNER_RELATIONSHIP"), order).alias("o"))
    number = lambda c: F.col(c).try_cast("double")
    buys = trades.filter((F.col("TRANS_CODE") == "P") & F.upper(F.coalesce(F.trim("TRANS_ACQUIRED_DISP_CD"), F.lit(""))).isin("A", "")).select("ACCESSION_NUMBER", month_name_day(F.col("TRANS_DATE")).alias("date"), number("TRANS_SHARES").alias("shares"), number("TRANS_PRICEPERSHARE").alias("price"))
    out = buys.filter("shares > 0 AND price > 0 AND date IS NOT NULL").join(filed, "ACCESSION_NUMBER").join(first, "ACCESSION_NUMBER", "left")
    role = F.coalesce(owner_role(F.col("o.RPTOWNER_RELATIONSHIP")), F.lit("other"))
    return out.select("ticker", F.coalesce("o.RPTOWNERNAME", F.lit("")).alias("filer"), role.alias("role"), "filing_date", "date", "shares", "price", (F.col("shares") * F.col("price")).alias("value"))


def earliest_facts(facts: DataFrame, concepts: dict[str, list[str]]) -> DataFrame:
    """Per ticker and period: the earliest filed value of each concept (several tags may pool), and the first filing day."""
    name = None
    for out, tags in concepts.items():
        name = F.when(F.col("concept").isin(tags), out) if name is None else name.when(F.col("concept").isin(tags), out)
    held = facts.withColumn("_c", name).filter("_c IS NOT NULL AND value IS NOT NULL")
    order = F.struct("filing_date", "concept")
    return held.groupBy("ticker", "period_end").agg(F.min("filing_date").alias("filing_date"), *(F.min_by(F.when(F.col("_c") == c, F.col("value")), F.when(F.col("_c") == c, order)).alias(c) for c in concepts))


def missing_sessions(start: Column, stop: Column, covered: DataFrame) -> DataFrame:
    """Weekdays from start to stop that aren't covered."""
    days = covered.sparkSession.range(1).select(F.explode(F.sequence(start, stop)).alias("date"))
    return days.filter(~F.dayofweek("date").isin(1, 7)).join(covered.select("date").distinct(), "date", "left_anti")


def fetch_plan(tickers: DataFrame, coverage: DataFrame, start: Column, stop: Column, stale_days: int = 4) -> DataFrame:
    """Per ticker: full where nothing, or too late a start, is covered; tail where the end is stale; else covered."""
    got = tickers.join(coverage, "ticker", "left")
    kind = F.when(F.col("start").isNull() | (F.col("start") > start), "full").when(F.datediff(stop, "stop") > stale_days, "tail").otherwise("covered")
    return got.select("ticker", kind.alias("plan"))


def snapshot(tables: dict[str, DataFrame], folder: str, stamp: str) -> dict[str, str]:
    """Every table as Parquet under one folder of the time ``stamp``; returns the paths. An earlier one stays as it is."""
    places = {name: f"{folder}/{stamp}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(places[name])
    return places


def replace_table(df: DataFrame, path: str, allow_empty: bool = False) -> bool:
    """Replace a result table whole; an empty result leaves the old one unless allowed. Returns whether it was written.
    The new table is written beside the old one and takes its place when it is complete."""
    new = f"{path}.new"
    df.write.mode("overwrite").parquet(new)
    if not allow_empty and not df.sparkSession.read.schema(df.schema).parquet(new).limit(1).count():
        return False
    swap(df.sparkSession, new, path)
    return True


def first_in_order(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter("_n = 1").drop("_n")
