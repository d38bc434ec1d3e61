"""Upserts and data-quality marks, as joins that return the new state of a table; the caller writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(stored: DataFrame, incoming: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(new state, rows added): incoming rows whose key isn't stored, one per key."""
    added = incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    return stored.unionByName(added, allowMissingColumns=True), added


def skip_known(documents: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """Documents whose address isn't known yet."""
    return documents.join(known.select(url).distinct(), url, "left_anti")


def _full(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    old, new = stored.select(F.struct(*stored.columns).alias("old")), incoming.select(F.struct(*incoming.columns).alias("new"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"old.{k}") == F.col(f"new.{k}"))
    return old.join(new, on, "full_outer")


def terminal_upsert(stored: DataFrame, incoming: DataFrame, facts: list[str], key: str = "id", state: str = "action", terminal: str = "EXIT") -> DataFrame:
    """A stored terminal row keeps its ``facts`` against an incoming row that isn't terminal; else the incoming facts
    win. Columns besides the facts keep their stored values."""
    keep = (F.col(f"old.{state}") == terminal) & (F.col(f"new.{state}") != terminal)

    def value(c: str) -> Column:
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in facts:
            return F.when(F.col(f"new.{key}").isNull() | F.coalesce(keep, F.lit(False)), old).otherwise(new).alias(c)
        return F.when(F.col(f"old.{key}").isNull(), new).otherwise(old).alias(c)

    return _full(stored, incoming, [key]).select(*map(value, stored.columns))


def earliest_filing_upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], filed: str, facts: list[str]) -> DataFrame:
    """The filing date is the earlier one; a new fact replaces the old one unless it is null."""
    pick = {filed: F.least(f"old.{filed}", f"new.{filed}")} | {c: F.coalesce(f"new.{c}", f"old.{c}") for c in facts}
    return _full(stored, incoming, keys).select(*(pick.get(c, F.coalesce(f"new.{c}", f"old.{c}")).alias(c) for c in stored.columns))


def keep_verdict_upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], overwrite: list[str], preserve: list[str]) -> DataFrame:
    """``overwrite`` columns take the incoming value, ``preserve`` columns the stored one unless it is null."""
    seen = F.col(f"new.{keys[0]}").isNotNull()
    pick = {c: F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in overwrite} | {c: F.coalesce(f"old.{c}", f"new.{c}") for c in preserve}
    return _full(stored, incoming, keys).select(*(pick.get(c, F.coalesce(f"old.{c}", f"new.{c}")).alias(c) for c in stored.columns))


def replace_by_key(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Incoming rows take the place of stored ones with their key; one row per key stays. Of several incoming rows of a key
    the one with the largest ``order`` columns wins, and of equal ones, or without ``order``, the largest whole row, so that
    results don't vary by run."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", *(order or []), *rest)).alias("_r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in stored.columns))


def widen_coverage(stored: DataFrame, incoming: DataFrame, key: str = "ticker") -> DataFrame:
    return stored.unionByName(incoming).groupBy(key).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def replace_prefix(stored: DataFrame, incoming: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose ``column`` starts with ``prefix`` go before the incoming ones are added."""
    return stored.filter(~F.col(column).startswith(prefix)).unionByName(incoming)


def mark_amended(rows: DataFrame, natural_key: list[str], disclosed: str = "disclosure_date", url: str = "report_url") -> DataFrame:
    """In each group of equal natural keys (nulls are equal) all but the newest get amended = true; others keep null.
    Newest by disclosure (null counts as 1900-01-01), then by address, both descending."""
    newest = Window.partitionBy(*natural_key).orderBy(F.desc(F.coalesce(disclosed, F.lit("1900-01-01").cast("date"))), F.desc(url))
    return rows.withColumn("amended", F.when(F.row_number().over(newest) > 1, F.lit(True)))


def adjustment_drift(stored: DataFrame, incoming: DataFrame, tolerance: float = 0.005, days: int = 10) -> DataFrame:
    """Tickers of which one of the first ``days`` overlapping closes differs by more than ``tolerance``."""
    both = stored.select("ticker", "date", F.col("close").alias("old")).join(incoming.select("ticker", "date", F.col("close").alias("new")), ["ticker", "date"])
    both = both.filter("old IS NOT NULL AND new IS NOT NULL AND old <> 0").withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    return both.filter((F.col("_n") <= days) & (F.abs(F.col("new") / F.col("old") - 1) > tolerance)).select("ticker").distinct()


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with violations: the names of the rules that don't hold (null counts as not holding)."""
    failed = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return rows.withColumn("violations", F.filter(failed, lambda x: x.isNotNull()))


def cooling_off(rows: DataFrame, as_of: Column) -> DataFrame:
    """Open forecasts that activate after ``as_of`` are pending; pending ones whose time has come are open."""
    status = F.when(F.col("status").isin("open", "pending"), F.when(F.col("activate_at") > as_of, "pending").otherwise("open")).otherwise(F.col("status"))
    return rows.withColumn("status", status)
