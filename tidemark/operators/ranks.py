"""Positions in one total order, without a window over the whole of it.

A window that ranks a group sorts the group in one task. Here rows are dealt to ranges of (group, order), sorted and
numbered within their range, and the counts of the ranges before are added: a group of any size spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import stored

#: Starts of ranges that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits of a row's number within its partition.
_ROW_BITS = 33


def ranges(rows: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), parts: int | None = None, sums: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with their range _p and their number _at, starts of ranges): stored rows in ranges of ``by`` and ``order``.

    ``starts`` has a row per group and range that it reaches into: by, _p, _first (the _at of its first row there), _count,
    _before, the group's rows in the ranges before, and for each of ``sums`` its sum before, _before_<column>. Rows that are equal in ``by`` and ``order`` share a range.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    held = stored(dealt, "ranges").withColumn("_p", F.shiftright("_at", _ROW_BITS))
    starts = held.groupBy(*by, "_p").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    earlier = {"_before": F.sum("_count")} | {f"_before_{c}": F.sum(f"_sum_{c}") for c in sums}
    return held, stored(starts.withColumns({k: F.coalesce(v.over(before), F.lit(0)) for k, v in earlier.items()}), "range-starts")


def placed(held: DataFrame, starts: DataFrame, by: tuple[str, ...] = (), name: str = "place", take: tuple[str, ...] = ()) -> DataFrame:
    """``held`` with its place (1 is first) and the columns ``take`` of ``starts``. The join's key holds the range, so a
    large group is spread; null groups are groups."""
    s = starts.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(by)), F.col("_p").alias("_sp"), "_first", "_before", *take)
    both = held.join(F.broadcast(s) if s.count() <= BROADCAST_ROWS else s, (F.col("_p") == F.col("_sp")) & _same(by, "_s"))
    place = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return both.withColumn(name, place).drop("_p", "_at", "_first", "_before", "_sp", *(f"_s{i}" for i in range(len(by))))


def numbered(rows: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), name: str = "place", parts: int | None = None) -> DataFrame:
    """``rows`` with the place of each in the order of its group, as ``row_number`` over a window gives it.

    Defined results: rows that ``by`` and ``order`` don't tell apart get places in an arbitrary order; null keys are a
    group; an empty table stays empty.
    """
    held, starts = ranges(rows, order, by, parts)
    return placed(held, starts, by, name)


def running_sums(rows: DataFrame, order: list[str | Column], sums: dict[str, str], by: tuple[str, ...] = (), name: str = "place", parts: int | None = None) -> DataFrame:
    """``rows`` with their place and, for each ``{new: column}`` of ``sums``, the sum of the column up to and with the row:
    sums within a range, and what the ranges before it hold."""
    held, starts = ranges(rows, order, by, parts, tuple(sums.values()))
    inside = Window.partitionBy(*by, "_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumns({f"_own_{new}": F.sum(c).over(inside) for new, c in sums.items()})
    out = placed(held, starts, by, name, tuple(f"_before_{c}" for c in sums.values()))
    return out.withColumns({new: F.col(f"_before_{c}") + F.coalesce(F.col(f"_own_{new}"), F.lit(0)) for new, c in sums.items()}).drop(*(f"_own_{new}" for new in sums), *(f"_before_{c}" for c in sums.values()))


def percent_ranks(rows: DataFrame, value: str, by: tuple[str, ...], name: str = "percent") -> DataFrame:
    """``rows`` with the share of the group's other rows that have a smaller value (ties share it), as ``percent_rank``.

    Distinct values are counted before anything is ordered, so ties are one row of the running sums. Nulls come first."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*(F.col(c).alias(f"_t{i}") for i, c in enumerate(by))).agg(F.sum("_c").alias("_all"))
    before = running_sums(counts, [value], {"_to": "_c"}, by).join(totals, _same(by, "_t"))
    share = F.when(F.col("_all") > 1, (F.col("_to") - F.col("_c")) / (F.col("_all") - 1)).otherwise(0.0)
    before = before.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate((*by, value))), share.alias(name))
    return rows.join(before, _same((*by, value), "_k")).drop(*(f"_k{i}" for i in range(len(by) + 1)))


def _same(columns: tuple[str, ...], prefix: str) -> Column:
    """The columns equal those named by the prefix and their number; nulls equal nulls."""
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return on
