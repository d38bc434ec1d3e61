"""Rankings and filters: live composite, swing screen, watch lists, latest snapshots, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import case_side, conviction
from tidemark.operators import xsection
from tidemark.operators.ranks import numbered


def ranked_with_forced(rows: DataFrame, score: str, top: int, forced: DataFrame | None = None, key: str = "ticker") -> DataFrame:
    """True ranks; the first ``top`` rows, and forced ones whatever their rank. The universe is ranked by ranges."""
    out = numbered(rows, [F.desc_nulls_last(score), F.col(key)], name="rank")
    if forced is None:
        return out.filter(F.col("rank") <= top).withColumn("forced", F.lit(False))
    out = out.join(forced.select(key).distinct().withColumn("_f", F.lit(True)), key, "left")
    return out.filter((F.col("rank") <= top) | F.col("_f")).withColumn("forced", F.coalesce("_f", F.lit(False)) & (F.col("rank") > top)).drop("_f")


def latest_rows(rows: DataFrame, filters: dict[str, object], order: list[Column], limit: int, since: tuple[str, Column] | None = None) -> DataFrame:
    """A list query: equality or membership filters that aren't null, a first day, an order and a limit."""
    for c, v in filters.items():
        if v is not None:
            rows = rows.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    if since:
        rows = rows.filter(F.col(since[0]) >= since[1])
    return rows.orderBy(*order).limit(limit)


def latest_snapshot(rows: DataFrame, day: str = "snapshot_date") -> DataFrame:
    return rows.join(F.broadcast(rows.agg(F.max(day).alias(day))), day)


def latest_per_entity(rows: DataFrame, by: str, order: list[Column], n: int = 10) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= n)


def first_of_lists(*lists: DataFrame, key: str = "ticker") -> DataFrame:
    """Union of lists in order of precedence; each key once, with the place of the first list that has it."""
    both = None
    for i, one in enumerate(lists):
        part = one.select(key, F.lit(i).alias("priority"))
        both = part if both is None else both.union(part)
    return both.groupBy(key).agg(F.min("priority").alias("priority"))


#: Digits to which two scores are compared: beyond them, the order of an engine's additions shows.
TIE = 9


def cases(candidates: DataFrame, z_columns: list[str], notes: DataFrame | None = None) -> DataFrame:
    """Per candidate: bull factors by falling z, risk factors by rising z, and conviction from the composite. With
    ``notes`` (factor, title) also the first note, by title, of the factor that stands out most."""
    long = candidates.unpivot(["ticker", "composite"], z_columns, "factor", "z").withColumn("side", case_side(F.col("z")))
    pick = lambda side, sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(F.round(sign * F.col("z"), TIE).alias("k"), "factor")))), lambda x: x["factor"]), ",")
    out = long.groupBy("ticker", "composite").agg(pick("bull", -1).alias("bull"), pick("risk", 1).alias("risk"), F.max_by("factor", F.struct(F.round(F.abs("z"), TIE), "factor")).alias("_top"))
    out = out.withColumn("conviction", conviction(F.col("composite")))
    if notes is None:
        return out.drop("_top")
    first = notes.groupBy(F.col("factor").alias("_top")).agg(F.min("title").alias("note"))
    return out.join(first, "_top", "left").drop("_top")


def case_points(candidates: DataFrame, z_columns: list[str], notes: DataFrame | None = None) -> DataFrame:
    """The arguments of every candidate's case, a row each: side, place (bull ones by falling z, risks by rising z, ties to
    ``TIE`` digits by factor), factor and z. ``notes`` (factor and other columns) holds what was retrieved for a factor, as by ``text.top_k``
    with k = 1; its columns are null where nothing was found. There is one row per factor, so it is broadcast."""
    long = candidates.unpivot("ticker", z_columns, "factor", "z").withColumn("side", case_side(F.col("z"))).filter("side IS NOT NULL")
    strongest = Window.partitionBy("ticker", "side").orderBy(F.desc(F.round(F.abs("z"), TIE)), "factor")
    out = long.select("ticker", "side", F.row_number().over(strongest).alias("place"), "factor", "z")
    if notes is None:
        return out
    found = [c for c in notes.columns if c != "factor"]
    one = notes.filter(F.col("factor").isin(*z_columns)).groupBy("factor").agg(F.min(F.struct(*found)).alias("_n"))
    return out.join(F.broadcast(one), "factor", "left").select(*out.columns, *(F.col(f"_n.{c}").alias(c) for c in found))


def preview(text: Column, most: int = 240) -> Column:
    """The start of a note's text in one line, without front matter."""
    bare = F.when(text.startswith("---"), F.element_at(F.split(text, "---", 3), -1)).otherwise(text)
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, most)


#: Oscillation from which a name counts as a swinger.
SWINGER = 0.7


def contains_filter(rows: DataFrame, text: str, column: str, floors: dict[str, float], swingers: bool = False, sort: str | None = None) -> DataFrame:
    """Case-insensitive substring, numeric floors, swingers only (column oscillation), and a falling order by ``sort``."""
    rows = rows.filter(F.lower(column).contains(text.lower()))
    for c, least in floors.items():
        rows = rows.filter(F.col(c) >= least)
    if swingers:
        rows = rows.filter(F.col("oscillation") >= SWINGER)
    return rows.orderBy(F.desc_nulls_last(sort), column) if sort else rows


def context(sources: dict[str, tuple[DataFrame, str, str]], by: str = "ticker", n: int = 10) -> DataFrame:
    """The latest ``n`` rows of every source for each entity in one table: source, ``by``, day, row_id, place. A source is
    its rows, the column of the day and that of the row's id, by which days that tie are ordered."""
    both = None
    for name, (rows, day, row_id) in sources.items():
        part = rows.select(F.lit(name).alias("source"), by, F.col(day).cast("date").alias("day"), F.col(row_id).cast("string").alias("row_id"))
        both = part if both is None else both.union(part)
    latest = Window.partitionBy("source", by).orderBy(F.desc_nulls_last("day"), "row_id")
    return both.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= n)


#: Composite of a name of which no block is known.
UNKNOWN = -999.0


def live_composite(live: DataFrame, z_of: dict[str, list[str]], least: int = 2) -> DataFrame:
    """Names above their long average, or without one, with the z-score of each factor of the blocks (``least`` names or
    more), the mean of each block's, and the mean of the blocks as composite: UNKNOWN where there is none."""
    rows = live.filter("coalesce(above_trend, true)").withColumn("month_ix", F.lit(0))
    for c in [c for cols in z_of.values() for c in cols]:
        rows = xsection.winsor_z(rows, c, f"z_{c}", by=("month_ix",), least=least)
    rows = xsection.composite(rows, {b: [f"z_{c}" for c in cols] for b, cols in z_of.items()}, {"composite": list(z_of)})
    return rows.withColumn("composite", F.coalesce("composite", F.lit(UNKNOWN)))
