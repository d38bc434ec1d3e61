"""Phrase collocations by set-oriented mining over sorted occurrence relations.

A relation holds the occurrences of all frequent phrases of one length: (piece, pos, id). The relation of the next length
is the merge-join of a relation with itself by piece and adjacent position: two frequent phrases that begin one word apart
make one that is a word longer. Its groups are counted, the frequent ones get ids, and only their occurrences stay (a
semi-join) before the next length. Relations are persisted in buckets by piece, sorted by piece and position, so a
merge-join reads them without a shuffle; what is shuffled per length is group counts, combined before.

Frequent phrases are joined to occurrences by a broadcast while they are at most BROADCAST_ROWS, which is counted, and by
a shuffle beyond it, in which a very common phrase's partition is split by adaptive execution.

Defined results: a null text has no words; a null lang is ``und``; pieces without words count for nothing; repeated rows
count as often as they occur; an empty table gives no rows. Columns besides ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

import string
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored
from tidemark.storage import bucketed

LEAST, LONGEST, TOP = 100, 5, 2000
BROADCAST_ROWS = 200_000
#: A longer candidate with this percentage of a phrase's occurrences takes its place.
ABSORBED = 100
_PIECES, _WORDS = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"


def words(docs: DataFrame) -> DataFrame:
    """(lang, piece, pos, word) of every word; pieces have numbers of their own."""
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    pieces = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(lowered, _PIECES)).alias("of"))
    pieces = pieces.select("lang", F.monotonically_increasing_id().alias("piece"), "of")  # before the words are spread
    return pieces.select("lang", "piece", F.posexplode(F.array_remove(F.split("of", r"[\x20\x09]+"), "")).alias("pos", "word"))


@contextmanager
def _joins_by_bucket(spark: SparkSession):
    """Relations are dealt by piece and joined by piece and position; the piece alone is enough to bring them together."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _relation(rows: DataFrame, label: str, dealt: bool) -> DataFrame:
    """Persisted occurrences, in as many buckets as a shuffle has partitions. ``dealt``: the rows come by piece already."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows if dealt else rows.repartition(n, "piece"), f"{label}_{uuid.uuid4().hex}", n, "piece", ["piece", "pos"])


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): every phrase of up to ``longest`` words that occurs ``least`` times (lang, phrase, size, f), and
    the number of words of each lang (lang, n)."""
    counts = stored(words(docs).groupBy("lang", "word").count(), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("count").alias("n"))
    columns = ["id", "lang", "phrase", "last", "size", "f"]
    level = counts.filter(F.col("count") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.lit(1).alias("size"), F.col("count").alias("f"))
    level = stored(level, "phrases-1")
    found, n = level, level.count()
    with _joins_by_bucket(docs.sparkSession):
        named = _few(level.select("id", "lang", F.col("phrase").alias("word")), n)
        relation = _relation(words(docs).join(named, ["lang", "word"]).select("piece", "pos", "id"), "occurrences_1", False)
        for size in range(2, longest + 1):
            if not n:
                break
            a = relation.select("piece", "pos", F.col("id").alias("a"))
            b = relation.select("piece", (F.col("pos") - 1).alias("pos"), F.col("id").alias("b"))
            pairs = a.join(b.hint("merge"), ["piece", "pos"])
            groups = pairs.groupBy("a", "b").count().filter(F.col("count") >= least)
            groups = stored(groups.select(F.monotonically_increasing_id().alias("id"), "a", "b", F.col("count").alias("f")), f"groups-{size}")
            n = groups.count()
            heads, tails = level.select(F.col("id").alias("a"), "lang", "phrase"), level.select(F.col("id").alias("b"), "last")
            level = groups.join(heads, "a").join(tails, "b").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.lit(size).alias("size"), "f")
            level = stored(level, f"phrases-{size}")
            found = found.union(level)
            if size < longest and n:
                held = pairs.join(_few(groups.select("a", "b", "id"), n), ["a", "b"]).select("piece", "pos", "id")
                later = _relation(held, f"occurrences_{size}", n <= BROADCAST_ROWS)
                dropped(relation)
                relation = later
            dropped(groups)
    dropped(relation)
    return found.select(*columns[1:3], "size", "f"), totals


def _part(words_: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words_, start, length), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a, l, r, n, score): of a phrase's cuts the one of the lowest score, of equal ones
    the first. Products are decimals of 38 digits."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _part(F.col("_w"), 1, F.col("k"))).withColumn("rest", _part(F.col("_w"), F.col("k") + 1, F.col("size") - F.col("k"))).drop("_w")
    known = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    product = (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(19,0)")).cast("decimal(38,0)") * exact("n")
    cuts = cuts.withColumn("_up", product.cast("decimal(38,0)")).withColumn("_down", (exact("l") * exact("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("_up div _down"))
    best = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "size", "a", "c.l", "c.r", "n", "c.score")


def maximal(candidates: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """``candidates`` without those that lie inside a longer one with ``absorbed`` percent of their occurrences."""
    w = F.split("phrase", " ")
    lengths = F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("size") - 1))
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    longer = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("_longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    both = candidates.join(most, ["lang", "phrase"], "left")
    return both.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < absorbed * F.col("a"))).drop("_longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Per lang the first ``top`` candidates: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent(docs, least, longest)
    candidates = stored(scored(phrases, totals), "candidates")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = maximal(candidates).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # tasks keep their own first ``top`` before the shuffle
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
