"""Token counts: an exact length histogram with suffix sums.

Documents are counted by encoded length; the histogram has a row per length, so it is bounded by the longest document
and not by the corpus. Suffix sums answer, for a context limit of each length and of each power of two: documents and
tokens in all, documents longer than the limit, their tokens, tokens kept and lost if every document is truncated at the
limit, and the share of documents that fit (so quantiles are read off: the smallest limit whose share is the wanted
one). The sums are taken in two levels: within blocks of lengths, then over the blocks' totals.

Defined results: a null or empty text has length zero; repeated rows count each time; an empty table gives rows for the
powers of two with zero counts. Columns besides ``text`` are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.tokens import default_path, encoder, parts_of

#: Lengths per block of the two-level sums.
BLOCK = 1024
LARGEST_POWER = 20


def encoded_length(text: Column, path: str | None = None) -> Column:
    file = path or default_path()

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lengths = [np.diff(encoder(file).encode(part, lengths_only=True)[1]) for part in parts_of(batch)]
            yield pa.array(np.concatenate(lengths) if lengths else [], pa.int64())

    return count(text)


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): one row per length, stored, so that no use of it tokenizes again."""
    return stored(docs.select(encoded_length(F.col("text"), path).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")


def context_report(histogram: DataFrame) -> DataFrame:
    """Per limit: limit, docs_at, docs_total, tokens_total, docs_over, tokens_over, tokens_kept, tokens_lost, share_fit."""
    spark = histogram.sparkSession
    powers = spark.range(LARGEST_POWER + 1).select(F.expr("shiftleft(1L, cast(id AS int))").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"))
    rows = histogram.union(powers).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    rows = rows.withColumn("n_sum", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    after = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("docs_in", F.coalesce(F.sum("n_docs").over(after), F.lit(0))).withColumn("tokens_in", F.coalesce(F.sum("n_sum").over(after), F.lit(0)))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_sum").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # over a row per block of lengths
    every = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"), F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total")
    )
    out = inner.join(blocks, "block").withColumn("docs_over", F.col("docs_in") + F.col("docs_after")).withColumn("tokens_over", F.col("tokens_in") + F.col("tokens_after"))
    lost = F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")
    share = F.when(F.col("docs_total") > 0, 1 - F.col("docs_over") / F.col("docs_total")).otherwise(F.lit(1.0))
    return out.select(
        F.col("n_tokens").alias("context_limit"), F.col("n_docs").alias("docs_at"), "docs_total", "tokens_total", "docs_over", "tokens_over",
        (F.col("tokens_total") - lost).alias("tokens_kept"), lost.alias("tokens_lost"), share.alias("share_fit"),
    )


def quantile_limits(report: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """(share, context_limit): the smallest limit at which that share of the documents fits whole."""
    each = report.select("context_limit", "share_fit", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    return each.filter(F.col("share_fit") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("context_limit").alias("context_limit"))
