"""Hashed word n-gram models: bucket counts of a target and of the raw corpus, and their log ratio per bucket.

Words and word pairs are hashed into BUCKETS buckets, whatever the corpus, so that a threshold on the ratio means the same
at every size and what is sent to the tasks (a number a bucket, 0.1 MB) doesn't grow. The raw counts cover every document,
those of the target every trusted document. Trusted ids are broadcast up to BROADCAST_ROWS, beyond that the join shuffles.
The two models are multinomials over the buckets, smoothed by SMOOTHING; their log ratio is an array with an entry per
bucket, made by Spark.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored

BUCKETS = 1 << 14
BROADCAST_ROWS = 200_000
SMOOTHING = 1.0
_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def bucket_of(*parts: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a word or of a pair; ``buckets`` is a power of two."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _following(words: Column) -> Column:
    return F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))


def gram_rows(rows: DataFrame, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The columns ``keep`` and a bucket, for each word of column words and each pair of neighbours."""
    pairs = rows.select(*keep, F.explode(F.arrays_zip(F.col("words").alias("a"), _following(F.col("words")).alias("b"))).alias("p"))
    pair = F.when(F.col("p.b").isNotNull(), bucket_of(F.col("p.a"), F.col("p.b"), buckets=buckets))
    return pairs.select(*keep, F.explode(F.array(bucket_of(F.col("p.a"), buckets=buckets), pair)).alias("bucket")).filter("bucket IS NOT NULL")


def trusted_ids(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored ids of all documents labelled good."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return stored(good.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "trusted")


def log_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of target to raw, by bucket; all zero without trusted documents."""
    good = trusted.withColumn("good", F.lit(1))
    if trusted.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left")
    grams = gram_rows(marked.select(F.coalesce("good", F.lit(0)).alias("good"), words_of(F.col("text")).alias("words")), ["good"], buckets)
    counts = stored(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")), "gram-counts")
    all_raw, all_target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not all_target:
        return [0] * buckets
    share = lambda n, total: (F.coalesce(n, F.lit(0)) + SMOOTHING) / F.lit(total + SMOOTHING * buckets)
    ratio = F.round(1000 * F.log(share("target", all_target) / share("raw", all_raw))).cast("int")
    rows = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", ratio.alias("ratio"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"])
    out = json.loads(rows.agg(F.to_json(listed)).first()[0])  # a number per bucket
    dropped(counts)
    return out


def mean_ratio(words: Column, ratio: list[int]) -> Column:
    """Mean log ratio over a text's n-grams; zero without words."""
    table = F.from_json(F.lit("[" + ",".join(map(str, ratio)) + "]"), "array<int>")  # folded to one constant
    value = lambda *parts: F.get(table, bucket_of(*parts, buckets=len(ratio)))
    each = F.zip_with(words, _following(words), lambda a, b: F.when(b.isNull(), value(a)).otherwise(value(a) + value(a, b)))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(F.size(words) > 0, total / (F.lit(1000.0) * (2 * F.size(words) - 1))).otherwise(F.lit(0.0))
