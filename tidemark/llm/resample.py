"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A document's log weight is the log ratio of its probabilities by the target and by the raw model: the sum over its words
and word pairs. (``effective`` tempers it: the mean log ratio times so many n-grams.) Standard Gumbel noise, a hash of the document and the seed, is added; the k
largest sums are a sample without replacement in proportion to the weights. k is a share of the documents. The k-th
largest key is found by counting keys in ever narrower ranges, so nothing is sorted and the driver sees RANGES rows a
round.

Defined results: null and empty texts have log weight zero; keys that tie at the cut are all kept, repeated rows among
them; without trusted documents the sample is uniform; an empty table gives no rows. Columns besides ``doc_id`` and
``text`` are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, stored
from tidemark.llm.ngrams import log_ratio, mean_ratio, trusted_ids, words_of

SAMPLE_SHARE = 0.85
SEED = 17
RANGES = 1024


def gumbel(seed: int, *key: Column) -> Column:
    """Standard Gumbel noise from a hash: its top 52 bits as a number strictly between 0 and 1."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of column key; None if there are fewer."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n < k:
        return None
    above = 0
    while low < high:
        place = F.least(F.floor((F.col("key") - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        ranges = keys.filter(F.col("key").between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: -r["place"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float = SAMPLE_SHARE, seed: int = SEED, effective: float | None = None) -> DataFrame:
    """Per document: doc_id, log_weight, key, kept."""
    docs = docs.select("doc_id", "text")
    ratio = log_ratio(docs, trusted_ids(labels, docs))
    words = words_of(F.col("text"))
    weight = mean_ratio(words, ratio) * (F.greatest(2 * F.size(words) - 1, F.lit(0)) if effective is None else F.lit(float(effective)))
    keyed = docs.select(*row_key(), weight.alias("log_weight"))
    keyed = stored(keyed.withColumn("key", F.col("log_weight") + gumbel(seed, F.col("doc_id"), F.col("text_hash"))), "keys")
    cut = kth_largest(keyed, round(share * keyed.count()))
    return keyed.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(cut)).alias("kept") if cut is not None else F.lit(False).alias("kept"))
