"""Quality rules: counts over the whole text, and the length-normalised log ratio of hashed n-gram multinomials.

A document fails the base if it has fewer than LEAST_WORDS words or over REPEATED percent of its words in 3-word windows
that the text holds twice or more. Of the rest, those whose mean log ratio of the trusted-target to the raw-corpus model
is under THRESHOLD are dropped. DataFrame functions only.

Defined results: null and empty texts have no words and fail; lines count as repeated if equal to the letter; repeated
rows get equal results; without trusted documents the method's verdict is to keep. Columns besides ``doc_id`` and
``text`` are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngrams import log_ratio, mean_ratio, trusted_ids, words_of

LEAST_WORDS, REPEATED = 50, 50
THRESHOLD = -0.15
# Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]+"


def window_hashes(words: Column) -> Column:
    """Hashes of the 3-word windows, in order."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.transform(F.arrays_zip(*(F.slice(words, i + 1, n).alias(f"w{i}") for i in range(3))), lambda g: F.xxhash64(g["w0"], g["w1"], g["w2"]))


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Texts whose window hashes are all distinct are done at once. Else windows are sorted by hash and place; equal
    neighbours, compared by their words, are repeated. Of the places of such windows each covers three words, or as many
    as there are to the next place.
    """
    word = lambda s, k: F.get(words, s["at"] + k)
    same = lambda a, b: (a["h"] == b["h"]) & (word(a, 0) == word(b, 0)) & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2))
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    twins = _once(order, lambda o: F.zip_with(o, F.slice(o, 2, F.size(o)), lambda a, b: F.when(same(a, b), F.array(a["at"], b["at"]))))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda p: p.isNotNull()))))
    widths = _once(places, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))))
    covered = F.aggregate(widths, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0)).cast("long")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def base_columns(text: Column, words: Column, hashes: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words, hashes),
    }


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, the five counts, base_failed, log_ratio, kept."""
    docs = docs.select("doc_id", "text")
    ratio = log_ratio(docs, trusted_ids(labels, docs))
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"))
    split = split.withColumn("hashes", window_hashes(F.col("words")))
    out = split.select("doc_id", *(c.alias(k) for k, c in base_columns(F.col("text"), F.col("words"), F.col("hashes")).items()), mean_ratio(F.col("words"), ratio).alias("log_ratio"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
