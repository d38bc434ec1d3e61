"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is WINDOW consecutive words of an item, or a whole shorter item; it is a sequence of shingles of up to SHINGLE
words. The documents are read once for the places of benchmark shingles (the postings). Shingles are then ordered by how
rare they are among the postings. A document that holds a window holds its rarest shingle, so that one is the window's
necessary prefix: only postings of it are candidates. The place of the prefix in the window gives the only start the
window can have; starts before the document, or too near its end, are out (positional and length bound). A candidate is
verified exactly: the window's first and last shingle must stand at its two ends, and where a window is longer than the
two together, every shingle-th one between them, so that each word is compared.

The benchmark's shingles are broadcast while they are at most BROADCAST_ROWS, which is counted; beyond it the join
shuffles. Words are compared as strings, not by hash alone.

Defined results: null and empty texts have no words and no hits; an item without words has no window; items with equal
windows are all found; items that share an item_id are told apart by their rows and count as one id; the windows of an
item without an item_id are hit, and it counts among no items; repeated rows get equal results; rows that share a doc_id
but not a text are told apart.
Columns besides ``doc_id``, ``text``, ``item_id`` are neither read nor changed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, row_key, stored

WINDOW, SHINGLE = 10, 5
BROADCAST_ROWS = 500_000
#: What stands between words once A-Z are lowered.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _shingles(rows: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """``rows`` has words; per place of ``size`` words: the columns ``keep``, pos, shingle and its hash."""
    n = F.size("words")
    shifted = [F.slice("words", i + 1, F.greatest(n - i, F.lit(0))).alias(f"w{i}") for i in range(size)]
    places = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    parts = [F.col(f"w.w{i}") for i in range(size)]
    return places.filter(parts[-1].isNotNull()).select(*keep, "pos", F.xxhash64(*parts).alias("h"), F.concat_ws(" ", *parts).alias("shingle"))


def _windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Stored shingles (sid, size, h, shingle); places of them in windows (item, item_id, start, len, o, last, sid); sizes."""
    items = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).withColumn("n", F.size("words"))
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")  # a number for each row, as items can share an id
    size = F.least(F.col("n"), F.lit(shingle))
    sizes = sorted(r[0] for r in items.select(size.alias("k")).distinct().collect())  # at most ``shingle`` numbers
    found = None
    for k in sizes:
        part = _shingles(items.filter(size == k), k, ["item", "item_id", "n"]).withColumn("size", F.lit(k))
        found = part if found is None else found.union(part)
    if found is None:
        return items, items, []
    places = stored(found, "item-shingles")
    ids = stored(places.select("size", "h", "shingle").distinct().withColumn("sid", F.monotonically_increasing_id()), "shingle-ids")
    length = F.least(F.col("n"), F.lit(window))
    inside = places.join(ids, ["size", "h", "shingle"]).withColumn("len", length)
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - (F.col("len") - F.col("size"))), F.least("pos", F.col("n") - F.col("len")))
    inside = inside.withColumn("start", F.explode(starts)).select("item", "item_id", "start", "len", (F.col("pos") - F.col("start")).alias("o"), (F.col("len") - F.col("size")).alias("last"), "sid")
    return ids, inside, sizes


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per occurrence of a window: doc_id, text_hash, start, len, item_id."""
    ids, inside, sizes = _windows(items, window, shingle)
    keyed = docs.select(*row_key(), words_of(F.col("text")).alias("words"))
    if not sizes:
        return keyed.filter("false").select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("item_id"))
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    n_ids = ids.count()
    found = None
    for k in sizes:
        known = small(ids.filter(F.col("size") == k).select("sid", "h", F.col("shingle").alias("of")), n_ids)
        part = _shingles(keyed.withColumn("n", F.size("words")), k, ["doc_id", "text_hash", "n"]).join(known, "h").filter("shingle = of").select("doc_id", "text_hash", "n", "pos", "sid")
        found = part if found is None else found.union(part)
    postings = stored(found, "postings")
    rarity = postings.groupBy("sid").count()
    order = F.struct(F.coalesce("count", F.lit(0)), "o")
    middle = {f"middle_{o}": F.max(F.when((F.col("o") == o) & (F.col("last") > o), F.col("sid"))) for o in range(shingle, window - shingle, shingle)}
    ranked = inside.join(rarity, "sid", "left").groupBy("item", "item_id", "start").agg(
        F.min_by(F.struct("sid", "o"), order).alias("prefix"), F.min_by("sid", "o").alias("first"), F.max_by("sid", "o").alias("end"), F.first("len").alias("len"), F.first("last").alias("last"),
        *(c.alias(name) for name, c in middle.items()),
    )
    ranked = stored(ranked.select("item_id", "first", "end", "len", "last", F.col("prefix.sid").alias("sid"), F.col("prefix.o").alias("o"), *middle).distinct(), "windows")
    start = F.col("pos") - F.col("o")
    bounded = (start >= 0) & (start + F.col("len") <= F.col("n"))
    found = postings.join(small(ranked, ranked.count()), "sid").filter(bounded).select("doc_id", "text_hash", start.alias("start"), "len", "item_id", "first", "end", (start + F.col("last")).alias("stop"), *middle)
    place = lambda pos, sid: postings.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("pos").alias(pos), F.col("sid").alias(sid)).distinct()
    same = lambda p: F.col("doc_id").eqNullSafe(p["d"]) & (F.col("text_hash") == p["t"])
    p, q = place("start_at", "first_is"), place("stop_at", "end_is")
    found = found.join(p, same(p) & (F.col("start") == p["start_at"]) & (F.col("first") == p["first_is"]), "left_semi")
    found = found.join(q, same(q) & (F.col("stop") == q["stop_at"]) & (F.col("end") == q["end_is"]), "left_semi")
    for name in middle:
        p = place("middle_at", "middle_is")
        at = F.col("start") + int(name.removeprefix("middle_"))
        long = found.filter(F.col(name).isNotNull()).join(p, same(p) & (at == p["middle_at"]) & (F.col(name) == p["middle_is"]), "left_semi")
        found = found.filter(F.col(name).isNull()).union(long)
    return found.select("doc_id", "text_hash", "start", "len", "item_id").distinct()


def hits_by_document(found: DataFrame) -> DataFrame:
    """Per document with occurrences: n_hit (words inside any), n_items, items (sorted as strings, comma-joined)."""
    stop = F.col("start") + F.col("len")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", stop, "item_id").rowsBetween(Window.unboundedPreceding, -1)
    new = found.withColumn("new", F.greatest(F.lit(0), stop - F.greatest("start", F.coalesce(F.max(stop).over(before), F.lit(0)))))
    items = F.array_sort(F.collect_set(F.col("item_id").cast("string")))  # an item counts once, so at most the benchmark's items
    return new.groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"), items.alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    hits = hits_by_document(occurrences(docs, items, window, shingle)).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    every = docs.select(*row_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; same columns."""
    an_id, a_hash, own = fresh(docs, "hit_id", "hit_hash", "own_hash")
    found = occurrences(docs.select("doc_id", "text"), items, window, shingle).select(F.col("doc_id").alias(an_id), F.col("text_hash").alias(a_hash)).distinct()
    keyed = docs.withColumn(own, row_key()[1])
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col(an_id)) & (F.col(own) == F.col(a_hash)), "left_anti").select(*docs.columns)
