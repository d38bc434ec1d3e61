"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint has a bit set if over half of the XXH64 hashes of the text's 3-word shingles have it. Two fingerprints link
at RADIUS = 3 or fewer differing bits. Half of that radius is one and a half, so the search has two steps:

* **Ball step, two bits or fewer.** Every distinct fingerprint emits itself and its 64 variants at one bit. Fingerprints
  that meet in a variant are within one bit of it, so they all link: at most 65 distinct ones can meet, and each is tied
  to the smallest. No pair needs to be verified.
* **Odd-bit step, exactly three bits.** Such pairs have one fingerprint of even and one of odd parity. The bits are
  dealt into three blocks. Either two of the differing bits fall into one block - masked by that block the pair is
  within one bit, so the even side emits its masked self and the odd side all masked variants within one bit - or each
  block has one: masked by the first block, the even side emits its variants in the second block, the odd side its
  variants in the third, and they meet in the middle. Only buckets that join different classes of the first step are
  kept, and their even-odd pairs are verified by the count of differing bits.

So a group of thousands of near copies costs a variant list per distinct fingerprint, not a row per pair.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and link like any other; fewer than
three words are one shingle; repeated rows give repeated results; the class of a group whose ids are all null is null.
Columns besides ``doc_id`` and ``text`` are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import fresh, row_key, stored
from tidemark.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 64
#: The bits of the three blocks of the odd-bit step.
BLOCKS = (range(0, 22), range(22, 43), range(43, 64))
_CHUNK = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, _CHUNK):
        size = min(_CHUNK, n - start)
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s, _ in zip(shingles, range(size), strict=False)), np.dtype("<u8"), size)
        ones += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("long")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")

    return each(text)


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def _mask(blocks: tuple[range, ...]) -> int:
    m = sum(1 << i for b in blocks for i in b)
    return m if m < 1 << 63 else m - (1 << 64)


def _flips(value: Column, bits: range) -> list[Column]:
    return [value.bitwiseXOR(F.lit(_bit(i))) for i in bits]


def close_links(prints: DataFrame) -> DataFrame:
    """Ball step: (u, v) for fingerprints at two bits or fewer, each tied to the smallest that shares a variant."""
    f = F.col("fp")
    near = prints.select("fp", F.explode(F.array(f, *_flips(f, range(BITS)))).alias("variant"))
    near = near.withColumn("hub", F.min("fp").over(Window.partitionBy("variant")))
    return near.filter("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def odd_links(prints: DataFrame) -> DataFrame:
    """Odd-bit step: (u, v) of classes that have fingerprints at exactly three bits; ``prints`` has fp and class."""
    f, odd = F.col("fp"), F.bit_count("fp") % 2 == 1
    evens, odds = [], []
    for tag, block in enumerate(BLOCKS):
        rest = tuple(b for b in BLOCKS if b is not block)
        seen = f.bitwiseAND(F.lit(_mask(rest)))
        key = lambda x, tag=tag: F.struct(F.lit(tag).cast("byte").alias("tag"), x.alias("key"))
        evens.append(key(seen))
        odds += [key(seen), *(key(x) for b in rest for x in _flips(seen, b))]
    seen = f.bitwiseAND(F.lit(_mask(BLOCKS[1:])))
    key = lambda x: F.struct(F.lit(3).cast("byte").alias("tag"), x.alias("key"))
    evens += [key(x) for x in _flips(seen, BLOCKS[1])]
    odds += [key(x) for x in _flips(seen, BLOCKS[2])]
    spread = lambda side, keys: side.select("fp", "class", F.explode(F.array(*keys)).alias("k"))
    met = spread(prints.filter(~odd), evens).union(spread(prints.filter(odd), odds)).select("fp", "class", "k.tag", "k.key")
    bucket = Window.partitionBy("tag", "key")
    met = met.withColumn("low", F.min("class").over(bucket)).withColumn("high", F.max("class").over(bucket)).filter("low <> high")
    met = stored(met.select("tag", "key", "fp", "class").distinct(), "buckets")
    a = met.filter(~odd).select("tag", "key", F.col("fp").alias("fp_a"), F.col("class").alias("u"))
    b = met.filter(odd).select("tag", "key", F.col("fp").alias("fp_b"), F.col("class").alias("v"))
    close = (F.col("u") != F.col("v")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 3)
    return a.join(b, ["tag", "key"]).filter(close).select("u", "v").distinct()


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """(fp, class) for the distinct fingerprints ``prints`` (fp): class is the smallest fingerprint reachable by links."""
    first = stored(_relabel(prints, components(close_links(prints)), "fp"), "classes")
    return _relabel(first, components(odd_links(first)), "class").select("fp", "class")


def _relabel(rows: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    return rows.join(roots, rows[by] == roots["node"], "left").select("fp", F.coalesce("root", by).alias("class"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, text_hash, fp) rows, and (fp, class)."""
    prints = stored(docs.select(*row_key(), fingerprint(F.col("text")).alias("fp")), "fingerprints")
    return prints, fingerprint_classes(stored(prints.select("fp").distinct(), "distinct-prints"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints, classes = _classes(docs)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = stored(firsts.join(classes, "fp"), "members")
    named = member.join(member.groupBy("class").agg(F.min("first").alias("component_id")), "class").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest doc_id, of texts that share it that of the smallest
    hash; a row without an id stays where no row of its class has one. Of equal rows one stays. Same columns."""
    prints, classes = _classes(docs)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    firsts = prints.groupBy("fp").agg(F.min(row).alias("first")).join(classes, "fp").groupBy("class").agg(F.min("first").alias("first"))
    an_id, a_hash = fresh(docs, "kept_id", "kept_hash")
    keep = firsts.select(F.col("first.doc_id").alias(an_id), F.col("first.text_hash").alias(a_hash))
    (own,) = fresh(docs, "own_hash")
    keyed = docs.withColumn(own, row_key()[1])
    held = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col(an_id)) & (F.col(own) == F.col(a_hash)), "left_semi")
    return held.dropDuplicates(["doc_id", own]).select(*docs.columns)
