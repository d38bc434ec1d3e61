"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

An entry is a host, a path and a verdict; it fits its host and all subdomains, if the URL's path starts with the entry's.
Rules are held against a URL's host and path as they are written; listed entries, and URLs for them, in canonical form:
without user, port and the root's dot in the host, with a path of ``/`` for none, and with only those characters
percent-encoded that need it. A URL's keys are its host suffixes with the prefixes of its path, at the lengths that
entries' paths have. The filter has blocks of 512 bits; a key sets or tests BITS_PER_KEY bits of one block. It is built by
an aggregate over the list and is BLOCKS blocks at most, so it may be sent to every task whatever the list's size; a full
filter only passes more keys. Passed keys are joined to the list itself, so false positives fall out. Of several entries
the longest wins (host and path together; then the longer host; then block). Rules go before the list: the list's verdict,
which is to block, holds where no rule fits. URLs without an entry are allowed.

Defined results: a null url, or one without ``://``, has an empty host and path and so no entry; repeated rows get equal
results; an entry listed twice with different verdicts blocks. Columns besides ``page_id`` and ``url`` are neither read
nor changed.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

BLOCK_WORDS, BITS_PER_KEY = 8, 8
#: Blocks of the filter at most: 4 MiB.
BLOCKS = 1 << 16
KEYS_PER_BLOCK = 40
# The production list.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


# Listed sites, under each of the top-level domains served.
LISTED = tuple((f"{site}.example.{top}", "/", "block") for site in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def entries(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES, listed: tuple[tuple[str, str, str], ...] = LISTED) -> DataFrame:
    rows = [(*r, True) for r in rules] + [(*r, False) for r in listed]
    return spark.createDataFrame(rows, "host string, path string, verdict string, is_rule boolean")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    """Without user, port and the root's dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def canonical_path(path: Column) -> Column:
    """``/`` for none; unreserved characters as they are, other percent codes in upper case."""

    def decoded(piece: Column) -> Column:
        code = F.substring(piece, 1, 2)
        char = F.chr(F.conv(code, 16, 10).cast("long"))
        plain = F.when(char.rlike(r"^[A-Za-z0-9._~-]$"), char).otherwise(F.concat(F.lit("%"), F.upper(code)))
        return F.when(code.rlike("^[0-9A-Fa-f]{2}$"), F.concat(plain, F.substring(piece, F.lit(3), F.length(piece)))).otherwise(F.concat(F.lit("%"), piece))

    pieces = F.split(path, "%")
    encoded = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))
    return F.when(path == "", "/").when(path.contains("%"), encoded).otherwise(path)


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """A key's block, and the places of its bits in the block."""
    return F.xxhash64(F.lit("block"), key), [F.pmod(F.xxhash64(F.lit(i), key), F.lit(64 * BLOCK_WORDS)) for i in range(BITS_PER_KEY)]


class BlockedBloom:
    """Bits as a table of blocks by words."""

    def __init__(self, keys: DataFrame, most: int = BLOCKS):
        """``keys`` has column key."""
        n = keys.count()
        self.blocks = min(most, max(1, 1 << max(0, (n // KEYS_PER_BLOCK)).bit_length()))
        block, bits = _bits(F.col("key"))
        spread = keys.select(F.pmod(block, F.lit(self.blocks)).alias("block"), F.explode(F.array(*bits)).alias("bit"))
        word = F.floor(F.col("bit") / 64)
        spread = spread.groupBy("block", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("set"))
        self.table = np.zeros((self.blocks, BLOCK_WORDS), np.int64)
        found = spread.toArrow()  # at most ``blocks`` times BLOCK_WORDS rows, as three arrays
        self.table[found["block"].to_numpy(), found["word"].to_numpy()] = found["set"].to_numpy()

    def may_hold(self, key: Column) -> Column:
        table, blocks = self.table, self.blocks

        @F.pandas_udf("boolean")
        def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for block, bits in batches:
                if not len(block):
                    yield pd.Series([], dtype=bool)
                    continue
                at = np.stack(bits.to_numpy()).astype(np.int64)
                words = table[(block.to_numpy() % blocks)[:, None], at >> 6]
                yield pd.Series(((words >> (at & 63)) & 1).all(axis=1))

        block, bits = _bits(key)
        return test(F.pmod(block, F.lit(self.blocks)), F.array(*bits))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)  # a host holds no slash, so this is one-to-one where paths start with one


def _keys(sites: DataFrame, host: str, path: str, lengths: list[int], is_rule: bool) -> DataFrame:
    """host, path and every suffix and prefix of the columns ``host`` and ``path`` that an entry could be."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    spread = sites.select("host", "path", path, F.explode(suffixes).alias("suffix"))
    return spread.select("host", "path", F.lit(is_rule).alias("is_rule"), "suffix", F.explode(prefixes).alias("prefix"))


def judge_urls(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule (null where no rule fits), verdict. ``entries``: host, path, verdict, is_rule."""
    listed_host = F.when(F.col("is_rule"), F.col("host")).otherwise(canonical_host(F.translate("host", string.ascii_uppercase, string.ascii_lowercase)))
    listed_path = F.when(F.col("is_rule"), F.col("path")).otherwise(canonical_path(F.col("path")))
    entries = entries.select(listed_host.alias("host"), listed_path.alias("path"), "is_rule", "verdict")
    entries = stored(entries.groupBy("host", "path", "is_rule").agg(F.max("verdict").alias("verdict")), "entries")  # 'block' sorts after 'allow'
    lengths = {r: [] for r in (True, False)}
    for r in entries.select("is_rule", F.length("path").alias("n")).distinct().orderBy("n").collect():  # at most the longest URL's length
        lengths[r["is_rule"]].append(r["n"])
    bloom = BlockedBloom(entries.select(_key(F.col("host"), F.col("path")).alias("key")).distinct())
    page = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    sites = page.select("host", "path").distinct().withColumn("own_host", canonical_host(F.col("host"))).withColumn("own_path", canonical_path(F.col("path")))
    every = [(sites.withColumns({"a_host": F.col(host), "a_path": F.col(path)}), rule) for host, path, rule in (("host", "path", True), ("own_host", "own_path", False)) if lengths[rule]]
    parts = [_keys(rows, "a_host", "a_path", lengths[rule], rule) for rows, rule in every]
    if not parts:
        return page.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    passed = keys.filter(bloom.may_hold(_key(F.col("suffix"), F.col("prefix"))))
    exact = passed.join(entries.withColumnsRenamed({"host": "suffix", "path": "prefix"}), ["suffix", "prefix", "is_rule"])
    weight = F.struct("is_rule", F.length("suffix") + F.length("prefix"), F.length("suffix"), "verdict")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.when(F.col("is_rule"), _key(F.col("suffix"), F.col("prefix"))).alias("rule"), "verdict"), weight).alias("best"))
    out = page.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
