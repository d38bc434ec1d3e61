"""Notes and documents: chunks, embeddings, exact cosine top-k, evidence and company mentions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.functions.scalars import company_key, content_id
from tidemark.storage import stored

CHUNK, OVERLAP, DIMENSION = 400, 50, 384
#: Queries and corpus rows of a cell of the similarity matrix, about, and queries that are multiplied at a time.
QUERY_BLOCK, CORPUS_BLOCK, STRIP = 4_096, 16_384, 256
#: Keys of a dictionary that are sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
# Single words that are no company alone, and tickers whose names are everyday phrases.
COMMON_WORDS = (
    "target", "visa", "gap", "ball", "now", "key", "all", "it", "fast",
    "well", "dish", "host", "apple", "amp", "gen", "ceva", "match", "ally",
    "centene", "loews", "snap", "block", "paramount", "expedia", "american",
    "national", "united", "general", "first", "capital", "state", "live",
    "southern", "waters", "edison", "boston", "public", "global", "allstate",
    "best", "dollar", "tractor", "huntington", "western", "eastern", "union",
    "pool", "dover", "progressive", "mccormick",
)
SKIP_TICKERS = ("WM", "EXE")
# Texts of a site's menus.
MENU_TEXTS = ("Select Category", "Skip to")
# Beginnings of words that tell a negative stance.
NEGATIVE_CUES = r"(?i)\b(slam|slamm|attack|criticis|blast|threaten|tariff on|probe|sue|sued|ban)\w*"


def chunks(notes: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, path: str = "path", text: str = "text", title: str | None = None) -> DataFrame:
    """(path, idx, id, chunk): word windows of ``size`` that step by ``size - overlap``; a title goes before each."""
    step = size - overlap
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    held = notes.withColumn("_w", words).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - overlap - 1, F.lit(0)), F.lit(step))
    out = held.select(path, *([title] if title else []), F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("_w", s + 1, size), " "))).alias("idx", "chunk"))
    body = F.concat_ws("\n", F.col(title), F.col("chunk")) if title else F.col("chunk")
    return out.select(path, "idx", F.substring(F.sha2(F.concat_ws("#", F.col(path).cast("string"), F.col("idx").cast("string")), 256), 1, 16).alias("id"), body.alias("chunk"))


def tagged(notes: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    return notes.filter(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))))


def hashing_model(dimension: int = DIMENSION) -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic bag-of-words embedding, for tests and as the stand-in of a model: unit length, or zero. The first
    eight hex digits of a word's MD5 give its place, the ninth its sign."""

    def predict(texts: np.ndarray) -> np.ndarray:
        out, known = np.zeros((len(texts), dimension), np.float32), {}
        for row, t in zip(out, texts, strict=True):
            for w in (t or "").lower().split():
                if w not in known:
                    h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
                    known[w] = int(h[:8], 16) % dimension, 1 if h[8] < "8" else -1
                row[known[w][0]] += known[w][1]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    return predict


def embed(rows: DataFrame, text: str = "chunk", model: Callable[[], Callable[[np.ndarray], np.ndarray]] = hashing_model, batch: int = 512) -> DataFrame:
    """``rows`` with an embedding of each text (null: empty). ``model()`` loads the model, once per Python worker, and gives
    a function from an array of at most ``batch`` texts to one row of numbers each."""
    each = predict_batch_udf(model, return_type=ArrayType(FloatType()), batch_size=batch)
    return rows.withColumn("embedding", each(F.coalesce(text, F.lit(""))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Exact cosine top-k of every query: (query_id, id, similarity, place). ``corpus`` and ``queries`` have id and vec.

    Both sides are dealt to blocks by a hash, and a task multiplies a cell: one block of queries with one of the corpus,
    strip by strip, keeping k rows a query. So memory is bounded by the blocks, each side is copied once per block of the
    other, the plan has one size however many queries there are, and what is merged is k rows per query and corpus block.

    Defined results: rows without a vector take no part; a vector of zeros is similar to nothing (0); vectors of another
    length fail; ties go to the smaller id; repeated queries get their rows once each.
    """
    held, asked = corpus.select("id", "vec").filter("vec IS NOT NULL"), queries.select("id", "vec").filter("vec IS NOT NULL")
    blocks = lambda df, size: max(1, -(-df.count() // size))
    q, c = blocks(asked, query_block), blocks(held, corpus_block)
    # Both sides' numbers of blocks have one type: a cogroup hashes keys as they are, and an int is dealt otherwise than a long.
    deal = lambda df, n, m, own, other: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(asked, q, c, "qb", "cb").groupBy("qb", "cb"), deal(held, c, q, "cb", "qb").groupBy("qb", "cb")
    kinds = dict(asked.dtypes)["id"], dict(held.dtypes)["id"]
    found = left.cogroup(right).applyInArrow(_cell(k), f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).filter(F.col("place") <= k)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows of length one, or zero."""
    vec = column.combine_chunks()
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % len(vec) or len(set(np.diff(vec.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of several lengths")
    mat = flat.reshape(len(vec), -1)
    return mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-30)


def _cell(k: int):
    """The k nearest corpus rows of each query of a cell."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, own = asked["id"].to_numpy(), held["id"].to_numpy()
        out = []
        if len(ids) and len(own):
            mat, vec = _unit(asked["vec"]), _unit(held["vec"])
            if mat.shape[1] != vec.shape[1]:
                raise ValueError(f"queries of {mat.shape[1]} numbers and rows of {vec.shape[1]}")
            by_id = np.argsort(own, kind="stable")
            own, vec = own[by_id], vec[by_id]
            for at in range(0, len(ids), STRIP):
                sims = np.round(mat[at : at + STRIP] @ vec.T, 12)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # stable: equal ones by id
                rows = np.repeat(np.arange(len(sims)), best.shape[1])
                out.append((ids[at : at + STRIP][rows], own[best.ravel()], sims[rows, best.ravel()]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [ids[:0], own[:0], np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "similarity"), columns)))

    return run


def best_per_note(hits: DataFrame, notes: DataFrame, k: int) -> DataFrame:
    """The best chunk of each note, then the first k notes of each query. ``notes``: id, note."""
    by_note = Window.partitionBy("query_id", "note").orderBy(F.desc("similarity"), "id")
    best = hits.drop("place").join(notes, "id").withColumn("_n", F.row_number().over(by_note)).filter("_n = 1").drop("_n")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "note"))).filter(F.col("place") <= k)


def evidence_for(links: DataFrame, factor: str) -> DataFrame:
    """A factor's notes and wildcard ones, in order: own before wildcard, caveats first, then title."""
    held = links.filter(F.col("factor").isin(factor, "*"))
    caveat = (F.col("type") == "research-finding") & (F.coalesce(F.trim("verdict"), F.lit("")) != "")
    return held.withColumn("caveat", caveat).orderBy((F.col("factor") == "*").cast("int"), F.desc("caveat"), "title")


def caveats_for(links: DataFrame, factor: str) -> DataFrame:
    return links.filter((F.col("factor") == factor) & (F.col("type") == "research-finding") & (F.coalesce(F.trim("verdict"), F.lit("")) != ""))


def mention_keys(names: DataFrame, skip_tickers: tuple[str, ...] = SKIP_TICKERS, common_words: tuple[str, ...] = COMMON_WORDS, least_length: int = 4) -> DataFrame:
    """(ticker, words, pattern): what each company is looked for by. The legal suffix goes; a name of several words counts
    as the whole phrase, one of a single word only from ``least_length`` letters and if it is no common word."""
    core = F.lower(F.regexp_replace(company_key(F.col("name")), r"^[\s,.&]+|[\s,.&]+$", ""))
    tokens = F.filter(F.split(core, r"[\s,]+"), lambda w: w != "")
    held = names.select("ticker", tokens.alias("_t")).filter(~F.upper("ticker").isin(*skip_tickers) if skip_tickers else F.lit(True))
    single = (F.length(F.element_at("_t", 1)) >= least_length) & ~F.element_at("_t", 1).isin(*common_words)
    held = held.filter((F.size("_t") > 1) | ((F.size("_t") == 1) & single))
    quoted = F.array_join(F.transform("_t", lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), " ")
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), quoted, F.lit(r"($|[^\p{L}\p{N}_])"))
    words = _words(F.array_join("_t", " "))
    return held.select("ticker", words.alias("words"), pattern.alias("pattern")).filter(F.size("words") > 0).distinct()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ix, sentence) of texts whose white space is squeezed."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(flat, "([.!?]) ", "$1\n"), "\n")).alias("sentence_ix", "sentence"))


def mentions(docs: DataFrame, names: DataFrame, most_tickers: int = 8, quote: int = 280, skip_tickers: tuple[str, ...] = SKIP_TICKERS, common_words: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """(doc_id, ticker, sentence_ix, quote, stance): the first mention of each ticker in a document.

    Names are met through an index of anchors. The distinct words of each document that any name holds are its postings;
    a name's anchor is the one of its words that the fewest documents hold, and only documents with the anchor are read
    again, by sentence, for the name as it is written. So texts are split into words once, whatever the number of names
    and their lengths. Documents that mention more than ``most_tickers`` tickers are dropped, then mentions in a site's
    menus. The quote is the sentence, cut at ``quote`` characters.
    """
    keys = stored(mention_keys(names, skip_tickers, common_words).withColumn("key", F.monotonically_increasing_id()), "mention-keys")
    few = F.broadcast if keys.count() <= BROADCAST_ROWS else (lambda df: df)
    each = keys.select("key", F.explode(F.array_distinct("words")).alias("word"))
    words = docs.select("doc_id", F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("word"))
    postings = stored(words.join(few(each.select("word").distinct()), "word"), "name-words")
    rarity = postings.groupBy("word").agg(F.count("*").alias("_df"))
    # A word that no document holds is the rarest: a name with one is met nowhere, as no posting has it.
    anchors = each.join(rarity, "word", "left").groupBy("key").agg(F.min_by("word", F.struct(F.coalesce("_df", F.lit(0)), "word")).alias("word"))
    wanted = keys.join(anchors, "key").select("word", "ticker", "pattern")
    near = stored(postings.join(few(wanted), "word").select("doc_id", "ticker", "pattern", "word"), "mention-places")
    texts = _sentences(docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi")).withColumn("_low", F.lower("sentence"))
    said = near.join(texts, "doc_id").filter(F.contains("_low", F.col("word"))).filter(F.expr("regexp_like(_low, pattern)"))
    first = said.groupBy("doc_id", "ticker").agg(F.min(F.struct("sentence_ix", "sentence")).alias("m"))
    first = first.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).filter(F.col("_n") <= most_tickers)
    cut = F.substring("m.sentence", 1, quote)
    first = first.select("doc_id", "ticker", F.col("m.sentence_ix").alias("sentence_ix"), cut.alias("quote")).filter(~F.col("quote").rlike("|".join(MENU_TEXTS)))
    return first.withColumn("stance", F.when(F.col("quote").rlike(NEGATIVE_CUES), "negative").otherwise("positive"))


def first_per_day(rows: DataFrame) -> DataFrame:
    """One mention per ticker and day: that of the smallest document."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("ticker", "day").orderBy("doc_id"))).filter("_n = 1").drop("_n")


def mention_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", content_id(F.col("ticker"), F.col("speaker"), F.col("day"), F.col("url")))
