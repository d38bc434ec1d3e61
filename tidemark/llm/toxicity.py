"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a learned lexicon (words and stems, two tiers), lexicon words near second-person
words, second-person words, capitals, shouted words, punctuation and its runs, symbols, digits, and obfuscated spellings.
The lexicon, the trees and the calibration are fitted on a bounded sample of labelled rows; every text is scored whole.

Defined results: a null or empty text has all features zero and is scored like any other; a row of ``labels`` with a
null id or label is left out, and a document labelled twice counts as toxic if one of its labels says so; without labels
of both kinds every score is the share of toxic labels (zero without any). Repeated rows get equal scores. Columns of
the input besides ``doc_id`` and ``text`` are neither read nor changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, stored

#: Labelled rows that the lexicon and the trees are fitted on, at most: those whose ids have the smallest hashes.
TRAINING_ROWS = 12_000
#: Entries of each tier of the lexicon, at most, and the labelled documents that a word must be in, at least.
LEXICON_WORDS, LEXICON_SUPPORT = 400, 5
TREES, DEPTH = 20, 4
REJECT_AT = 0.7

# Second-person words of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer eure usted ustedes tus vosotros vuestro".split())
# Characters that stand for letters in obfuscated spellings.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

#: Lengths of word stems that the lexicon may hold beside whole words.
STEMS = (3, 4, 5, 6, 7)

FEATURES = (
    "strong_density", "strong_count", "strong_distinct", "weak_density", "near_second_person", "second_person", "capitals", "shouted",
    "exclaiming", "punctuation", "punctuation_runs", "symbols", "digits", "obfuscated", "obfuscated_hits", "length",
)

_WORD = re.compile(r"[^\W\d_]+")
_SHOUTED = re.compile(r"[A-Z]{3,}")
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$*]+(?=[^\W\d_])")
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][.\-_]){2,}[^\W\d_](?![^\W\d_])")
_LETTERS = str.maketrans(LOOKALIKE)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"'(),-.:;?[]{}")] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+/<=>@\\^_`|~")] = True


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STAND_IN, _SEPARATOR = np.zeros(256, bool), np.zeros(256, bool)
_STAND_IN[list(b"013457@$*")] = True
_SEPARATOR[list(b".-_")] = True


class Lexicon:
    """Terms are words, or ``abc*`` for every longer word that starts so."""

    def __init__(self, terms: list[str]):
        self.words = frozenset(t for t in terms if not t.endswith("*"))
        self.stems = [(n, frozenset(t[:-1] for t in terms if t.endswith("*") and len(t) == n + 1)) for n in STEMS]
        self.stems = [(n, held) for n, held in self.stems if held]

    def __contains__(self, word: str) -> bool:
        return word in self.words or any(word[:n] in held and len(word) > n for n, held in self.stems)

    def of(self, words: set[str]) -> set[str]:
        found = words & self.words
        for n, held in self.stems:
            found.update(w for w in words if w[:n] in held and len(w) > n)
        return found


def _disguised(text: str, raw: np.ndarray) -> list[str]:
    """Words that are spelled with look-alikes, masked letters or separators, undone as far as can be. The patterns run
    only on texts whose bytes have such a place."""
    letter, stand_in, separator = _LETTER[raw], _STAND_IN[raw], _SEPARATOR[raw]
    spelled = (letter[:-2] & separator[1:-1] & letter[2:]).any()
    inside = (letter[:-1] & stand_in[1:]).any() and (stand_in[:-1] & letter[1:]).any()
    out = [m[0].translate(str.maketrans("", "", ".-_")) for m in _SPELLED.finditer(text)] if spelled else []
    for m in _INSIDE.finditer(text) if inside else ():
        a, b = m.start(), m.end()
        while a and (text[a - 1].isalpha() or text[a - 1] in "013457@$*"):
            a -= 1
        while b < len(text) and (text[b].isalpha() or text[b] in "013457@$*"):
            b += 1
        out.append(text[a:b].translate(_LETTERS).replace("*", ""))
    return [w.lower() for w in out]


def features_of(text: str | None, strong: Lexicon, weak: Lexicon, reach: int = 5) -> list[float]:
    """The dense features of one text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    words = _WORD.findall(text.lower())
    n, size, distinct = max(len(words), 1), len(raw), set(words)
    bad, addressed, doubtful = strong.of(distinct), distinct & SECOND_PERSON, weak.of(distinct)
    at = [i for i, w in enumerate(words) if w in bad] if bad else []
    you = [i for i, w in enumerate(words) if w in addressed] if addressed else []
    near = 0
    if at and you:
        spots = np.asarray(you)
        k = np.searchsorted(spots, at)
        gap = np.minimum(np.abs(spots[np.minimum(k, len(spots) - 1)] - at), np.abs(spots[np.maximum(k - 1, 0)] - at))
        near = int((gap <= reach).sum())
    marks, shouted, disguised = _PUNCTUATION[raw], _SHOUTED.findall(text), _disguised(text, raw)
    return [
        len(at) / n, float(np.log1p(len(at))), float(len(bad)), sum(w in doubtful for w in words) / n if doubtful else 0.0, near / n, len(you) / n,
        float(((raw >= 65) & (raw <= 90)).mean()), len(shouted) / n, float(((raw == 33) | (raw == 63)).mean()), float(marks.mean()),
        float((marks[1:] & marks[:-1]).mean()) if size > 1 else 0.0, float(_SYMBOLS[raw].mean()), float(((raw >= 48) & (raw <= 57)).mean()),
        len(disguised) / n, sum(w in strong for w in disguised) / n, float(np.log1p(n)),
    ]


def feature_column(text: Column, strong: list[str], weak: list[str]) -> Column:
    tiers = Lexicon(strong), Lexicon(weak)

    @F.pandas_udf("array<double>")
    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features_of(t, *tiers) for t in batch])

    return dense(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class ToxicityModel:
    strong: list[str]
    weak: list[str]
    trees: GBTClassificationModel | None
    calibration: object | None
    base_rate: float

    def score(self, docs: DataFrame, name: str) -> DataFrame:
        """``docs`` and a column ``name``: calibrated probability; within a step of the calibration the trees' own order."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.base_rate))
        feats, vec, raw, prob, pred, own, iso = fresh(docs, "tox_feats", "tox_vec", "tox_raw", "tox_prob", "tox_pred", "tox_own", "tox_iso")
        trees = self.trees.copy().setFeaturesCol(vec).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
        out = docs.withColumn(feats, feature_column(F.col("text"), self.strong, self.weak)).withColumn(vec, array_to_vector(F.col(feats)))
        out = trees.transform(out).withColumn(own, vector_to_array(F.col(prob))[1])
        out = self.calibration.copy().setFeaturesCol(own).setPredictionCol(iso).transform(out)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(iso) + (F.col(own) - 0.5) * 1e-4))
        return out.withColumn(name, score).drop(feats, vec, raw, prob, pred, own, iso)


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems whose share of toxic documents is highest, in two tiers; ``sample`` has text and toxic."""
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).filter(F.length("w") >= 2)
    stems = F.array(F.col("w"), *(F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in STEMS))
    words = words.select("toxic", F.explode(stems).alias("word")).filter("word IS NOT NULL")
    held = words.groupBy("word").agg(F.sum("toxic").alias("yes"), F.count("*").alias("n")).filter(F.col("yes") >= LEXICON_SUPPORT)
    share = F.col("yes") / F.col("n")
    total = sample.agg(F.avg("toxic")).first()[0] or 0.0
    z = (F.col("yes") - F.col("n") * total) / F.sqrt(F.col("n") * total * (1 - total) + 1)
    ranked = held.select("word", share.alias("share"), z.alias("z")).filter(F.col("z") > 3)
    strong = [r[0] for r in ranked.filter(F.col("share") >= 0.5).orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).collect()]
    weak = [r[0] for r in ranked.filter(F.col("share") < 0.5).orderBy(F.desc("z"), "word").limit(LEXICON_WORDS).collect()]
    return strong, weak


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents that aren't held out; a quarter of them only calibrates."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
    picked = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = stored(picked, "toxic-ids")  # at most ``rows`` ids, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = stored(texts.dropDuplicates(["doc_id"]), "toxic-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
    counts = sample.groupBy("toxic").count().collect()
    total, toxic = sum(r["count"] for r in counts), sum(r["count"] for r in counts if r["toxic"] > 0)
    if not 0 < toxic < total:
        return ToxicityModel([], [], None, None, toxic / total if total else 0.0)
    strong, weak = learn_lexicon(sample.filter(part != 0))
    ready = sample.select("doc_id", F.col("toxic").alias("label"), part.alias("part"), feature_column(F.col("text"), strong, weak).alias("feats"))
    ready = stored(ready.coalesce(4), "toxic-features").withColumn("features", array_to_vector("feats"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=64).fit(ready.filter("part <> 0"))
    tuned = trees.transform(ready.filter("part = 0")).select("label", vector_to_array("probability")[1].alias("own"))
    calibration = IsotonicRegression(featuresCol="own", labelCol="label").fit(tuned if tuned.limit(1).count() else trees.transform(ready).select("label", vector_to_array("probability")[1].alias("own")))
    return ToxicityModel(strong, weak, trees, calibration, toxic / total)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    narrow = docs.select("doc_id", "text")
    scored = fit(narrow, labels, rows).score(narrow, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` without the documents scored at REJECT_AT or more; same columns."""
    (name,) = fresh(docs, "toxicity")
    return fit(docs.select("doc_id", "text"), labels, rows).score(docs, name).filter(F.col(name) < REJECT_AT).select(*docs.columns)
