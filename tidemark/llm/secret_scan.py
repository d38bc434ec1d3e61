"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers, in DataFrame functions.

The base finds three kinds by pattern. The method adds kind ``markov``: a run of MIN_RUN and more key characters, or what
base spans leave of one, whose log-likelihood ratio between the two models passes THRESHOLD per transition, and in all
what EVIDENCE characters at that threshold have; so shorter runs must be clearer. Both are
first-order models over the 80 characters from ``+`` to ``z``, smoothed by SMOOTHING. Random strings are labelled by the
base patterns (the values they found in the texts) and by rule (encoded SHA-256 digests of numbers); ordinary identifiers
are the runs of six and more key characters, outside base spans, of a sample of the texts, but those that mix letters
and digits. Each model is fitted on at
most SAMPLE_DOCUMENTS documents' strings; the scan covers every text whole.

Places are found without Python: matches are set off by a mark that the text can't hold, the text is split at it, and
lengths are added up, in code points, in two levels of FOLD matches, so that the work grows with their number.

Defined results: a null text is an empty one; without matches the digest is that of an empty string; repeated rows get
equal results; overlapping spans of different kinds are all reported. Columns besides ``doc_id`` and ``text`` are neither
read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, stored

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6

MIN_RUN, EVIDENCE = 16, 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
SAMPLE_DOCUMENTS = 2_000
SMOOTHING, THRESHOLD = 0.5, 0.8
FIRST, CHARS = ord("+"), 80
_MARK, _OTHER = "\ue000", "\ue001"
SPAN = "struct<start:int,stop:int,part:string>"
#: Matches in an inner fold.
FOLD = 256
#: Code points of the blocks that a text with secrets is cut into.
CUT = 4096


def spans_of(text: Column, pattern: str, ok: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, stop, part) for the matches of ``pattern`` that are ``ok``, leftmost and not overlapping."""
    clean = F.when(text.contains(_MARK), F.translate(text, _MARK, _OTHER)).otherwise(text)  # as long as before; no pattern has either
    pieces = F.split(F.regexp_replace(clean, f"(?:{pattern})", f"{_MARK}$0{_MARK}"), _MARK)
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, piece: Column) -> Column:
        stop = acc["at"] + F.length(piece)
        good = acc["hit"] & ok(piece) if ok else acc["hit"]
        span = F.struct(acc["at"].alias("start"), stop.alias("stop"), piece.alias("part"))
        return F.struct(stop.alias("at"), (~acc["hit"]).alias("hit"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(pieces) > 1, _in_two_levels(pieces, {"at": F.lit(0), "hit": F.lit(False)}, none, step)).otherwise(none)


def _in_two_levels(items: Column, state: dict[str, Column], none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A fold of ``step`` over ``items`` that appends to an array field ``out``: appending copies at most FOLD entries, and
    one entry per FOLD items."""
    names = list(state)
    start = F.struct(*(c.alias(n) for n, c in state.items()), F.array(none).alias("out"))

    def outer(acc: Column, i: Column) -> Column:
        inner = F.struct(*(acc[n].alias(n) for n in names), none.alias("out"))
        part = F.slice(items, i * FOLD + 1, F.lit(FOLD))
        return F.aggregate(part, inner, step, lambda x: F.struct(*(x[n].alias(n) for n in names), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / FOLD).cast("int"))
    return F.aggregate(blocks, start, outer, lambda acc: F.flatten(acc["out"]))


def _gaps(text: Column, spans: Column) -> Column:
    """What ``spans`` (sorted, may overlap) leave of ``text``, as (start, stop, part), empty gaps included.

    The gaps are cut from blocks of CUT code points, so that none is looked for from the text's start.
    """
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), s["start"].alias("stop"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(gap))).alias("out"))

    last = F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("stop"), F.lit("").alias("part")))
    gaps = _in_two_levels(F.concat(spans, last), {"at": F.lit(0)}, none, step)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{CUT}}})"), F.lit(1))
    first = lambda g: F.floor(g["start"] / CUT).cast("int")

    def cut(held: Column) -> Column:
        near = lambda g: F.array_join(F.slice(held, first(g) + 1, F.floor(g["stop"] / CUT).cast("int") - first(g) + 1), "")
        return F.transform(gaps, lambda g: F.struct(g["start"].alias("start"), g["stop"].alias("stop"), F.substring(near(g), g["start"] - first(g) * CUT + 1, g["stop"] - g["start"]).alias("part")))

    return _once(blocks, cut)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _codes(part: Column) -> Column:
    """The places of a run's characters in the models' alphabet; the empty last part of the split is left out."""
    return F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)


def _transitions(part: Column) -> Column:
    codes = _codes(part)
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * CHARS + b)


def _long_enough(piece: Column) -> Column:
    return F.length(F.regexp_extract(piece, ASSIGN, 2)) >= LEAST_VALUE


def scan_base(docs: DataFrame, names: tuple[str, ...] = (*KINDS[:3], "runs")) -> DataFrame:
    """``docs`` and, under ``names``, the spans of the three kinds and the runs outside them."""
    text, run = F.coalesce("text", F.lit("")), RUN % MIN_RUN
    found = docs.withColumns(dict(zip(names, (spans_of(text, ASSIGN, _long_enough), spans_of(text, ACCESS), spans_of(text, HEX)), strict=False)))
    base = F.concat(*names[:3])
    shifted = lambda g: F.transform(spans_of(g["part"], run), lambda s: F.struct((g["start"] + s["start"]).alias("start"), (g["start"] + s["stop"]).alias("stop"), s["part"]))
    left = F.flatten(F.transform(_gaps(text, F.array_sort(base)), shifted))
    return found.withColumn(names[3], F.when(F.size(base) > 0, left).otherwise(spans_of(text, run)))


def _counts(strings: DataFrame) -> dict[int, int]:
    """Transitions of the strings by number: at most CHARS squared rows."""
    moves = strings.select(F.explode(_transitions(F.col("part"))).alias("move"))
    return {r["move"]: r["count"] for r in moves.groupBy("move").count().collect()}


def fit_ratio(docs: DataFrame, scanned: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> list[int]:
    """Thousandths of the log ratio of the random to the ordinary model, for each transition."""
    spark = docs.sparkSession
    base = scanned.select("doc_id", F.concat(F.transform("assign", lambda s: F.regexp_extract(s["part"], ASSIGN, 2)), F.transform("access", lambda s: s["part"]), F.transform("hex", lambda s: s["part"])).alias("parts"))
    found = base.filter(F.size("parts") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.explode("parts").alias("part"))
    found = found.select(F.regexp_replace("part", r"[^+-z]", "").alias("part"))
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    ruled = spark.range(sample).select(F.explode(F.array(F.base64(digest), F.regexp_replace(F.base64(digest), "[+/=]", ""), F.upper(F.hex(digest)))).alias("part"))
    picked = stored(docs.select("doc_id").distinct().filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample-ids")
    plain = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left_semi")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = plain.select(F.explode(F.regexp_extract_all(bare, F.lit(f"({RUN % 6})"), F.lit(1))).alias("part")).filter(~(F.col("part").rlike("[0-9]") & F.col("part").rlike("[A-Za-z]")))
    tables = []
    for counts in (_counts(found.union(ruled)), _counts(plain)):
        rows = [0] * CHARS
        for move, n in counts.items():
            rows[move // CHARS] += n
        tables.append([math.log((counts.get(m, 0) + SMOOTHING) / (rows[m // CHARS] + SMOOTHING * CHARS)) for m in range(CHARS * CHARS)])
    return [round(1000 * (a - b)) for a, b in zip(*tables, strict=True)]


def random_runs(runs: str, ratio: list[int], threshold: float = THRESHOLD) -> Column:
    """Those of ``runs`` whose log ratio is ``threshold`` or more per transition, of EVIDENCE characters at least."""
    table = F.from_json(F.lit("[" + ",".join(map(str, ratio)) + "]"), "array<int>")  # folded to one constant

    def random(run: Column) -> Column:
        total = F.aggregate(_transitions(run["part"]), F.lit(0).cast("long"), lambda acc, move: acc + F.element_at(table, move.cast("int") + 1))
        return total >= F.lit(1000 * threshold) * (F.greatest(F.length(run["part"]), F.lit(EVIDENCE)) - 1)

    return F.filter(runs, random)


def _tagged(kind: str, place: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["stop"].alias("stop")))


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:stop of the spans of ``kinds`` by start, then kind as listed, comma-joined."""
    tagged = F.concat(*(_tagged(kind, i) for i, kind in enumerate(kinds)))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def find_secrets(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    narrow = docs.select("doc_id", "text")
    scanned = stored(scan_base(narrow).drop("text"), "scanned")
    out = scanned.withColumn("markov", random_runs("runs", fit_ratio(narrow, scanned, sample)))
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))


def redact(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, mask: str = "[redacted]") -> DataFrame:
    """``docs`` with every span of its texts, overlapping ones merged, replaced by ``mask``; other texts stay as they are,
    null ones included. n_chars, where there is such a column, follows. Same columns."""
    *base, runs, spans = names = fresh(docs, *KINDS[:3], "runs", "spans")
    scanned = stored(scan_base(docs, tuple(names[:4])), "scanned")  # with the texts, so that none is scanned again
    found = scanned.select("doc_id", *(F.col(own).alias(name) for own, name in zip(base, KINDS, strict=False)))
    ratio = fit_ratio(docs.select("doc_id", "text"), found, sample)
    marked = scanned.withColumn(spans, F.array_sort(F.concat(*base, random_runs(runs, ratio))))
    hit = F.size(spans) > 0
    out = marked.withColumn("text", F.when(hit, F.array_join(F.transform(_gaps(F.col("text"), F.col(spans)), lambda g: g["part"]), mask)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
