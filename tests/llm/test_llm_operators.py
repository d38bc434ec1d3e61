"""Each operator against a brute-force version, on a whole small table and on odd rows."""

import base64
import hashlib
import random
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from tidemark.llm import decontaminate, ngrams, packing, passages, quality_rules, resample, secret_scan, simhash, token_counts, tokens, toxicity, url_filter
from tidemark.llm import queries as llm_queries
from tidemark.llm.components import components


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_secrets_base(request, which):
    docs = request.getfixturevalue(which)
    got = secret_scan.find_secrets(docs).collect()
    want = sorted((r["doc_id"] or -1, *brute.secrets(r["text"])[:4]) for r in docs.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] or -1, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want


def test_secrets_of_other_forms_are_added_and_ordinary_runs_are_not(spark, documents):
    rng = random.Random(3)
    random_ = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(60)] + [hashlib.sha256(rng.randbytes(4)).hexdigest().upper()[:40] for _ in range(20)]
    plain = ["internationalization_of_the_reports", "mountain-river-and-valley-tour-guide", "thandthehereoronthingtherein", "some/relative/path/to/the/other/file", "--------------------------------", "the_configuration_file_of_this_module", "getUserAccountInformationById", "2024-01-01-report-final-version"]
    rows = [(10_000 + i, f"see {t} there") for i, t in enumerate(random_ + plain * 5)]
    both = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = by_id(secret_scan.find_secrets(both).filter("doc_id >= 10000"))
    hit = [got[10_000 + i]["n_markov"] for i in range(len(rows))]
    assert sum(hit[: len(random_)]) >= 0.9 * len(random_) and sum(hit[len(random_) :]) == 0


def test_letters_alone_short_runs_and_what_base_spans_leave(spark, data):
    rng = random.Random(5)
    documents = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    letters, short = ["".join(rng.choices(string.ascii_letters, k=24)) for _ in range(40)], ["".join(rng.choices(string.ascii_letters + string.digits, k=17)) for _ in range(40)]
    left = [f"AKIA{'ABCDEFGHIJKLMNOP'}/{base64.b64encode(rng.randbytes(30)).decode()}" for _ in range(10)]
    rows = [(20_000 + i, f"see {t} there") for i, t in enumerate(letters + short + left)]
    got = by_id(secret_scan.find_secrets(documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))))
    hit = [got[20_000 + i]["n_markov"] for i in range(len(rows))]
    assert sum(hit[:40]) >= 36 and sum(hit[40:80]) >= 30 and sum(hit[80:]) >= 9
    for i in range(80, 90):
        assert got[20_000 + i]["n_access"] == 1 and got[20_000 + i]["spans"].startswith("access:4:24")
    known = {r["doc_id"] for r in documents.select("doc_id").collect()}
    assert sum(got[d]["n_markov"] > 0 for d in known) <= 0.02 * len(known)


def test_many_secrets_in_a_long_text(spark):
    """Redaction against a loop: 6,000 secrets of all kinds, overlapping ones and non-BMP characters, in over 1 MB."""
    rng = random.Random(6)
    parts = []
    for i in range(6000):
        parts += ["😀 w" * rng.randint(1, 60), rng.choice([f" token={rng.randbytes(20).hex()} ", f" {rng.randbytes(16).hex()} ", " AKIA" + "".join(rng.choices(string.ascii_uppercase, k=16)) + " "])]
    text = "".join(parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secret_scan.find_secrets(docs).first()
    assert found["base_sha256"] == brute.secrets(text)[3]
    spans = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in found["spans"].split(",")))
    want, at = [], 0
    for a, b in spans:
        if a >= at:
            want.append(text[at:a])
        at = max(at, b)
    assert secret_scan.redact(docs).first()["text"] == "[redacted]".join([*want, text[at:]])


def test_redaction(odd, empty):
    got = secret_scan.redact(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    text = by_id(got)[9]["text"]
    assert text == 'the [redacted]" and [redacted] [redacted] end' and by_id(got)[9]["n_chars"] == len(text)
    assert by_id(got)[5]["text"] == by_id(odd)[5]["text"] and by_id(got)[0]["text"] is None
    assert secret_scan.redact(empty).count() == 0 and secret_scan.find_secrets(empty).count() == 0


def test_marks_in_a_text_do_not_shift_places(spark):
    text = "\ue000x\ue001 token = abcdef12 \ue000"
    got = secret_scan.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["spans"] == brute.secrets(text)[4] and got["n_assign"] == 1


def test_token_ids_equal_the_plain_tokenizer(texts):
    odd = ["<|endoftext|> it's  a\tb c ISN'T ΣΑΣ İx é \x1c x\x85y 'tis 12a ﬁ ǅ ª º² a_b __ ", "", "   ", "a" * 500, "don't!!' 's", "K½ x١٢ \u200bz", "'" * 250 + " a", "Ŀ ŉa ß ẞ Å"]
    odd += [f"{chr(c)}x y{chr(c)} Q{chr(c)}q {chr(c)} {chr(c)}.. '{chr(c)}" for c in range(1, 0x250)] + [None, "İ", "İstanbul", "aİb c"]
    sample = [t for _, t in texts[:60]] + odd
    e = tokens.Encoder(tokens.default_path())
    assert e.by_word and list(tokens.encode_all(sample, tokens.default_path())) == e.plain([t or "" for t in sample])
    assert [np.diff(e.encode(pa.array(sample), True)[1]).sum()] == [sum(len(x) for x in e.plain([t or "" for t in sample])) // 4]


def test_a_full_cache_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 50)
    monkeypatch.setattr(tokens, "TEXTS_AT_ONCE", 3000)
    e = tokens.Encoder(tokens.default_path())
    monkeypatch.setitem(tokens._ENCODERS, tokens.default_path(), e)
    sample = [t for _, t in texts[:40]]
    assert list(tokens.encode_all(sample, tokens.default_path())) == e.plain(sample)


def test_token_counts(documents, texts, odd, empty):
    report = token_counts.context_report(token_counts.length_histogram(documents)).collect()
    n = np.array([len(x) for x in brute.tokens([t for _, t in texts])])
    for r in report:
        k = r["context_limit"]
        assert (r["docs_at"], r["docs_total"], r["tokens_total"], r["docs_over"], r["tokens_over"]) == ((n == k).sum(), len(n), n.sum(), (n > k).sum(), n[n > k].sum())
        assert r["tokens_kept"] == np.minimum(n, k).sum() and r["tokens_lost"] == (n - np.minimum(n, k)).sum()
    full = token_counts.context_report(token_counts.length_histogram(documents))
    limits = {r["share"]: r["context_limit"] for r in token_counts.quantile_limits(full).collect()}
    assert limits[1.0] == n.max() and (n <= limits[0.5]).mean() >= 0.5
    assert token_counts.length_histogram(odd).agg(F.sum("n_docs")).first()[0] == odd.count()
    assert {r["docs_total"] for r in token_counts.context_report(token_counts.length_histogram(empty)).collect()} == {0}


def test_toxicity_learns_and_ranks_held_out_rows(spark, odd, empty, labels):
    """A planted word makes a text toxic: held-out rows must be told apart."""
    rng = random.Random(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, marks = [], []
    for i in range(1200):
        bad = rng.random() < 0.3
        body = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(2, 5) if bad else 0):
            body.insert(rng.randint(0, len(body)), rng.choice(["vile", "nasty", "Foul!"]))
        rows.append((i, " ".join(body)))
        marks.append((i, 1, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score_documents(docs, known))
    truth = {i: t for i, _, t in marks}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    pos, neg = [got[i]["score"] for i in held if truth[i]], [got[i]["score"] for i in held if not truth[i]]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    kept = toxicity.reject_toxic(docs.withColumn("score", F.lit(1)), known)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] < 0.7}
    none = toxicity.score_documents(odd, labels.filter("false"))
    assert none.count() == odd.count() and {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.score_documents(empty, known).count() == 0 and toxicity.score_documents(odd, known).count() == odd.count()


def test_toxicity_features_of_odd_texts():
    for t in brute.ODD:
        f = toxicity.features_of(t, toxicity.Lexicon(["one", "wor*"]), toxicity.Lexicon(["two"]))
        assert len(f) == len(toxicity.FEATURES) and all(np.isfinite(f))
    hidden = toxicity.FEATURES.index("obfuscated_hits")
    for word in ("1d1ot", "i.d.i.o.t", "id*iot"):
        assert toxicity.features_of(f"you {word} there", toxicity.Lexicon(["idiot"]), toxicity.Lexicon([]))[hidden] > 0
    assert toxicity.features_of("words wor", toxicity.Lexicon(["wor*"]), toxicity.Lexicon([]))[0] == 0.5


def test_fingerprints_and_classes(documents, texts):
    got = by_id(simhash.near_duplicates(documents))
    prints = {d: brute.simhash(t) for d, t in texts}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == brute.components(prints)


def test_links_at_exactly_three_bits_in_all_blocks(spark):
    """Planted fingerprints at 0 to 5 bits, spread over the blocks in every way, chains included."""
    rng = random.Random(7)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.append(base)
        for k in (1, 2, 3, 3, 3, 4, 5):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), k)))
    for blocks in [(0, 1, 2), (22, 23, 24), (61, 62, 63), (0, 30, 50), (1, 2, 40), (21, 22, 43)]:
        base = rng.getrandbits(64)
        prints += [base, base ^ sum(1 << b for b in blocks)]
    named = dict(enumerate(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in set(prints)], "fp long")
    got = {r["fp"]: r["class"] for r in simhash.fingerprint_classes(df).collect()}
    want = brute.components(named)
    ours, theirs = {}, {}
    for i, f in named.items():
        ours.setdefault(got[signed(f)], set()).add(i)
        theirs.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_near_duplicates_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r["doc_id"]: r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {0: 0, 1: 0, 2: 0}
    kept = simhash.keep_one_each(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(10) == 1 and 11 not in ids and ids.count(None) == 1 and 1 not in ids
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one_each(empty).count() == 0


def test_one_document_of_each_class_stays_where_texts_share_an_id(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "an other text of a few words"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (7, c), (None, c), (None, "no id at all here"), (None, "no id at all here")], "doc_id long, text string").withColumn("kept_id", F.lit(1)).withColumn("own_hash", F.lit("h"))
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == sorted([(3, a), (5, b), (7, c), (-1, "no id at all here")])


def test_components(spark):
    rng = random.Random(2)
    edges = [(a, a + 1) for a in range(0, 300) if a % 37] + [(1000, x) for x in range(1001, 1100)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(80)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for x in list(parent) if x in got} and {a for e in edges if e[0] != e[1] for a in e} == set(got)


def test_contamination(spark, data, documents, texts):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    want = brute.contamination(texts, [(r["item_id"], r["text"]) for r in items.collect()])
    got = by_id(decontaminate.contamination(documents, items))
    assert {d: tuple(r)[1:] for d, r in got.items()} == want and sum(v[4] for v in want.values()) > 0
    kept = decontaminate.drop_contaminated(documents, items)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {d for d, v in want.items() if not v[4]}


def test_every_word_of_a_long_window_is_compared(spark):
    text = "a b c d e x y z i j k l m"
    item = "a b c d e f g h i j k l m"
    docs = spark.createDataFrame([(1, text), (2, "c d e f g h i j"), (3, "e f g h i"), (4, f"q {item} q")], "doc_id long, text string").withColumn("hit_id", F.lit(1)).withColumn("__d", F.lit(2)).withColumn("own_hash", F.lit(3))
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, " ".join(f"v{i}" for i in range(30)))], "item_id long, text string")
    for window in (10, 11, 13):
        got = by_id(decontaminate.contamination(docs, items, window))
        assert {d: r["n_hit"] for d, r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 13}
        kept = decontaminate.drop_contaminated(docs, items, window)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3}


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination_by_short_items_overlaps_and_odd_rows(spark, odd, empty, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    item = [(1, "One"), (2, "two WORDS"), (3, None), (4, "... !!"), (5, "x y z x y z x y z x y z"), (6, "same text of some words here"), (7, "été"), (8, "ÉTÉ ß 東京")]
    items = spark.createDataFrame(item, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = odd.select("doc_id", "text", "words", "title")
    rows = [(i, r["text"]) for i, r in enumerate(docs.collect())]
    want = sorted(v for v in brute.contamination(rows, item).values())
    got = decontaminate.contamination(docs, items).drop("doc_id").collect()
    assert sorted(map(tuple, got)) == want
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.contamination(docs, items.filter("false")).filter("contaminated").count() == 0


def test_urls(spark):
    urls = ["http://www.Example.COM/en/1?x", "https://example.com/en/", "http://example.com/de", "http://a.net/es/1", "http://net/fr/", "http://b.org", "http://spam-farm.example.org/x", "http://notspam-farm.example.org/x", None, "", "no scheme", "http://", "x://y.com", "http://com/?q", "http://example.com#/en/", "a://b://c/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, url_filter.entries(spark)).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") == got[16] and got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == ("net/fr/", "block") and got[5] == ("b.org", "", None, "allow")
    assert got[6][2:] == (None, "block") and got[7][2:] == (None, "allow") and got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert got[12] == ("y.com", "", None, "allow") and got[13][2] == "com/" and got[14][1:] == ("", None, "allow") and got[15][0] == "b:"
    assert url_filter.judge_urls(pages.filter("false"), url_filter.entries(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, url_filter.entries(spark).filter("false")).collect()} == {"allow"}


def test_listed_urls_are_met_in_canonical_form(spark):
    listed = [("Bad.Example.org:443", "/a%7eb/%2fc", "block"), ("all.example.net.", "", "block")]
    entries = spark.createDataFrame([(*r, False) for r in listed], "host string, path string, verdict string, is_rule boolean")
    bad = ["http://bad.example.org/a~b/%2Fc", "HTTPS://u:p@BAD.example.ORG:8443/%61%7Eb/%2fc/d?x", "http://www.all.example.net./", "x://all.example.net", "x://all.example.net:80?q"]
    good = ["http://bad.example.org/a~b/c", "http://bad.example.org/", "http://ball.example.net/", "http://bad.example.org/a~b/%2", None, "http://%"]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string").withColumn("own_host", F.lit(1))
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, entries).collect()}
    assert [got[i]["verdict"] for i in range(len(got))] == ["block"] * len(bad) + ["allow"] * len(good) and {r["rule"] for r in got.values()} == {None}
    assert got[1]["host"] == "u:p@bad.example.org:8443" and got[1]["path"] == "/%61%7Eb/%2fc/d"


def test_a_list_of_a_million_entries(spark):
    n = 1_000_000
    entries = spark.range(n).selectExpr("concat('h', id, '.example.org') AS host", "concat('/p', id % 7, '/') AS path", "'block' AS verdict", "false AS is_rule")
    pages = spark.range(0, 2 * n, 997).selectExpr("id AS page_id", "concat('http://www.h', id, '.example.org/p', id % 7, '/x') AS url")
    got = url_filter.judge_urls(pages, entries).groupBy(F.col("page_id") < n, "verdict").count().collect()
    assert sorted(map(tuple, got)) == [(False, "allow", pages.filter(f"page_id >= {n}").count()), (True, "block", pages.filter(f"page_id < {n}").count())]


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    for most, worst in ((url_filter.BLOCKS, 0.05), (8, 1.0)):
        bloom = url_filter.BlockedBloom(keys, most)
        assert keys.filter(~bloom.may_hold(F.col("key"))).count() == 0
        other = keys.select(F.concat(F.lit("o"), "key").alias("key"))
        assert other.filter(bloom.may_hold(F.col("key"))).count() <= worst * 5000


def test_packing(documents, texts, odd, empty):
    rows = [r.asDict() for r in packing.pack_documents(documents).collect()]
    assert brute.check_packing(texts, rows) < 0.02
    few = [r.asDict() for r in packing.pack_documents(documents, group_pieces=50).collect()]
    assert brute.check_packing(texts, few) < 0.1
    assert packing.pack_documents(odd).agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in brute.tokens([r["text"] for r in odd.collect()]))
    assert packing.pack_documents(empty).count() == 0


def test_packing_keeps_large_ids_beside_null_ones_and_cuts_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400_000))  # some 3 MB
    big = (1 << 53) + 1
    rows = [(big, "one two"), (None, "three"), (big + 2, long), (-big, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    assert {r["doc_id"] for r in got} == {big, None, big + 2, -big}
    ids = brute.tokens([long])[0]
    pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == big + 2)
    whole = np.asarray([*ids, packing.END_ID], "<u4")
    assert pieces == [(a, len(whole[a : a + 4096]), zlib.crc32(whole[a : a + 4096].tobytes())) for a in range(0, len(whole), 4096)]
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len(set(places)) == len(places) and len({r["sequence_id"] for r in got if r["length"] == 4096}) == len(whole) // 4096


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    windows, offsets = packing.best_fit_decreasing(lengths, 100)
    left = {}
    for n, w, o in zip(lengths, windows, offsets, strict=True):
        fits = [v for v in left.values() if v >= n]
        assert (w in left) == bool(fits) and (not fits or left[w] == min(fits))
        left[w] = left.get(w, 100) - n
        assert o + n + left[w] == 100


def test_contamination_by_items_that_share_an_id(spark):
    """Items of one id, of no id, and repeated ones; long windows among them."""
    eleven = "one two three four five six seven eight nine ten eleven"
    items = [(1, "alpha beta gamma delta"), (1, eleven), (1, eleven), (2, "alpha beta gamma delta"), (None, "mu nu xi"), (None, None), (3, "kappa"), (3, "lambda kappa " * 9)]
    docs = [(1, "x alpha beta gamma delta y"), (2, f"0 {eleven}"), (3, "a mu nu xi b"), (4, "kappa"), (5, "nothing here"), (6, "alpha beta gamma delta mu nu xi")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), df).collect()}
    want = {1: (4, "1,2"), 2: (11, "1"), 3: (3, ""), 4: (1, "3"), 5: (0, ""), 6: (7, "1,2")}
    assert {d: (r["n_hit"], r["items_sha256"]) for d, r in got.items()} == {d: (n, hashlib.sha256(i.encode()).hexdigest()) for d, (n, i) in want.items()}
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), df).collect()
    assert [r["doc_id"] for r in kept] == [5]


def test_quality(documents, texts, labels, odd, empty):
    got = by_id(quality_rules.judge(documents, labels))
    for d, t in texts:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)
        assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= quality_rules.THRESHOLD)
    odd_rows = quality_rules.judge(odd, labels).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, odd_rows)) == sorted(brute.quality(r["text"]) for r in odd.collect())
    assert quality_rules.judge(empty, labels).count() == 0 and quality_rules.judge(odd, labels.filter("false")).count() == odd.count()


def test_quality_keeps_good_and_drops_bad(documents, labels):
    both = quality_rules.judge(documents, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in both}
    assert share[1] > 0.9 and share[0] < 0.2


def _verdicts(docs, labels):
    """Kept share of good and of bad documents among those whose labels the models weren't counted from."""
    learn = labels.filter("crc32(cast(doc_id as string)) % 3 <> 1")
    held = labels.filter("crc32(cast(doc_id as string)) % 3 = 1")
    got = quality_rules.judge(docs, learn).join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    again = resample.resample(docs, learn).join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    return {r["quality"]: r["kept"] for r in got}, {r["quality"]: r["kept"] for r in again}


def test_quality_and_resampling_on_held_out_labels(spark, data):
    folder = data.replace("0.001", "0.01")
    rules, sample = _verdicts(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules[1] > 0.9 and rules[0] < 0.25
    assert sample[1] > 0.85 and sample[0] < 0.7


def test_verdicts_stay_when_the_corpus_doubles(spark, data):
    """The same documents again under new ids, across the sizes at which the number of buckets once changed; what is left
    is the smoothing, which weighs less in a larger corpus."""
    folder = data.replace("0.001", "0.01")
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    before = {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents, labels).collect()}
    again = lambda df: df.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    after = {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents.union(again(documents)), labels.union(again(labels))).filter("doc_id < 1000000").collect()}
    assert sum(before[d] != after[d] for d in before) <= 0.02 * len(before)


def test_weights_keys_and_kept_sets_against_a_loop(documents, labels, texts):
    """op9 and op10 whole: bucket counts, ratios, weights, noise, cut and verdicts, recomputed without their code."""
    mask, signed = ngrams.BUCKETS - 1, lambda h: h - (1 << 64) if h >> 63 else h
    one, two = lambda w: xxhash.xxh64(w.encode(), 42).intdigest(), lambda a, b: xxhash.xxh64(b.encode(), one(a)).intdigest()
    grams = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams[d] = [one(x) & mask for x in w] + [two(a, b) & mask for a, b in zip(w, w[1:])]
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = np.bincount(sum(grams.values(), []), minlength=mask + 1), np.bincount(sum((g for d, g in grams.items() if d in good), []), minlength=mask + 1)
    ratio = np.round(1000 * (np.log((target + 1) / (target.sum() + mask + 1)) - np.log((raw + 1) / (raw.sum() + mask + 1))))
    mean = {d: ratio[g].sum() / 1000 / len(g) if g else 0.0 for d, g in grams.items()}
    got = by_id(quality_rules.judge(documents, labels))
    for d, t in texts:
        assert got[d]["log_ratio"] == pytest.approx(mean[d], abs=2e-5)
        if abs(mean[d] - quality_rules.THRESHOLD) > 2e-5:
            assert got[d]["kept"] == (not brute.quality(t)[5] and mean[d] >= quality_rules.THRESHOLD)
    keys = {}
    for d, t in texts:
        h = xxhash.xxh64(struct.pack("<i", resample.SEED), 42).intdigest()
        for x in (d, signed(one(t or ""))):
            h = xxhash.xxh64(struct.pack("<q", x), h).intdigest()
        keys[d] = mean[d] * len(grams[d]) - np.log(-np.log(((h >> 12) + 0.5) / 2**52))
    sampled = by_id(resample.resample(documents, labels))
    for d, k in keys.items():
        assert sampled[d]["log_weight"] == pytest.approx(mean[d] * len(grams[d]), rel=1e-3, abs=0.05) and sampled[d]["key"] == pytest.approx(k, rel=1e-3, abs=0.05)
    cut = sorted(keys.values(), reverse=True)[round(resample.SAMPLE_SHARE * len(keys)) - 1]
    assert all(sampled[d]["kept"] == (k >= cut) for d, k in keys.items() if abs(k - cut) > 0.1)


def test_log_ratio_against_a_loop(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, None)], "doc_id long, text string")
    ratio = ngrams.log_ratio(docs, spark.createDataFrame([(1,)], "doc_id long"), 1 << 10)
    one = lambda *w: docs.limit(1).select(ngrams.bucket_of(*map(F.lit, w), buckets=1 << 10)).first()[0]
    grams = {1: [("a",), ("b",), ("a",), ("a", "b"), ("b", "a")], 2: [("c",), ("d",), ("c", "d")]}
    raw = [one(*g) for gs in grams.values() for g in gs]
    target = [one(*g) for g in grams[1]]
    a = one("a")
    want = np.log((target.count(a) + 1) / (len(target) + 1024)) - np.log((raw.count(a) + 1) / (len(raw) + 1024))
    assert ratio[a] == round(1000 * want)
    got = docs.select(ngrams.mean_ratio(ngrams.words_of(F.col("text")), ratio)).collect()
    assert got[0][0] == pytest.approx(np.mean([ratio[one(*g)] for g in grams[1]]) / 1000) and got[2][0] == 0


def test_resampling(documents, labels, odd, empty):
    got = resample.resample(documents, labels)
    n = documents.count()
    rows = got.collect()
    assert len(rows) == n and abs(sum(r["kept"] for r in rows) - round(resample.SAMPLE_SHARE * n)) <= 2
    assert min(r["key"] for r in rows if r["kept"]) >= max(r["key"] for r in rows if not r["kept"])
    good = got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"))
    share = {r["quality"]: r["kept"] for r in good.collect()}
    assert share[1] > 0.9 and share[0] < 0.6
    assert resample.resample(odd, labels).count() == odd.count() and resample.resample(empty, labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(9)
    xs = [rng.gauss(0, 1) for _ in range(3000)] + [0.25] * 500
    df = spark.createDataFrame([(x,) for x in xs], "key double")
    for k in (1, 2, 700, 1500, 3499, 3500):
        assert resample.kth_largest(df, k) == sorted(xs, reverse=True)[k - 1]
    assert resample.kth_largest(df, 3501) is None and resample.kth_largest(df.limit(0), 1) is None


def test_compact_windows_against_all_sequences():
    rng = np.random.default_rng(5)
    for n, least, top in ((30, 5, 1 << 60), (60, 7, 1 << 60), (5, 5, 1 << 60), (4, 5, 1 << 60)):
        values = rng.integers(0, top, n, dtype=np.uint64)
        got = {}
        for c, left, right in zip(*passages.compact_windows(values, least), strict=True):
            for i in range(left, c + 1):
                for j in range(max(c, i + least - 1), right + 1):
                    assert (i, j) not in got
                    got[(i, j)] = c
        assert got == {(i, j): i + int(np.argmin(values[i : j + 1])) for i in range(n) for j in range(i + least - 1, n)}


def test_passages(spark, documents, texts, odd, empty):
    got = passages.shared_passages(documents).collect()
    words = {d: (t or "").encode().lower().split() for d, t in texts}
    runs = {}
    for d, w in words.items():
        for i in range(len(w) - passages.PASSAGE + 1):
            runs.setdefault(tuple(w[i : i + passages.PASSAGE]), set()).add(d)
    want = {d for s in runs.values() if len(s) > 1 for d in s}
    assert want <= {x for r in got for x in (r["doc_id"], r["match_doc_id"])} and want
    grams = lambda w: set(zip(*(w[k:] for k in range(5)), strict=False))
    for r in got:
        a, b = grams(words[r["doc_id"]][r["start_word"] : r["end_word"]]), grams(words[r["match_doc_id"]][r["match_start_word"] : r["match_end_word"]])
        assert len(a & b) / len(a | b) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8 and r["end_word"] - r["start_word"] >= passages.PASSAGE
    assert passages.shared_passages(empty).count() == 0 and passages.shared_passages(odd).count() == 0
    rng = random.Random(8)
    shared = [f"p{rng.randint(0, 10**6)}" for _ in range(70)]
    own = lambda: [f"q{rng.randint(0, 10**9)}" for _ in range(300)]
    near = shared[:35] + ["changed"] + shared[36:]
    docs = spark.createDataFrame([(1, " ".join(own() + shared + own())), (2, " ".join(shared + own())), (3, " ".join(own() + near)), (4, " ".join(own()))], "doc_id long, text string")
    hits = {(r["doc_id"], r["match_doc_id"]) for r in passages.shared_passages(docs).collect()}
    assert {x for h in hits for x in h} == {1, 2, 3}


def test_every_passage_of_a_pair_is_found_with_its_span():
    rng = np.random.default_rng(11)
    fresh = lambda n: rng.integers(0, 1 << 60, n, dtype=np.uint64)
    least, whole = passages.LEAST, fresh(1000)
    edited = whole.copy()
    for i in range(70, 1000, 70):
        edited[i : i + passages.SHINGLE] = fresh(passages.SHINGLE)
    one, two, phrase = fresh(60), fresh(60), fresh(8)
    repeated = np.tile(fresh(10), 12)
    pairs = [
        (edited, whole),
        (np.r_[one, fresh(20), two], np.r_[one, fresh(30), two]),
        (np.r_[fresh(40), phrase, one, fresh(9), two, phrase], np.r_[phrase, fresh(80), two, phrase, fresh(50), phrase, one, phrase]),
        (np.r_[fresh(30), one, fresh(30)], np.r_[one, fresh(70), one]),
        (np.r_[fresh(30), repeated], np.r_[repeated, fresh(30)]),
        (fresh(300), fresh(300)),
    ]
    for a, b in pairs:
        found = passages.matching_passages(a, b)
        sets = [set(b[j : j + least].tolist()) for j in range(len(b) - least + 1)]
        for s in range(len(a) - least + 1):
            x = set(a[s : s + least].tolist())
            if any(len(x & y) >= passages.SIMILARITY * len(x | y) for y in sets):
                assert any(f[0] <= s + 9 and s + least - 10 <= f[1] for f in found), s  # 9 shingles at its ends may be foreign
        for s, e, sb, eb, jaccard in found:
            x, y = set(a[s : e + 1].tolist()), set(b[sb : eb + 1].tolist())
            assert e - s + 1 >= least and len(x & y) / len(x | y) == jaccard >= passages.SIMILARITY
    spans = [f[:4] for f in passages.matching_passages(*pairs[1])]
    assert spans == [(0, 59, 0, 59), (80, 139, 90, 149)]
    assert [f[:2] for f in passages.matching_passages(*pairs[0])] == [(0, 999)]


def test_passages_beside_repeated_phrases(spark):
    rng = random.Random(21)
    own = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    phrases = [own(6) for _ in range(12)]
    rows = []
    for pair in range(8):
        shared, other = own(60), own(60)
        for side in range(2):
            text = own(20)
            for p in rng.sample(phrases, 8):  # phrases before, between and behind, at other places in each document
                text += p + own(rng.randint(3, 9))
            text += shared + rng.choice(phrases) + own(5) + (shared if side else []) + own(30)
            for p in rng.sample(phrases, 8):
                text += p + own(rng.randint(3, 9))
            rows.append((2 * pair + side, " ".join(text + other + rng.choice(phrases))))
    for pair in range(4):  # all of a passage's phrases stand before it too, in another order
        shared = own(60)
        for side in range(2):
            starts = rng.sample(range(53), 53)
            rows.append((100 + 2 * pair + side, " ".join([x for i in starts for x in shared[i : i + 8] + own(40)] + shared)))
    words = {d: t.encode().lower().split() for d, t in rows}
    runs = {}
    for d, w in words.items():
        for i in range(len(w) - passages.PASSAGE + 1):
            runs.setdefault(tuple(w[i : i + passages.PASSAGE]), set()).add((d, i))
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for places in runs.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                assert any(r["doc_id"] == d and r["start_word"] <= i and i + passages.PASSAGE <= r["end_word"] for r in got), (d, i)


def _edited(rng, words, gap):
    """``words`` with a word replaced every ``gap`` words or a little more."""
    out, at = list(words), rng.randint(gap // 2, gap)
    while at < len(out):
        out[at] = f"e{rng.randint(0, 10**9)}"
        at += gap + rng.randint(0, 10)
    return out


def test_near_copies_of_passages_in_groups_of_two_to_fifty(spark, monkeypatch):
    """Each document holds an edited version of its group's passage (any two agree by Jaccard 0.8 or nearly so) between own
    words. Every one must be tied to its group, and the groups must stay whole: the share that is, is 0.98 or more."""
    rng = random.Random(41)
    own = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows, groups = [], {}
    for g, size in enumerate([2] * 40 + [5] * 10 + [50]):
        passage = own(rng.randint(60, 160))
        for _ in range(size):
            d = rng.randint(0, 10**12)
            groups.setdefault(g, set()).add(d)
            rows.append((d, " ".join(own(rng.randint(0, 80)) + _edited(rng, passage, 95) + own(rng.randint(0, 80)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = spark.createDataFrame([(-1 - i, " ".join(own(200))) for i in range(50)], "doc_id long, text string")
    got = passages.shared_passages(docs.union(clean)).collect()
    of = {d: g for g, members in groups.items() for d in members}
    assert all(r["doc_id"] in of and of[r["doc_id"]] == of[r["match_doc_id"]] for r in got)
    links = spark.createDataFrame([(r["doc_id"], r["match_doc_id"]) for r in got], "u long, v long")
    root = {r["node"]: r["root"] for r in components(links).collect()}
    whole = sum(max(sum(root.get(d) == root.get(e) is not None for e in m) for d in m) for m in groups.values())
    assert whole >= 0.98 * len(of)
    want = {(r["doc_id"], r["start_word"], r["match_doc_id"], r["match_start_word"]) for r in got}
    monkeypatch.setattr(passages, "HOT", 1)  # each minimum that a sampled document holds takes the other way
    again = passages.shared_passages(docs.union(clean)).collect()
    assert {(r["doc_id"], r["start_word"], r["match_doc_id"], r["match_start_word"]) for r in again} == want


def test_documents_with_passages_are_one_row_each_and_their_classes_are_whole(spark, tmp_path):
    """All pairs that share 50 words are in one class, by brute force; copies are in their text's; spans are what is shared."""
    rng = random.Random(57)
    own = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passages_, rows = [own(rng.randint(50, 90)) for _ in range(12)], []
    for d in range(120):
        text = own(20)
        for p in rng.sample(passages_[:6] if d % 2 else passages_[6:], rng.randint(0, 2)):
            text += p + own(60)
        rows.append((d, " ".join(text)))
    rows += [(200 + i, rows[i % 3][1]) for i in range(30)] + [(300, None), (301, ""), (302, "a b"), (303, "a b")]
    words = {d: (t or "").split() for d, t in rows}
    runs = {}
    for d, w in words.items():
        for i in range(len(w) - passages.PASSAGE + 1):
            runs.setdefault(tuple(w[i : i + passages.PASSAGE]), set()).add((d, i))
    shared = [g for g in runs.values() if len({d for d, _ in g}) > 1]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = llm_queries.op6_substring_dedup(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(got) and set(got) == {d for g in shared for d, _ in g}
    for g in shared:
        assert len({got[d]["class_id"] for d, _ in g}) == 1
        for d, i in g:
            assert any(p["start_word"] <= i and i + passages.PASSAGE <= p["end_word"] for p in got[d]["passages"]), (d, i)
    root = {d: d for d in got}
    for _ in got:
        for g in shared:
            low = min(root[d] for d, _ in g)
            root |= {d: low for d, _ in g}
    assert {d: r["class_id"] for d, r in got.items()} == root
    for r in found:
        spans = [tuple(p) for p in r["passages"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and r["n_words_shared"] == sum(e - s for s, e in spans)


def test_texts_that_share_an_id_are_told_apart(spark):
    rng = random.Random(43)
    own = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    one, two = own(60), own(70)
    rows = [(1, " ".join(own(30) + one)), (7, " ".join(one + own(20))), (7, " ".join(own(9) + two)), (9, " ".join(two + own(50))), (7, " ".join(own(200))), (None, " ".join(one))]
    rows.append(rows[1])
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["match_doc_id"]) for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k"))).collect()}
    assert got == {(1, 30, 90, 7), (7, 0, 60, 1), (7, 9, 79, 9), (9, 0, 70, 7)}


def test_documents_that_hold_only_phrases_do_not_hide_a_passage(spark):
    rng = random.Random(33)
    own = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows, want = [], []
    for k in range(6):
        shared = own(55 + 5 * k)
        for d in (500 + 10 * k, 505 + 10 * k):
            rows.append((d, " ".join(own(60) + shared + own(60))))
            want.append((d, 60, 60 + len(shared)))
        for i in range(len(shared) - 4):  # each 5-word phrase also in documents of smaller and of larger ids
            rows += [(d, " ".join(own(60) + shared[i : i + 5] + own(60))) for d in (1000 * k + 2 * i + 10_000, -1000 * k - 2 * i - 10_000)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == sorted(want)


def test_the_target_model_counts_every_trusted_document(spark, monkeypatch):
    n = 20_050
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id % 7, ' v', id % 11) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 400 = 399 THEN 0 ELSE 1 END AS quality")
    good = ngrams.trusted_ids(labels, docs)
    assert good.count() == sum(i % 400 != 399 for i in range(n)) and ngrams.trusted_ids(labels.selectExpr("doc_id", "1 AS quality"), docs).count() == n
    ratio = ngrams.log_ratio(docs, good)
    monkeypatch.setattr(ngrams, "BROADCAST_ROWS", 0)
    assert ngrams.log_ratio(docs, good) == ratio and not any(ngrams.log_ratio(docs, docs.select("doc_id")))
