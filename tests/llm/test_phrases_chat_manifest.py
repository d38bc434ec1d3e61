"""Phrase mining, reply trees and the Merkle manifest against brute force, and against DuckDB on a whole small table."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, manifest, oracles, phrases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# Phrases


def brute_phrases(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    kept = {x: v for x, v in found.items() if not any(y[0] == x[0] and len(y[1]) > len(x[1]) and inside(x[1], y[1]) and w[0] >= v[0] for y, w in found.items())}
    out = []
    for lang in {x[0] for x in kept}:
        own = sorted(((" ".join(p), *v) for (g, p), v in kept.items() if g == lang), key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(own[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def wordy(spark):
    rng = random.Random(4)
    vocabulary = ["the", "Of", "a", "été", "zebra", "crossing", "new", "york", "city", "😀"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ", ", ".\n", " "]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", "a a a a a a a a"), ("en", "New York city, new york city"), (None, None), ("en", ""), ("fr", " ,.;\r\n"), ("en", "x " * 3000)] + [("de", "only once here")] * 5
    return rows


@pytest.mark.parametrize("broadcast_rows", [200_000, 3])
def test_phrases(spark, wordy, monkeypatch, broadcast_rows):
    """Both sides of the broadcast's bound, with overlaps, ties, nulls, a very common word and columns of other names."""
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.createDataFrame([(i, *r, 1, "p", 2) for i, r in enumerate(wordy)], "doc_id int, lang string, text string, n int, phrase string, piece int")
    got = phrases.collocations(docs, least=4, longest=5, top=40)
    assert sorted(map(tuple, got.collect())) == brute_phrases(wordy, 4, 5, 40)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")


def test_phrases_of_nothing(empty, odd):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(odd, least=1000).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    table = spark.createDataFrame([("en", "p q", 2, big // 7), ("en", "p", 1, big // 5), ("en", "q", 1, big // 3)], "lang string, phrase string, size int, f long")
    row = phrases.scored(table, spark.createDataFrame([("en", big * 11)], "lang string, n long")).first()
    assert row["score"] == 1000 * (big // 7) * (big * 11) // ((big // 5) * (big // 3))


def test_merge_joins_of_relations_do_not_shuffle(spark, wordy, monkeypatch):
    """The relations are joined bucket by bucket: an exchange stands over the counts only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    plain = phrases.stored
    monkeypatch.setattr(phrases, "stored", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if label.startswith("groups") else None, plain(df, label))[1])
    try:
        phrases.frequent(spark.createDataFrame(wordy, "lang string, text string"), least=4, longest=3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and all("SortMergeJoin" in p and p.count("Exchange") == 1 for p in plans)


# Chat


def brute_paths(rows, top):
    """Every root-to-leaf path of every tree, ranked; ``rows``: tree -> {node: (parent, role, text, score)}."""
    out = {}
    for tree, nodes in rows.items():
        replied = {p for p, *_ in nodes.values() if p in nodes}
        found = []
        for leaf in nodes:
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if leaf not in replied and at not in nodes:
                scores = [nodes[x][3] or 0.0 for x in path]
                found.append((-sum(scores) / len(path), -len(path), leaf, path[::-1]))
        out[tree] = [p for *_, p in sorted(found)[:top]]
    return out


def test_branches_of_reply_trees(spark):
    rng = random.Random(9)
    trees = {}
    for t in range(12):
        n = rng.choice([1, 2, 7, 40, 90])
        nodes = {i: ((rng.randrange(max(0, i - 4), i) if rng.random() < 0.9 else rng.randrange(i)) if i else None, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["", None, "x\\y", "</s>", "[INST] a", f"text {i}"]), rng.choice([None, 0.5, 1.0, -2.0])) for i in range(n)}
        trees[t] = nodes
    trees[50] = {i: (i - 1 if i else None, "user", f"{i}", 0.0) for i in range(70)}  # one long thread
    trees[51] = {0: (None, "user", "root", 1.0)} | {i: (0, "assistant", f"{i}", 1.0) for i in range(1, 200)}  # a popular message, equal scores
    trees[52] = {1: (2, "user", "a cycle", 0.0), 2: (1, "user", "a cycle", 0.0), 3: (2, "user", "below it", 0.0), 4: (99, "user", "its parent is missing", 0.0)}
    trees[None] = {0: (None, "user", "no tree", 0.0)}
    rows = [(t, i, p, r, x, s, "extra") for t, nodes in trees.items() for i, (p, r, x, s) in nodes.items()]
    messages = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, score double, depth string")
    got = chat.read_back(chat.format_trees(messages, top=3)).collect()
    want = brute_paths(trees, 3)
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        path = want[r["tree"]][r["rank"] - 1]
        assert r["branch"] == path[-1] and r["n_messages"] == len(path)
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(trees[r["tree"]][n][1] or "", trees[r["tree"]][n][2] or "") for n in path]
        assert r["learned"] == "".join(trees[r["tree"]][n][2] or "" for n in path if trees[r["tree"]][n][1] == "assistant")


PARTS = ["<s>", "</s>", "<", "<<", "<<SYS>>", "<</SYS>>", "[", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[AS]", " [AS] ", "\\", "\\\\", "<\\s>", "[\\INST]", "s>", "/s>", "INST]", "SYS>>", " ", "\n", "é😀", "$1", "\\E", ""]


def test_template_is_reversible(spark):
    """Texts and roles of the template's own parts: each is read back as it was, and no control string is left inside."""
    rng = random.Random(11)
    some = lambda: "".join(rng.choices(PARTS, k=rng.randint(0, 7)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", some()]), some()) for c in range(300) for t in range(rng.randint(1, 5))]
    back = chat.read_back(chat.format_trees(chat.thread_rows(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))).collect()
    of = {}
    for c, _, r, t in rows:
        of.setdefault(c, []).append((r, t))
    assert {r["tree"]: [(x["role"], x["text"]) for x in r["turns"]] for r in back} == of
    assert {r["tree"]: r["learned"] for r in back} == {c: "".join(t for r, t in v if r == "assistant") for c, v in of.items()}
    inside = spark.createDataFrame([(t,) for _, _, _, t in rows], "t string").select(chat.escaped(F.col("t")).alias("e")).collect()
    assert not any(m in r["e"] for r in inside for m in ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[AS]"))


def test_conversations_with_odd_rows(spark):
    """Null texts, roles and ids, repeated rows, turns that are missing or shared, a very long text, other columns."""
    rows = [(1, 0, "user", None), (1, 1, None, "no role"), (1, 5, "assistant", ""), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", "same"), (None, 0, "user", "no id"), (3, None, "assistant", "é" * 300_000), (3, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, 9, "t") for r in rows], "conv_id int, turn int, role string, text string, node int, tree string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_trees(chat.thread_rows(df))).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 3, 2: 3, None: 1, 3: 2} and got[3]["loss_chars"] == 300_001
    for c, turns in {1: [("user", ""), ("", "no role"), ("assistant", "")], 2: [("assistant", "same"), ("user", "same"), ("user", "same")], None: [("user", "no id")]}.items():
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert chat.digests(chat.format_trees(chat.thread_rows(df.filter("false")))).count() == 0


# Manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout=16):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def climb(levels, i, h):
        siblings = []
        for level in levels[:-1]:
            run = level[i - i % fanout : i - i % fanout + fanout]
            before, after = run[: i % fanout], run[i % fanout + 1 :]
            siblings, h, i = siblings + before + after, H(*before, h, *after), i // fanout
        return siblings, h

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for g, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            claim = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                claim["text"] = r["text"].translate(LOWER)
            a, h = climb(trees[s], i, leaf(claim))
            b, h = climb(top, g, h)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], H(*a, *b), h, h == top[-1][0]))
    return sorted(out, key=repr)


def _cases(docs, odd):
    fresh = odd.withColumns({"grp": F.lit(1), "seq": F.lit(2), "hash": F.lit("h"), "members": F.lit("m")})
    many = docs.withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string"))).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id"))).union(docs.filter("doc_id < 3"))
    return {"many sources, null ids and sources, repeated rows": many, "one source": docs.withColumn("source", F.lit("s")), "one row": docs.filter("doc_id = 1"), "odd": fresh}


@pytest.mark.parametrize("which", ["many sources, null ids and sources, repeated rows", "one source", "one row", "odd"])
def test_manifest(documents, odd, which):
    docs = _cases(documents, odd)[which]
    got = manifest.verified(docs, manifest.lowered(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_without_a_broadcast_and_in_many_copies(documents, monkeypatch):
    """300 leaves and more a node, a node in a copy per two runs, and a join that shuffles."""
    monkeypatch.setattr(manifest, "BROADCAST_NODES", 0)
    monkeypatch.setattr(manifest, "RUNS_PER_COPY", 2)
    docs = documents.crossJoin(documents.sparkSession.range(3).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") * 3 + F.col("copy")).withColumn("source", F.when(F.col("doc_id") % 4 > 0, "hot").otherwise(F.col("source")))
    got = manifest.verified(docs, manifest.lowered(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_finds_any_change(documents):
    changed = manifest.verified(documents, {"n_chars": F.when(F.col("doc_id") == 17, F.lit(0)).otherwise(F.col("n_chars"))})
    assert [r["doc_id"] for r in changed.filter("NOT verified").collect()] == [17]
    assert manifest.verified(documents).filter("NOT verified").count() == 0 and manifest.verified(documents.filter("false")).count() == 0


# Against SQL


def test_queries_equal_their_sql(spark, data):
    """DuckDB on the whole smallest tables, with a low bound for phrases, as these tables are small."""
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pairs = [(phrases.collocations(docs, least=8), oracles.collocations(least=8)), (manifest.verified(docs, manifest.lowered(docs)), oracles.manifest())]
    for df, sql in pairs:
        rel = con.sql(sql)
        assert rel.columns == df.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
