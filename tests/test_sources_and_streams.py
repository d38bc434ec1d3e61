import datetime as dt
import html
import json
from html.entities import html5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import text
from tidemark.operators.upsert import replace_by_key
from tidemark.sources import documents, files
from tidemark.streaming import feeds

D = dt.date


def test_membership_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text('# a comment\ndate,tickers\n1996-01-02,"AAPL, BF.B ,"\n2020-12-21,"AAPL,TSLA"\n')
    got = sorted(map(tuple, files.read_membership(spark, str(tmp_path / "m.csv")).collect()))
    assert got == [(D(1996, 1, 2), "AAPL"), (D(1996, 1, 2), "BF-B"), (D(2020, 12, 21), "AAPL"), (D(2020, 12, 21), "TSLA")]
    (tmp_path / "e.csv").write_text("# nothing\n")
    with pytest.raises(ValueError):
        files.read_membership(spark, str(tmp_path / "e.csv"))
    (tmp_path / "s.csv").write_text("# c\nticker,sector\nA,Tech\n")
    assert [tuple(r) for r in files.read_sectors(spark, str(tmp_path / "s.csv")).collect()] == [("A", "Tech")]


def test_short_volume_lines(spark):
    lines = ["Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market", "20240105|aapl|10|0|100|N", "20240105|ZERO|1|0|0|N", "20240105|BAD|x|0|5|N", "short|line", "20240105|OUT|1|0|2|N"]
    got = files.parse_short_volume(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([("AAPL",)], "ticker string"))
    assert [tuple(r) for r in got.collect()] == [(D(2024, 1, 5), "AAPL", 10, 100)]


def test_html(spark):
    page = "<html><script>var a='<p>';</script><style>x</style><p>A &amp; B&nbsp;&lt;ok&gt;</p>\n<b>c</b></html>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    assert [r[0] for r in df.select(documents.html_text(F.col("h"))).collect()] == ["A & B <ok> c", ""]


def test_references_are_read_as_html_5_reads_them(spark):
    names = [f"a&{n}{end}" for n in html5 for end in ("", "x", "; b")]
    numbers = [f"&#{n};" for n in (*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDCF, 0xFDD0, 0xFDEF, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**30)]
    numbers += ["&#x41;", "&#X1F600", "&#x0000000041z", "&#xFFFFFFFFFF;", "&#x;", "&#;", "&#", "&#x80", "&#13;"]
    odd = ["", "&", "&&", "no reference", "&amp;lt;", "&notit;", "&notin;", "&unknown;", "a & b &", "&ampamp;", "& lt;", "&\nlt;", "&<b", "&" + "q" * 40 + ";", "\u00e4&auml;\U0001f600&lt;"]
    texts = names + numbers + odd
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", documents.unescaped(F.col("t"))).collect())
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != html.unescape(t)] == []
    assert spark.createDataFrame([(None,)], "t string").select(documents.unescaped(F.col("t"))).first()[0] is None


def test_wide_spaces_are_squeezed(spark):
    df = spark.createDataFrame([("\u00a0a&nbsp;&ensp;\u2003b\u3000",)], "h string")
    assert df.select(documents.html_text(F.col("h"))).first()[0] == "a b"


def test_disclosure_table(spark):
    row = "<tr>" + "".join(f"<td>{c}</td>" for c in ("1", "01/31/2024", "Self", "{}", "Acme", "Stock", "Purchase", "$1,001 - $15,000", "x")) + "</tr>"
    html = "<table>" + row.format("AAPL") + row.format("--") + "<tr><td>few</td></tr></table>"
    pages = spark.createDataFrame([("u", html, "Doe, J (Senator)", D(2024, 2, 5))], "url string, html string, senator string, disclosure_date date")
    got = documents.disclosure_trades(pages).collect()
    assert len(got) == 1 and got[0]["ticker"] == "AAPL" and got[0]["transaction_date"] == D(2024, 1, 31) and got[0]["senator"] == "Doe, J"


def test_asset_cells(spark):
    cells = spark.createDataFrame([(x,) for x in ("Apple (AAPL) [ST]", "Ford (F)", "Berkshire (BRK/B)", "none", None)], "c string")
    assert [r[0] for r in cells.select(documents.cell_symbol(F.col("c"))).collect()] == ["AAPL", None, "BRK/B", None, None]


def test_notes(spark):
    notes = [
        ("a/tier_3/x.md", "---\ntitle: T\ntags: [One, two]\ndomains: two, three\naliases: [t2, 'the T']\nsummary: \"S: s\"\nfactors:\n  - mom\n  - '*'\n---\n\nbody"),
        ("a/Tier-2/p.md", "---\r\nretrieval_priority: Archive\r\ntags: A\r\n---\r\nb"),
        ("y.md", "no front matter"), ("z.md", None), ("tier1.md", "---\nnot closed"),
    ]
    got = {r["path"]: r for r in documents.parse_notes(spark.createDataFrame(notes, "path string, text string")).collect()}
    x = got["a/tier_3/x.md"]
    assert (x["tags"], x["factors"], x["tier"], x["title"], x["summary"], x["body"]) == (["one", "three", "two"], ["mom", "*"], 3, "T", "S: s", "T\n\nt2, the T\n\nS: s\n\nbody")
    assert (got["a/Tier-2/p.md"]["tier"], got["a/Tier-2/p.md"]["tags"], got["a/Tier-2/p.md"]["body"]) == (5, ["a"], "b")
    assert got["y.md"]["tags"] == [] and got["y.md"]["tier"] is None and got["z.md"]["body"] == "" and (got["tier1.md"]["tier"], got["tier1.md"]["body"]) == (1, "---\nnot closed")


@pytest.mark.parametrize("line", ["no colon", "title: a: b", "title: 'open", "title: [open", "title: @x", "\ttitle: x"])
def test_front_matter_that_is_not_well_formed_gives_no_tags(spark, line):
    note = f"---\ntags: [a]\n{line}\n---\nbody"
    got = documents.parse_notes(spark.createDataFrame([("p", note)], "path string, text string")).first()
    assert (got["tags"], got["title"], got["body"]) == ([], None, "body")


def test_embeddings_by_a_model_of_ones_own(spark):
    def model():
        loaded = object()  # what a worker loads once

        def predict(texts):
            assert loaded is not None and len(texts) <= 4
            return np.array([[len(t), t.count("a")] for t in texts], np.float32)

        return predict

    rows = [("a" * i,) for i in range(11)] + [(None,)]
    got = text.embed(spark.createDataFrame(rows, "chunk string").coalesce(1), model=model, batch=4).collect()
    assert [r["embedding"] for r in got] == [[len(c or ""), len(c or "")] for (c,) in rows]
    unit = text.hashing_model()(np.array(["one two two", "", None], object))
    assert np.linalg.norm(unit, axis=1).tolist() == pytest.approx([1, 0, 0]) and unit.shape == (3, text.DIMENSION)


def test_chunks(spark):
    df = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(900))), ("b", "one two"), ("c", None)], "path string, text string")
    got = sorted((r["path"], r["idx"], len(r["chunk"].split()), r["chunk"].split()[0]) for r in text.chunks(df).collect())
    assert got == [("a", 0, 400, "w0"), ("a", 1, 400, "w350"), ("a", 2, 200, "w700"), ("b", 0, 2, "one")]


def test_top_k_in_blocks(spark):
    rng = np.random.default_rng(0)
    vec = rng.normal(size=(80, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vec)], "id long, vec array<double>")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    got = {}
    for r in text.top_k(df, df.filter("id < 7"), 5, query_block=2, corpus_block=30).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = r["id"]
    for q in range(7):
        want = sorted(range(80), key=lambda i: (-(unit[q] @ unit[i]), i))[:5]
        assert [got[q][p] for p in range(1, 6)] == want
    assert text.top_k(df, df.limit(0), 5).count() == 0


def test_mentions(spark):
    names = spark.createDataFrame([("Acme Widgets", "ACME"), ("Ford", "F"), ("Cat", "CAT")], "name string, ticker string")
    docs = spark.createDataFrame([(1, "We sued acme widgets today. Later Acme Widgets won."), (2, "The cat sat. Ford is fine here"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ticker"], r["quote"], r["stance"]) for r in text.mentions(docs, names).collect())
    assert got == [(1, "ACME", "We sued acme widgets today.", "negative"), (2, "F", "Ford is fine here", "positive")]


def test_mentions_of_long_names_suffixes_and_common_words(spark):
    names = [("Seven Words Make This Company Name, Inc.", "LONG"), ("Acme Corp", "ACM"), ("Target Corporation", "TGT"), ("American International Group", "AIG"), ("Waste Management, Inc.", "WM"), ("AT&T Wireless Ltd.", "ATT"), ("Dell Technologies", "DELL")]
    docs = [(1, "In seven words\nmake this  company name we trust."), (2, "Acme said so. The target is American. Waste management is hard."), (3, "The American international group met AT&T wireless."), (4, "at t wireless is no name. Nor is Acmes."), (5, "Skip to content Dell"), (6, "We saw Dell's plant")]
    got = text.mentions(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "name string, ticker string"))
    assert {(r["doc_id"], r["ticker"]) for r in got.collect()} == {(1, "LONG"), (2, "ACM"), (3, "AIG"), (3, "ATT"), (6, "DELL")}
    many = spark.createDataFrame([(f"Maker{i} Works", f"M{i}") for i in range(12)], "name string, ticker string")
    said = spark.createDataFrame([(1, ". ".join(f"Maker{i} Works" for i in range(8))), (2, ". ".join(f"Maker{i} Works" for i in range(9)))], "doc_id long, text string")
    assert {r["doc_id"] for r in text.mentions(said, many).collect()} == {1}


def test_streams_are_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("20240105|AAPL|10|0|100|N\n20240105|AAPL|10|0|100|N\n")
    table, seen = feeds.PartTable(spark, f"file://{tmp_path}/t", feeds.SHORT_SCHEMA, feeds.SHORT_PART), feeds.PartTable(spark, f"file://{tmp_path}/s", feeds.COVERAGE_SCHEMA, feeds.COVERAGE_PART)
    run = lambda cp: feeds.stream_short_volume(spark, f"file://{tmp_path}/in", table, seen, f"file://{tmp_path}/{cp}").awaitTermination()
    run("c1")
    first = sorted(map(tuple, table.read().collect()))
    run("c2")
    assert sorted(map(tuple, table.read().collect())) == first == [(D(2024, 1, 5), "AAPL", 10, 100)]
    (tmp_path / "in" / "b.txt").write_text("20240105|AAPL|20|0|100|N\n20240108|AAPL|1|0|2|N\n")
    run("c1")
    assert sorted(map(tuple, table.read().collect())) == [(D(2024, 1, 5), "AAPL", 20, 100), (D(2024, 1, 8), "AAPL", 1, 2)]
    assert seen.read().count() == 2
    held = lambda: {p.name: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "t").glob("part=*")}
    before = held()
    (tmp_path / "in" / "c.txt").write_text("20240108|MSFT|1|0|2|N\n")
    run("c1")
    after = held()
    assert after["part=2024-01-05"] == before["part=2024-01-05"] and after["part=2024-01-08"] != before["part=2024-01-08"]  # untouched days stay as they are
    assert table.read().count() == 3


SCHEMA = "id long, member string, kind string, disclosure_date date, report_url string"


def _amended(rows):
    """By brute force: id to amended, over rows of one id each."""
    age = lambda r: (r["disclosure_date"] or "1900-01-01", r["report_url"] is not None, r["report_url"] or "", r["id"])
    return {r["id"]: True if any(age(o) > age(r) for o in rows if (o["member"], o["kind"]) == (r["member"], r["kind"])) else None for r in rows}


def test_disclosures_by_state(spark, tmp_path):
    """Late rows, known ids, null keys, dates and addresses, ties, and restarts from the checkpoint."""
    rng = np.random.default_rng(5)
    pick = lambda *values: values[rng.integers(len(values))]
    rows = [{"id": i, "member": pick("a", "b", None), "kind": pick("x", None, "y"), "disclosure_date": pick(None, "1899-01-01", "2024-01-01", "2024-02-01"), "report_url": pick("u", "v", "ü", None)} for i in range(60)]
    (tmp_path / "in").mkdir()
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    changes, known, before = f"file://{tmp_path}/changes", [], set()
    for n, batch in enumerate((rows[20:40], rows[:45], rows[:45], [], rows[10:] * 2)):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in batch))
        q = feeds.stream_disclosures(spark, f"file://{tmp_path}/in", SCHEMA, changes, ["member", "kind"], f"file://{tmp_path}/cp")
        q.awaitTermination()
        known = list({r["id"]: r for r in known + batch}.values())
        got = feeds.disclosures(spark, SCHEMA, changes).collect()
        assert {r["id"]: r["amended"] for r in got} == _amended(known) and len(got) == len(known)
        assert {r["id"]: (r["member"], r["report_url"]) for r in got} == {r["id"]: (r["member"], r["report_url"]) for r in known}
        # A batch reads its new file alone, and writes changes beside the earlier ones.
        assert q.lastProgress is None or all(str(tmp_path / "in") in s["description"] for s in q.lastProgress["sources"])
        plan = q._jsq.explainInternal(False)
        assert "TransformWithState" in plan and "/changes" not in plan
        now = {p.name for p in (tmp_path / "changes").glob("part-*")}
        assert before <= now
        before = now
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    ids = [r["id"] for r in spark.read.parquet(changes).collect()]
    assert max(ids.count(i) for i in ids) == 2  # at first, and when a newer one came


def test_disclosures_of_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("")
    feeds.stream_disclosures(spark, f"file://{tmp_path}/in", SCHEMA, f"file://{tmp_path}/changes", ["member"], f"file://{tmp_path}/cp").awaitTermination()
    assert feeds.disclosures(spark, SCHEMA, f"file://{tmp_path}/changes").count() == 0


@pytest.mark.parametrize("listed", [2_000, 1])
def test_an_upsert_reads_the_touched_partitions_alone(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(feeds, "LISTED_PARTS", listed)
    table = feeds.PartTable(spark, f"file://{tmp_path}/t", "k long, v long", "k % 4")
    merge = lambda old, new: replace_by_key(old, new, ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    table.upsert(rows(*((i, 0) for i in range(8)), (None, 0)), merge)
    files_of = lambda: {p.name: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "t").glob("part=*")}
    before = files_of()
    seen = []
    table.upsert(rows((1, 1), (6, 1), (None, 1)), lambda old, new: seen.append(old) or merge(old, new))
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted([(0, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (7, 0), (None, 1)], key=repr)
    same = {n for n, f in files_of().items() if before[n] == f}
    assert same == {"part=0", "part=3"}
    if listed > 1:
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [(part#" in plan and "Join" not in plan


def test_empty_result_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    assert files.replace_table(spark.range(3).toDF("x"), path)
    assert not files.replace_table(spark.range(0).toDF("x"), path)
    assert spark.read.parquet(path).count() == 3


def test_a_bucket_of_keys_takes_one_read_and_one_write_of_state(spark):
    from pyspark.sql.types import _parse_datatype_string

    class State:
        def __init__(self):
            self.rows, self.calls = [], []

        def get(self):
            self.calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            self.calls.append("put")
            self.rows = rows

        def getListState(self, *_):  # noqa: N802
            return self

    state = State()
    newest = feeds._Newest(_parse_datatype_string(SCHEMA), ["member", "kind"], "disclosure_date", "report_url")
    newest.init(state)
    run = lambda rows: list(newest.handleInputRows((0,), iter([(*r, 0) for r in rows]), None))
    first = run([(i, f"m{i % 50}", None, D(2024, 1, 1 + i // 50), "u") for i in range(100)])
    assert state.calls == ["get", "put"] and len(state.rows) == 50 and len(first) == 100
    late = run([(200, "m0", None, None, "u"), (201, "m1", None, D(2024, 3, 1), "u")])
    assert sorted((r[0], r[-1]) for r in late) == [(51, True), (200, True), (201, None)]
    assert state.calls == ["get", "put"] * 2 and len(state.rows) == 50
    assert run([(202, "m0", None, None, "u")])[0][-1] is True and state.calls[-1] == "get"


def test_cells_are_not_cleaned_where_rows_are_exploded(spark):
    pages = spark.createDataFrame([("u", "", "Doe", D(2024, 2, 5))], "url string, html string, senator string, disclosure_date date")
    plan = documents.disclosure_trades(pages).select("ticker", "amount")._jdf.queryExecution().optimizedPlan().toString()
    generate = plan[plan.index("Generate explode"):]
    assert "script|style" not in generate
