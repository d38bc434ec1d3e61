"""What runs on groups of any size: ranges, running sums, decayed flows, column statistics, archives, blocked top-k, anchors."""

import datetime as dt
import io
import math
import random
import zipfile
from decimal import ROUND_HALF_UP, Decimal
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators import asof, calibration, ranks, screens, stats, text, upsert, xsection
from tidemark.operators import events as ev
from tidemark.sources import bundles, files

D = dt.date


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), i, rng.random()) for i in range(900)]
    return spark.createDataFrame(rows, "g string, v int, id int, x double").repartition(5)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_places_and_sums_equal_a_window(skewed, monkeypatch, bound):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", bound)
    w = Window.partitionBy("g").orderBy("v", "id")
    want = skewed.withColumn("place", F.row_number().over(w).cast("long")).withColumn("to", F.round(F.sum("x").over(w), 9))
    got = ranks.running_sums(skewed, ["v", "id"], {"to": "x"}, ("g",), parts=7).withColumn("to", F.round("to", 9))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    falling = ranks.numbered(skewed, [F.desc_nulls_last("v"), F.col("id")], parts=7).select("id", "place")
    order = Window.orderBy(F.desc_nulls_last("v"), "id")
    assert sorted(map(tuple, falling.collect())) == sorted(map(tuple, skewed.select("id", F.row_number().over(order)).collect()))
    share = ranks.percent_ranks(skewed, "v", ("g",)).select("id", F.round("percent", 9))
    assert sorted(map(tuple, share.collect())) == sorted(map(tuple, skewed.select("id", F.round(F.percent_rank().over(Window.partitionBy("g").orderBy("v")), 9)).collect()))
    assert ranks.numbered(skewed.filter("false"), ["v"]).count() == 0


def test_no_task_holds_a_large_group(spark):
    """One group of all rows: its rows stay in as many ranges as there are partitions."""
    held, starts = ranks.ranges(spark.range(40_000).select(F.lit("one").alias("g"), "id"), ["id"], ("g",), parts=16)
    counts = [r["_count"] for r in starts.collect()]
    assert len(counts) == 16 and max(counts) < 3 * 40_000 / 16 and sum(counts) == 40_000


def test_rank_correlation_by_ranges(skewed):
    rows = skewed.filter("g is not null").select("g", "v", "x", F.col("id").alias("ticker"))
    a, b = (xsection.rank_ic(rows, "v", "x", ("g",), spread=s).orderBy("g").collect() for s in (False, True))
    assert [(r["g"], r["n"]) for r in a] == [(r["g"], r["n"]) for r in b]
    assert [r["ic"] for r in a] == pytest.approx([r["ic"] for r in b])


def test_case_points_are_ordered_by_strength_and_hold_the_note_of_their_factor(spark):
    rows = spark.createDataFrame([("A", 0.5, 2.0, -0.5, None), ("B", 0.49, -1.0, -3.0, -1.0)], "ticker string, z_a double, z_b double, z_c double, z_d double")
    notes = spark.createDataFrame([("z_b", "n2", 0.9), ("z_c", "n3", 0.8), ("other", "n4", 0.7)], "factor string, note string, similarity double")
    got = sorted(tuple(r) for r in screens.case_points(rows, ["z_a", "z_b", "z_c", "z_d"], notes).select("ticker", "side", "place", "factor", "note").collect())
    assert got == [("A", "bull", 1, "z_b", "n2"), ("A", "bull", 2, "z_a", None), ("A", "risk", 1, "z_c", "n3"), ("B", "risk", 1, "z_c", "n3"), ("B", "risk", 2, "z_b", "n2"), ("B", "risk", 3, "z_d", None)]
    assert screens.case_points(rows, ["z_a"]).columns == ["ticker", "side", "place", "factor", "z"]
    text_ = spark.createDataFrame([("---\ntags: a\n---\nbody  of\nthe note" + "x" * 300,)], "t string").select(screens.preview(F.col("t"))).first()[0]
    assert text_.startswith("body of the notexx") and len(text_) == 240


def test_forced_names_keep_their_true_rank(spark):
    rows = spark.createDataFrame([("A", 1.0), ("B", 3.0), ("C", None), ("D", 3.0)], "ticker string, score double")
    got = screens.ranked_with_forced(rows, "score", 2, spark.createDataFrame([("C",)], "ticker string")).select("ticker", "rank", "forced")
    assert sorted(map(tuple, got.collect())) == [("B", 1, False), ("C", 4, True), ("D", 2, False)]


# Decayed flows


def test_flows_over_thirty_years_keep_their_digits(spark):
    """Against exact sums of every window: large old events beside small new ones, events on both ends, silent windows."""
    rng = random.Random(8)
    horizons = {"a": (90.0, 180), "b": (365.0, 730)}
    start = D(1990, 1, 1)
    events = [(s, t, start + dt.timedelta(rng.randrange(30 * 365)), rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 7)) for s in horizons for t in ("X", "Y") for _ in range(400)]
    dates = [D(1990 + y, m, 1) for y in range(31) for m in (1, 4, 7, 10)]
    events += [("a", "Z", D(1995, 1, 1), 5.0), ("a", "Z", D(1995, 1, 1), 7.0), ("b", "Z", D(1993, 1, 1), 3.0), ("other", "Z", D(1995, 1, 1), 1.0), ("a", "Z", None, 1.0)]
    got = ev.decayed_flows(spark.createDataFrame([(d,) for d in dates], "as_of date"), spark.createDataFrame(events, "source string, ticker string, when date, signed_weight double"), horizons)
    got = {(r["as_of"], r["ticker"], r["source"]): r["flow"] for r in got.collect()}
    want, size = {}, {}
    for s, (h, w) in horizons.items():
        for t in "XYZ":
            own = [(when, x) for s2, t2, when, x in events if (s2, t2) == (s, t) and when]
            for d in dates:
                if held := [x * 0.5 ** ((d - when).days / h) for when, x in own if d - dt.timedelta(w) <= when < d]:
                    want[d, t, s], size[d, t, s] = math.fsum(held), max(map(abs, held))
    assert set(got) == set(want)
    # what a difference of running sums can lose is what the whole history outweighs the window by
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(size[k], 1.0) for k in want)
    assert got[D(1995, 4, 1), "Z", "a"] == pytest.approx(12.0 * 0.5 ** (90 / 90.0)) and (D(1995, 1, 1), "Z", "a") not in got


def test_factors_restate_through_today_and_keep_negative_equity(spark):
    rows = spark.createDataFrame([("A", D(2020, 6, 1), 10.0), ("B", D(2020, 6, 1), 10.0)], "ticker string, as_of date, close double")
    facts = spark.createDataFrame([("A", D(2019, 12, 31), D(2020, 2, 1), 2.0, -5.0, -10.0), ("B", D(2019, 12, 31), D(2020, 2, 1), 2.0, 5.0, 0.0)], "ticker string, period_end date, filing_date date, eps double, net_income double, equity double")
    splits = spark.createDataFrame([("A", D(2021, 1, 1), 2.0), ("B", D(2020, 1, 1), 4.0)], "ticker string, date date, ratio double")
    now = {r["ticker"]: (r["value"], r["quality"]) for r in ev.fundamental_factors(rows, facts, splits).collect()}
    assert now == {"A": (0.1, 0.5), "B": (0.2, None)}
    then = {r["ticker"]: r["value"] for r in ev.fundamental_factors(rows, facts, splits, F.lit("2020-12-31").cast("date")).collect()}
    assert then == {"A": 0.2, "B": 0.2}


# Statistics


def test_normal_distribution_in_columns(spark):
    nd = NormalDist()
    ts = [0.0, 1e-9, 0.3, 1.0, 1.96, 2.5, 4.2, 6.9, 7.0710678, 7.1, 8.0]
    ps = [0.5, 0.4999, 0.08, 0.0751, 0.0749, 0.025, 1e-4, 1e-9, 1e-12, 1e-14, 0.9, 0.9999, 0.6]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ts], "t double").select(normal.two_sided_p(F.col("t"))).collect()]
    assert got == pytest.approx([2 * nd.cdf(-t) for t in ts], rel=1e-9, abs=1e-12)
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal.upper_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([-nd.inv_cdf(p) for p in ps], rel=1e-12, abs=1e-12)
    ns = [1, 2, 31, 32, 100, 10_000]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long").select(normal.harmonic(F.col("n"))).collect()]
    assert got == pytest.approx([math.fsum(1 / k for k in range(1, n + 1)) for n in ns], rel=1e-14)


def test_step_up_of_a_million_tests(spark):
    """A family of 10^6 tests with 3,000 strong ones, and a small one; the sweep equals a loop's."""
    n = 1_000_000
    strong = F.when(F.col("id") < 3000, 5.0 + F.col("id") / 1000.0).otherwise(F.abs(F.sin(F.col("id") * 12.9898)) * 3.5)
    big = spark.range(n).select(F.lit("big").alias("family"), F.lpad(F.col("id").cast("string"), 7, "0").alias("name"), strong.alias("t"))
    out = stats.step_up(big.union(spark.createDataFrame([("small", "x", 4.0), ("small", "y", None)], "family string, name string, t double")))
    got = {r["family"]: (r["n"], r["passed"]) for r in out.groupBy("family").agg(F.max("n").alias("n"), F.count_if("passes").alias("passed")).collect()}
    t = -np.sort(-np.array([r[0] for r in big.select("t").collect()]))
    c = float(np.sum(1 / np.arange(1, n + 1)))
    nd = NormalDist()
    hits = [k for k in (*range(1, 3300), n) if 2 * nd.cdf(-t[k - 1]) <= 0.05 * k / (n * c)]
    assert got == {"big": (n, max(hits)), "small": (1, 1)}


def test_trend_over_all_reviews(spark):
    rng = random.Random(3)
    rows = [(f"author{rng.randrange(3)}", i, D(2024, 1, 1) + dt.timedelta(rng.randrange(20)), rng.choice([0.04, 0.16, 0.64])) for i in range(95)] + [("x", 999, None, 1.0)]
    got = calibration.trend_over_all(spark.createDataFrame(rows, "author string, thesis_id int, reviewed_on date, loss double"), block=16)
    want, losses = {}, []
    for _, i, _, loss in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1])):
        losses.append(loss)
        want[i] = (sum(losses) / len(losses), sum(losses[-10:]) / 10 if len(losses) >= 10 else None)
    assert {r["thesis_id"]: (pytest.approx(r["cumulative"]), r["rolling"] and pytest.approx(r["rolling"])) for r in got.collect()} == want


def test_trend_over_all_is_exact_however_rows_are_dealt(spark):
    """A mean of losses in steps of 0.04 may lie halfway between two rounded values; it goes up, as in exact arithmetic."""
    rng = random.Random(5)
    losses = [(rng.randint(1, 5) / 5 - rng.randint(0, 1)) ** 2 for _ in range(6000)]
    rows = [("a", i, D(2010, 1, 1) + dt.timedelta(i), x) for i, x in enumerate(losses)]
    df = spark.createDataFrame(rows, "author string, thesis_id int, reviewed_on date, loss double").repartition(8)
    got = {r[0]: r[1] for r in calibration.trend_over_all(df).select("thesis_id", F.round("cumulative", 6)).collect()}
    total, ties = 0, 0
    for i, x in enumerate(losses):
        total += round(25 * x)
        exact = Decimal(total) / 25 / (i + 1)
        ties += exact * 10**7 % 10 == 5
        assert got[i] == float(exact.quantize(Decimal("0.000001"), ROUND_HALF_UP))
    assert ties > 2


def test_replacing_by_key_is_the_same_in_any_order(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "k string, at int, v double")
    new = spark.createDataFrame([("A", 5, 3.0), ("A", 7, 1.0), ("A", 7, 0.5), ("C", 1, None)], "k string, at int, v double")
    for df in (new, new.orderBy("v"), new.orderBy(F.desc("v"))):
        assert sorted(map(tuple, upsert.replace_by_key(old, df, ["k"], ["at"]).collect())) == [("A", 7, 1.0), ("B", 1, 2.0), ("C", 1, None)]


# Sources


def _zip(path, members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    path.write_bytes(out.getvalue())


def test_insider_bundle_from_archives(spark, tmp_path, monkeypatch):
    head = "ACCESSION_NUMBER\tFILING_DATE\tDOCUMENT_TYPE\tISSUERCIK\tISSUERTRADINGSYMBOL\n"
    owner, trade = "ACCESSION_NUMBER\tRPTOWNERCIK\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\n", "ACCESSION_NUMBER\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\tTRANS_ACQUIRED_DISP_CD\n"
    subs = head + "a1\t05-FEB-2024\t4\t1\tabc\na2\t05-FEB-2024\t4\t1\tABC\na3\t05-FEB-2024\t3\t1\tABC\na4\tbad\t4\t1\tABC\na5\t06-FEB-2024\t4\t2\tZZZ\n"
    owners = owner + 'a1\t900\tFirst "of" file\tDirector\na1\t1\tSmaller CIK\tOfficer\n'
    trades = trade + "".join(f"{a}\t01-FEB-2024\t{c}\t{s}\t{p}\t{d}\n" for a, c, s, p, d in [("a1", "P", "10", "2.5", "A"), ("a1", "S", "10", "2.5", "D"), ("a2", "P", "4", "1", ""), ("a2", "P", "0", "1", "A"), ("a2", "P", "x", "1", "A"), ("a3", "P", "1", "1", "A"), ("a4", "P", "1", "1", "A"), ("a5", "P", "1", "1", "A"), ("a1", "P", "1", "1", "D")]) + "a1\tnever\tP\t1\t1\tA\n"
    _zip(tmp_path / "2024q1.zip", {"SUBMISSION.tsv": subs, "REPORTINGOWNER.tsv": owners, "NONDERIV_TRANS.tsv": trades})
    _zip(tmp_path / "2024q2.zip", {"SUBMISSION.tsv": head + "b1\t07-MAY-2024\t4\t1\tABC\n", "REPORTINGOWNER.tsv": owner, "NONDERIV_TRANS.tsv": trade + "b1\t06-MAY-2024\tP\t2\t3\n"})
    (tmp_path / "notes.txt").write_text("no archive")
    universe = spark.createDataFrame([("ABC",)], "ticker string")
    got = files.insider_buys(*bundles.insider_tables(spark, str(tmp_path)), universe).select("filer", "role", "filing_date", "shares", "value")
    assert sorted(map(tuple, got.collect())) == [("", "other", D(2024, 2, 5), 4.0, 4.0), ("", "other", D(2024, 5, 7), 2.0, 6.0), ('First "of" file', "director", D(2024, 2, 5), 10.0, 25.0)]
    lines = bundles.read_bundle(spark, f"file://{tmp_path}", "REPORTINGOWNER.tsv", "line long, RPTOWNERNAME string, NOT_THERE string")
    assert lines.rdd.getNumPartitions() == 2 and sorted(map(tuple, lines.collect())) == [(1, 'First "of" file', None), (2, "Smaller CIK", None)]
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    schema = bundles.INSIDER_TABLES["SUBMISSION.tsv"]
    assert bundles.read_bundle(spark, str(tmp_path), "SUBMISSION.tsv", schema, "DROPMALFORMED").count() == 6
    with pytest.raises(Exception, match="no archive with a member"):
        bundles.read_bundle(spark, str(tmp_path), "SUBMISSION.tsv", schema).count()


# Text


def test_top_k_of_many_queries_in_one_plan(spark):
    rng = np.random.default_rng(1)
    vec = np.round(rng.normal(size=(700, 6)), 1)
    vec[5], vec[6], vec[7] = 0, vec[8], vec[8]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vec)] + [(9999, None)], "id long, vec array<float>")
    got = {}
    for r in text.top_k(df, df, 4, query_block=64, corpus_block=100).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["id"], r["similarity"]))
    vec = vec.astype(np.float32).astype(np.float64)
    unit = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-30)
    sims = np.round(unit @ unit.T, 12)
    assert set(got) == set(range(700))
    for q, rows in got.items():
        assert [i for _, i, _ in sorted(rows)] == sorted(range(700), key=lambda i: (-sims[q, i], i))[:4]
    plan = text.top_k(df, df, 4, query_block=1, corpus_block=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan
    with pytest.raises(Exception, match="of 6 numbers and rows of 2|of 2 numbers"):
        text.top_k(df, spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<float>"), 2).count()


def test_top_k_meets_every_cell_whatever_the_partitions(spark):
    """Cells of both sides gather in the same task also where the engine doesn't put small partitions together."""
    vec = np.random.default_rng(2).normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vec)], "id long, vec array<float>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        rows = text.top_k(df, df.filter("id < 20"), 3, query_block=8, corpus_block=60).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    vec = vec.astype(np.float32).astype(np.float64)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    sims = unit @ unit.T
    assert sorted((r["query_id"], r["place"], r["id"]) for r in rows) == [(q, p + 1, int(i)) for q in range(20) for p, i in enumerate(np.argsort(-sims[q])[:3])]


def test_window_events_beyond_the_broadcast(spark, monkeypatch):
    dates = spark.createDataFrame([(D(2024, m, 1),) for m in range(1, 13)], "as_of date")
    events = spark.createDataFrame([("x", "A", D(2023, 12, 1) + dt.timedelta(d), 1.0) for d in range(300)], "source string, ticker string, when date, signed_weight double")
    few = sorted(map(tuple, asof.window_events(dates, events, 40).collect()))
    monkeypatch.setattr(asof, "BROADCAST_DATES", 0)
    assert sorted(map(tuple, asof.window_events(dates, events, 40).collect())) == few and len(few) > 300


def test_feeds_of_a_run_are_made_once(spark, data):
    """What a run reads of its feeds is stored, so that no step goes back to the tables that they are made from."""
    from tidemark.plans.query_research import _inputs
    from tidemark.standins import Feeds

    held = _inputs(Feeds(spark, data))
    for name in ("prices", "membership", "events", "shorts", "fundamentals"):
        plan = getattr(held, name)._jdf.queryExecution().executedPlan().toString()
        assert "l_suppkey" not in plan and "o_orderkey" not in plan, name


def test_the_grid_is_dealt_by_ticker(spark):
    """One shuffle, by ticker, before the grid's cells are made; gaps, equal rows and a single bar."""
    from tidemark.operators import panel

    rows = [("a", 1, 1.0), ("a", 4, 4.0), ("a", 4, 5.0), ("b", 2, 2.0), ("c", 3, None), ("c", 5, 6.0)]
    prices = spark.createDataFrame([(t, D(2024, 1, d), c) for t, d, c in rows], "ticker string, date date, close double")
    grid = panel.dense_grid(prices, panel.calendar(prices))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(ticker") == 1
    got = sorted(((r["ticker"], r["date"].day, r["bar_ix"], r["close"]) for r in grid.collect()), key=repr)
    assert got == sorted([("a", 1, 0, 1.0), ("a", 2, 1, None), ("a", 4, 2, 4.0), ("a", 4, 2, 5.0), ("b", 2, 1, 2.0), ("c", 5, 3, 6.0)], key=repr)
