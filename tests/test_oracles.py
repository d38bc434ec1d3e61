"""Registered queries against DuckDB on the smallest tables. The driver compares all of them; these stand for each kind."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.plans import query_feeds, query_reports, query_research, registry  # noqa: F401
from tidemark.standins import STANDINS, TABLES, Feeds

SAMPLE = [
    "flagship_strongest_buying", "s4_short_volume_lines", "s8_disclosure_html", "s15_earliest_facts", "u2_terminal_upsert", "u7_mark_amended", "p1_p2_p4_p5_trade_columns", "p11_p12_p15_bands", "j3_fundamentals_asof",
    "j4_last_close_within", "j5_members_as_of", "a1_decayed_flow", "a2_short_pressure", "a3_split_factor", "a5_holding_moves", "e2_fund_events", "e3_w1_w2_insider_events", "w4_w7_x2_price_features", "x16_w10_newey_west",
    "v2_market_models", "v3_overlap_collapse", "c4_w11_trend", "c4_trend_over_all", "s5_insider_archives", "t2_swing_top", "u5_replace_by_key", "a6_upper_median_lag", "a14_j2_freshness", "r1_chunks", "r4_best_per_note",
    "r6_mentions", "d2_t1_live_composite", "g2_step_up", "g1_g3_gate", "w13_wilder_rsi", "v6_daily_path", "v7_price_reaction", "q1_ticker_context", "p12_metric_bands", "p2b_p2c_sign_dialects", "p6_p7_name_forms", "x13_cap_weighted_proxy",
    "a12_null_counts", "a12_ranked_beyond", "s3_sector_file", "s9_filing_index", "s17_missing_sessions", "k1_k2_snapshot_and_replace", "st1_short_volume_stream", "st2_disclosure_stream", "v5_event_study", "j10_nearest_prior", "j8_next_bar",
    "s12_entities", "s12_html_text", "s13_note_front_matter", "r3_embeddings", "d4_case_points", "d4_p11_cases",
]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime) and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        return str(v.date())
    return str(v) if isinstance(v, dt.date) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    names = sorted(df.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == names
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]})".replace(", when", ', "when"').replace("SELECT when", 'SELECT "when"')).fetchall()
    got = df.select(*(f"`{n}`" for n in names)).collect()
    assert sorted(repr(tuple(map(plain, r))) for r in got) == sorted(repr(tuple(map(plain, r))) for r in want)


@pytest.mark.parametrize("partitions", ["1", "6", "12"])
def test_trend_over_all_whatever_the_number_of_ranges(spark, partitions):
    """At sf0.01 two means lie halfway between two rounded values; sums of doubles by ranges took one or both down."""
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    columns = "thesis_id, author, reviewed_on, cumulative, rolling"
    want = con.sql(f"SELECT {columns} FROM ({registry.ORACLES['c4_trend_over_all']})").fetchall()
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = registry.QUERIES["c4_trend_over_all"](spark, folder).selectExpr(*columns.split(", ")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len(want) == 333 and sorted(map(tuple, got)) == sorted(want)


def test_live_composite_makes_prices_and_holdings_once(spark, data):
    """Prices and holdings are read from what was stored: of the feeds over lineitem only the facts, which have two uses, are in the plan."""
    live = query_research._live(Feeds(spark, data))
    assert live._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 2


def test_live_flows_store_no_day_out_of_reach(spark, data, monkeypatch):
    """Of the events only those that the windows to the live day hold are summed by day and stored."""
    kept = {}
    monkeypatch.setattr(ev, "stored", lambda df, label: kept.setdefault(label, df))
    query_research._live(Feeds(spark, data))
    ends = kept["daily-flows"].groupBy("source").agg(F.min("day").alias("first"), F.max("day").alias("last")).collect()
    live, reach = dt.date.fromisoformat(query_research._LIVE_DAY), {"congress": 365, "fund": 540}
    assert {r["source"] for r in ends} == set(reach)
    assert all(live - dt.timedelta(reach[r["source"]]) <= r["first"] and r["last"] < live for r in ends)


def test_in_reach_holds_the_windows_first_day_and_not_its_last(spark):
    days = ["2001-01-09", "2001-01-10", "2001-01-19", "2001-01-20", None]
    rows = spark.createDataFrame([(s, dt.date.fromisoformat(d) if d else None) for s in ("a", "b", "c") for d in days], "source string, when date")
    day = F.lit("2001-01-20").cast("date")
    got = ev.in_reach(rows, day, day, {"a": (5.0, 10), "b": (5.0, 11)}).collect()
    assert sorted((r["source"], str(r["when"])) for r in got) == [("a", days[1]), ("a", days[2]), ("b", days[0]), ("b", days[1]), ("b", days[2])]


def test_every_query_has_an_oracle():
    assert sorted(set(registry.QUERIES) - set(registry.ORACLES)) == []


def test_stand_ins_read_the_given_tables(duck):
    assert all(any(f"{{{t}}}" in sql for t in [*TABLES, *STANDINS]) for sql in STANDINS.values())
