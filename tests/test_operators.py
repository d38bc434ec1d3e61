import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, audit, calibration, eventstudy, panel, portfolio, screens, stats, upsert, xsection
from tidemark.operators import events as ev

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_as_of_is_strict_bounded_and_breaks_ties_by_row(spark):
    left = spark.createDataFrame([("A", D(2025, 6, 27)), ("A", D(2025, 6, 28)), ("B", D(2025, 6, 28))], "ticker string, as_of date")
    facts = spark.createDataFrame([("A", D(2025, 6, 27), D(2025, 5, 31), 9.9), ("A", D(2025, 6, 27), D(2023, 9, 29), -2.17), ("A", D(2025, 1, 1), D(2024, 12, 31), None)], "ticker string, filed date, period date, eps double")
    got = asof.as_of(left, facts, ["ticker"], "as_of", "filed", ["period", "eps"], strict=True, ties=["period"])
    assert rows(got, "ticker", "as_of") == [("A", D(2025, 6, 27), D(2024, 12, 31), None), ("A", D(2025, 6, 28), D(2025, 5, 31), 9.9), ("B", D(2025, 6, 28), None, None)]
    near = asof.as_of(left, facts, ["ticker"], "as_of", "filed", ["eps"], within_days=0, ties=["period"])
    assert rows(near, "ticker", "as_of") == [("A", D(2025, 6, 27), 9.9), ("A", D(2025, 6, 28), None), ("B", D(2025, 6, 28), None)]


def test_membership(spark):
    snaps = spark.createDataFrame([(D(2020, 1, 1), "A"), (D(2020, 12, 21), "A"), (D(2020, 12, 21), "TSLA")], "snap_date date, ticker string")
    days = spark.createDataFrame([(D(2020, 12, 20),), (D(2020, 12, 21),)], "day date")
    assert rows(asof.members_as_of(days, snaps), "day", "ticker") == [(D(2020, 12, 20), "A"), (D(2020, 12, 21), "A"), (D(2020, 12, 21), "TSLA")]
    with pytest.raises(ValueError):
        asof.members_as_of(spark.createDataFrame([(D(2019, 1, 1),)], "day date"), snaps)
    span = lambda a, b: rows(asof.members_in_window(snaps, F.lit(a).cast("date"), F.lit(b).cast("date")), "ticker")
    assert span("2020-05-01", "2020-06-01") == [("A",)] and span("2020-05-01", "2021-06-01") == [("A",), ("TSLA",)]


def test_window_events_exclude_the_date_itself(spark):
    dates = spark.createDataFrame([(D(2024, 3, 1),)], "as_of date")
    events = spark.createDataFrame([("x", "A", D(2024, 3, 1), 5.0), ("x", "A", D(2024, 2, 29), 1.0), ("x", "A", D(2024, 1, 31), 2.0), ("x", "A", D(2024, 1, 30), 4.0)], "source string, ticker string, when date, signed_weight double")
    assert rows(asof.window_events(dates, events, 30).select("signed_weight"), "signed_weight") == [(1.0,), (2.0,)]
    flow = ev.decayed_flow(dates, events, "x", 30, 30).first()["flow"]
    assert flow == pytest.approx(0.5 ** (1 / 30) + 2 * 0.5)


def test_next_bar_and_collapse(spark):
    cal = spark.createDataFrame([(D(2024, 1, 1 + 2 * i), i) for i in range(5)], "date date, bar_ix int")
    events = spark.createDataFrame([("A", D(2024, 1, 2)), ("A", D(2024, 1, 3)), ("A", D(2024, 1, 9)), ("A", D(2024, 1, 10))], "ticker string, when date")
    got = asof.next_bar(events, cal)
    assert sorted(r["event_ix"] for r in got.collect()) == [1, 1, 4]
    assert rows(asof.overlap_collapse(got, 3), "event_ix") == [("A", 1, 1), ("A", 4, 1)]


@pytest.mark.parametrize(("old", "new", "want"), [("EXIT", "TRIM", "EXIT"), ("ADD", "TRIM", "TRIM"), ("EXIT", "EXIT", "EXIT")])
def test_terminal_state(spark, old, new, want):
    a = spark.createDataFrame([("1", old, 10, "keep")], "id string, action string, shares int, issuer string")
    b = spark.createDataFrame([("1", new, 20, "other"), ("2", "NEW", 5, "n")], "id string, action string, shares int, issuer string")
    got = rows(upsert.terminal_upsert(a, b, ["action", "shares"]), "id")
    assert got == [("1", want, 10 if (old, new) == ("EXIT", "TRIM") else 20, "keep"), ("2", "NEW", 5, "n")]


def test_upserts(spark):
    a = spark.createDataFrame([("A", D(2024, 1, 2), 1.0), ("B", D(2024, 1, 2), 3.0)], "ticker string, filed date, eps double")
    b = spark.createDataFrame([("A", D(2024, 1, 1), None), ("C", D(2024, 1, 3), 4.0)], "ticker string, filed date, eps double")
    assert rows(upsert.earliest_filing_upsert(a, b, ["ticker"], "filed", ["eps"]), "ticker") == [("A", D(2024, 1, 1), 1.0), ("B", D(2024, 1, 2), 3.0), ("C", D(2024, 1, 3), 4.0)]
    assert rows(upsert.replace_by_key(a, b, ["ticker"]), "ticker")[0] == ("A", D(2024, 1, 1), None)
    state, added = upsert.insert_new(a.withColumnRenamed("ticker", "id"), b.withColumnRenamed("ticker", "id"))
    assert added.count() == 1 and state.count() == 3


def test_amendments_mark_all_but_the_newest(spark):
    r = spark.createDataFrame([("m", None, D(2024, 1, 1), "u1"), ("m", None, D(2024, 2, 1), "u2"), ("n", "x", None, "u3")], "member string, amount string, disclosure_date date, report_url string")
    assert rows(upsert.mark_amended(r, ["member", "amount"]).select("report_url", "amended"), "report_url") == [("u1", True), ("u2", None), ("u3", None)]


def test_drift_and_audit(spark):
    bars = [("A", D(2024, 1, i), 100.0) for i in range(1, 13)] + [("B", D(2024, 1, i), 100.0) for i in range(1, 13)]
    old = spark.createDataFrame(bars, "ticker string, date date, close double")
    new = old.withColumn("close", F.when((F.col("ticker") == "A") & (F.dayofmonth("date") == 10), 101.0).when((F.col("ticker") == "B") & (F.dayofmonth("date") == 11), 150.0).otherwise(F.col("close")))
    assert rows(upsert.adjustment_drift(old, new), "ticker") == [("A",)]
    bad = spark.createDataFrame([("BAD!!",), ("GMBL",), ("AAPL",), (None,)], "ticker string")
    assert tuple(audit.bad_symbols(bad, bad.filter("ticker = 'AAPL'")).first()) == (1, 2, 1)
    assert rows(audit.event_yield({"a": (bad, bad.limit(1)), "b": (bad.limit(0), bad.limit(0))}), "source") == [("a", 4, 1, 0.25)]


def test_exit_is_sized_at_the_last_close(spark):
    prices = spark.createDataFrame([("A", D(2024, 5, 8), 200.0), ("B", D(2024, 4, 1), 50.0)], "ticker string, date date, close double")
    moves = spark.createDataFrame([("A", D(2024, 5, 10), "EXIT", 1000.0, 0.0), ("B", D(2024, 5, 10), "EXIT", 10.0, 0.0), ("C", D(2024, 5, 10), "ADD", 0.0, 50000.0)], "ticker string, filing_date date, action string, prev_shares double, value double")
    events, dropped = ev.fund_events(moves, prices)
    assert {r["ticker"]: r["signed_weight"] for r in events.collect()} == {"A": pytest.approx(-0.5 * math.log(200001)), "C": pytest.approx(math.log(50001))}
    assert dropped.first()[0] == 1


def test_holding_moves(spark):
    h = spark.createDataFrame([("m", D(2024, 1, 1), "A", 10.0, 1.0), ("m", D(2024, 1, 1), "B", 10.0, 1.0), ("m", D(2024, 1, 1), "C", 5.0, 1.0), ("m", D(2024, 4, 1), "A", 20.0, 2.0), ("m", D(2024, 4, 1), "C", 5.0, 1.0), ("m", D(2024, 4, 1), "D", 1.0, 9.0)], "manager string, filing_date date, ticker string, shares double, value double")
    got = rows(ev.holding_moves(h).select("ticker", "action", "pct_change"), "ticker")
    assert got == [("A", "ADD", 1.0), ("B", "EXIT", -1.0), ("D", "NEW", None)]


def test_splits_through_a_day(spark):
    facts = spark.createDataFrame([("A", D(2024, 1, 1))], "ticker string, filing_date date")
    splits = spark.createDataFrame([("A", D(2024, 1, 1), 2.0), ("A", D(2024, 2, 1), 4.0), ("A", D(2024, 3, 1), 5.0), ("A", D(2024, 2, 2), 0.0)], "ticker string, date date, ratio double")
    assert ev.split_factor(facts, splits, F.lit("2024-02-15").cast("date")).first()["split_factor"] == 4.0


def test_z_and_demean(spark):
    r = spark.createDataFrame([(0, f"t{i}", float(v)) for i, v in enumerate([1, 2, 3, 4, 100])] + [(1, "x", 1.0)] + [(2, f"e{i}", 7.0) for i in range(5)], "month_ix int, ticker string, value double")
    got = {(m, t): z for m, t, _, z in rows(xsection.winsor_z(r, by=("month_ix",)), "month_ix", "ticker")}
    x = np.array([1, 2, 3, 4, 100.0])
    assert got[(0, "t0")] == pytest.approx((1 - x.mean()) / x.std()) and got[(1, "x")] is None and got[(2, "e0")] == 0
    s = spark.createDataFrame([(0, f"a{i}", "one", float(i)) for i in range(6)] + [(0, "b", "two", 10.0), (0, "c", None, 20.0), (0, "d", "one", None)], "month_ix int, ticker string, sector string, fwd double")
    dm = {r["ticker"]: r["fwd_dm"] for r in xsection.sector_demean(s).collect()}
    whole = (15 + 30) / 8
    assert dm["a0"] == -2.5 and dm["b"] == pytest.approx(10 - whole) and dm["c"] == pytest.approx(20 - whole) and dm["d"] is None


def numpy_nw(x):
    x = np.asarray(x)
    n = len(x)
    if n < 3:
        return 0.0
    lag = int(max(1, min(math.floor(4 * (n / 100) ** (2 / 9)), n - 1)))
    e = x - x.mean()
    lrv = (e @ e) / n + sum(2 * (1 - k / (lag + 1)) * (e[k:] * e[:-k]).mean() for k in range(1, lag + 1))
    return x.mean() / math.sqrt(lrv / n) if lrv > 1e-300 else 0.0


def test_newey_west_against_numpy(spark):
    rng = np.random.default_rng(3)
    ar = [0.0]
    for e in rng.normal(0.1, 1, 239):
        ar.append(0.6 * ar[-1] + e)
    series = {"ar": ar, "white": list(rng.normal(0.2, 1, 400)), "two": [1.0, 2.0], "flat": [2.0] * 10}
    long = spark.createDataFrame([(k, i, float(v)) for k, xs in series.items() for i, v in enumerate(xs)], "series string, month_ix int, value double")
    got = {r["series"]: r["t"] for r in stats.newey_west(long).collect()}
    for k, xs in series.items():
        assert got[k] == pytest.approx(numpy_nw(xs), abs=1e-9), k
    assert abs(got["ar"]) < abs({r["series"]: r["t"] for r in stats.naive_t(long).collect()}["ar"])


def test_newey_west_in_blocks(spark, monkeypatch):
    """Long series in several blocks, with repeats of the first order column, against a loop."""
    rng = random.Random(5)
    rows, want = [], {}
    for name, n in (("a", 500), ("b", 90), ("c", 3)):
        x = []
        for i in range(n):
            x.append(0.6 * (x[-1] if x else 0) + rng.gauss(0.1, 1))
            rows.append((name, i // 4, f"t{i % 4}", x[-1]))
        m, lag = sum(x) / n, max(1, min(int(4 * (n / 100) ** (2 / 9)), n - 1))
        e = [v - m for v in x]
        g = [sum(e[i] * e[i - k] for i in range(k, n)) / (n - k) for k in range(lag + 1)]
        lrv = g[0] + sum(2 * (1 - k / (lag + 1)) * g[k] for k in range(1, lag + 1))
        want[name] = m / math.sqrt(lrv / n) if lrv > 0 else 0.0
    df = spark.createDataFrame(rows, "series string, event_ix long, ticker string, value double").repartition(7)
    for block in (stats.BLOCK, 23):
        monkeypatch.setattr(stats, "BLOCK", block)
        got = {r["series"]: r["t"] for r in stats.newey_west(df, order=("event_ix", "ticker")).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_overlap_collapse_counts_repeats_and_long_lists(spark):
    rng = random.Random(6)
    places = [rng.randint(0, 4000) for _ in range(3000)]
    got = asof.overlap_collapse(spark.createDataFrame([("a", p) for p in places], "ticker string, event_ix long"), 6).collect()
    kept = []
    for p in sorted(places):
        if not kept or p - kept[-1] >= 6:
            kept.append(p)
    assert sorted(r["event_ix"] for r in got) == kept and {r["n_collapsed"] for r in got} == {len(places) - len(kept)}


def test_correlation_of_series(spark):
    base = [0.1, 0.3, -0.2, 0.4, 0.0, 0.2, -0.1]
    long = [("a", i, v) for i, v in enumerate(base)] + [("b", i, v) for i, v in enumerate(base)] + [("c", i, -v) for i, v in enumerate(base)] + [("d", i, None) for i in range(7)]
    got = {(r["a"], r["b"]): r["corr"] for r in stats.series_correlation(spark.createDataFrame(long, "series string, month_ix int, value double")).collect()}
    assert got[("a", "b")] == pytest.approx(1) and got[("a", "c")] == pytest.approx(-1) and ("a", "d") not in got


def test_bars_of_many_tests():
    assert (stats.step_up_t(13, 1), stats.bonferroni_t(13)) == (pytest.approx(3.237, abs=5e-4), pytest.approx(2.891, abs=5e-4))
    assert (stats.step_up_t(316, 1), stats.bonferroni_t(316)) == (pytest.approx(4.215, abs=5e-4), pytest.approx(3.778, abs=5e-4))


def test_step_up_passes_all_ranks_below_the_last(spark):
    t = [("f", "a", 4.0), ("f", "b", 2.75), ("f", "c", 2.7), ("f", "d", 0.1)]
    got = {r["name"]: r["passes"] for r in stats.step_up(spark.createDataFrame(t, "family string, name string, t double")).collect()}
    p = [2 * (1 - NormalDist().cdf(abs(x[2]))) for x in t]
    k = max(i + 1 for i in range(4) if p[i] <= (i + 1) * 0.05 / (4 * stats.harmonic(4)))
    assert got == {n: i < k for i, n in enumerate("abcd")}


def test_rsi_against_a_loop(spark):
    random.seed(5)
    closes = [100.0]
    for _ in range(40):
        closes.append(closes[-1] * (1 + random.uniform(-0.03, 0.03)))
    bars = spark.createDataFrame([("A", D(2024, 1, 1) + dt.timedelta(i), c) for i, c in enumerate(closes)], "ticker string, date date, close double")
    want, gain, loss = [], 0.0, 0.0
    for i, (a, b) in enumerate(zip([None, *closes], closes, strict=False)):
        if a is None:
            want.append(None)
            continue
        up, down = max(b - a, 0), max(a - b, 0)
        gain, loss = (gain + up / 14, loss + down / 14) if i <= 14 else ((gain * 13 + up) / 14, (loss * 13 + down) / 14)
        want.append(100 - 100 / (1 + gain / loss) if i >= 14 else None)
    got = [r["rsi"] for r in panel.wilder_rsi(bars).orderBy("date").collect()]
    assert got == [None if w is None else pytest.approx(w) for w in want]


def test_swing_metrics(spark):
    mk = lambda t, f: [(t, D(2024, 1, 1) + dt.timedelta(i), f(i), f(i) * 1.02, f(i) * 0.98, 1e6) for i in range(40)]
    bars = mk("OSC", lambda i: 100.0 + (8 if i % 2 else -8)) + mk("TREND", lambda i: 100.0 + 0.3 * i) + [("SHORT", D(2024, 1, i), 1.0, 1.1, 0.9, 1.0) for i in range(1, 6)]
    got = {r["ticker"]: r for r in panel.swing_metrics(spark.createDataFrame(bars, "ticker string, date date, close double, high double, low double, volume double"), 40).collect()}
    assert set(got) == {"OSC", "TREND"} and got["OSC"]["oscillation"] > 0.9 and got["TREND"]["oscillation"] < 0.01 and got["OSC"]["direction_changes"] == 38 and got["TREND"]["direction_changes"] == 0


def test_cost_drag_of_static_deciles(spark):
    months, names = 12, 120
    r = spark.createDataFrame([(m, f"t{i:03d}", float(i), 0.001 * i) for m in range(months) for i in range(names)], "month_ix int, ticker string, full double, fwd double")
    top, low = (portfolio.turnover(portfolio.holdings(r, "full", side, least=100)) for side in ("top", "bottom"))
    ls = portfolio.long_short(top, low).agg(F.avg(F.col("gross") - F.col("net"))).first()[0]
    assert ls == pytest.approx((0.0010 + 0.0025) / months)


def test_drawdown_starts_at_the_first_value(spark):
    s = spark.createDataFrame([("a", 0, -0.5), ("a", 1, 0.1), ("a", 2, -0.2)], "series string, month_ix int, net double")
    got = portfolio.annualise(s).first()
    assert got["max_drawdown"] == pytest.approx(-0.2) and got["cagr"] == pytest.approx((0.5 * 1.1 * 0.8) ** 4 - 1)


def test_market_model_removes_beta(spark):
    rng = np.random.default_rng(1)
    market = rng.normal(0.001, 0.004, 300)
    bars = [("M", i, float(x)) for i, x in enumerate(market)] + [("BETA2", i, float(2 * x)) for i, x in enumerate(market)]
    rets = spark.createDataFrame(bars, "ticker string, bar_ix int, ret double").join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(market)], "bar_ix int, market double"), "bar_ix").withColumn("abnormal", F.col("ret") - F.col("market"))
    events = spark.createDataFrame([("BETA2", 290)], "ticker string, event_ix int")
    model = eventstudy.market_models(events, rets)
    row, n = model.first(), 252
    assert row["beta"] == pytest.approx(2 * n / (n - 1), rel=1e-6)
    plain, fitted = (eventstudy.window_sums(events, rets, 0, 5, m).first()["car"] for m in (None, model))
    assert abs(fitted) < 0.25 * abs(plain)


def test_window_sums_need_every_bar(spark):
    rets = spark.createDataFrame([("A", i, 0.01 if i != 5 else None, 0.0, 0.01 if i != 5 else None) for i in range(10)], "ticker string, bar_ix int, ret double, market double, abnormal double")
    e = spark.createDataFrame([("A", 1), ("A", 3), ("A", 8)], "ticker string, event_ix int")
    assert rows(eventstudy.window_sums(e, rets, 0, 2), "event_ix") == [("A", 1, pytest.approx(0.03)), ("A", 3, None), ("A", 8, None)]


def test_calibration(spark):
    f = spark.createDataFrame([(str(i), "me", 5, "right" if i < 10 else "wrong", D(2024, 1, 1)) for i in range(20)], "thesis_id string, author string, conviction int, status string, opened date")
    r = spark.createDataFrame([(str(i), D(2024, 2, 1) + dt.timedelta(i), "right" if i < 10 else "wrong", "good") for i in range(20)], "thesis_id string, reviewed_on date, outcome string, decision_quality string")
    g = calibration.graded(r, f)
    assert calibration.brier(g).filter("author IS NULL").first()["brier"] == 0.5
    last = calibration.trend(g).orderBy(F.desc("reviewed_on")).first()
    assert last["cumulative"] == 0.5 and last["rolling"] == 1.0
    assert calibration.is_overconfident(calibration.buckets(g)).first()[0]


def test_forced_rows_keep_their_rank(spark):
    r = spark.createDataFrame([(f"t{i}", float(10 - i)) for i in range(10)] + [("none", None)], "ticker string, score double")
    got = rows(screens.ranked_with_forced(r, "score", 2, spark.createDataFrame([("t0",), ("t8",)], "ticker string")).select("ticker", "rank", "forced"), "rank")
    assert got == [("t0", 1, False), ("t1", 2, False), ("t8", 9, True)]
