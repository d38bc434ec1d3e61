import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, eventstudy, panel
from tidemark.plans import backtest


def business_days(start, n):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def test_planted_momentum_is_recovered(spark):
    """Names with a constant drift by rank: the momentum IC must be near one, and its t large."""
    names, n_days = 60, 900
    days = business_days(dt.date(2016, 1, 4), n_days)
    idx = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, date date")
    k = spark.range(names).withColumn("mu", -0.001 + 0.002 * F.col("id") / (names - 1))
    wobble = F.when(F.col("i") % 2 == 0, 0.004).otherwise(-0.004) + 0.005 * F.sin(2 * math.pi * (F.col("i") / 40 + F.col("id") / names))
    close = F.exp(math.log(100) + F.col("mu") * F.col("i") + wobble)
    prices = idx.join(k, F.lit(True)).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("ticker"), "date", close.alias("close"), (close * 1.01).alias("high"), (close * 0.99).alias("low"), F.lit(1e6).alias("volume"))
    members = k.select(F.lit("2016-01-01").cast("date").alias("snap_date"), F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("ticker"))
    sectors = members.select("ticker", F.lit("all").alias("sector"))
    events = spark.createDataFrame([], "source string, ticker string, when date, signed_weight double")
    s = backtest.Settings(least_names=50, least_tail=20, least_decile=50, flows={"congress": (180, 365), "fund": (270, 540)})
    r = backtest.report(backtest.Inputs(prices, members, sectors, events), ["mom", "trend", "congress", "fund"], s)
    ic = {row["series"]: row for row in r["ic_stats"].collect()}
    assert ic["z_mom"]["mean"] > 0.8 and ic["z_mom"]["t"] > 3
    summary = {row["series"]: row for row in r["summary"].collect()}
    assert summary["price"]["cagr"] > 0
    ls = r["long_short"].agg(F.avg("gross"), F.min(F.col("gross") - F.col("net")), F.max(F.col("gross") - F.col("net"))).first()
    assert ls[0] > 0 and ls[1] >= 0 and ls[2] == pytest.approx(0.0035)


def test_planted_event_drift(spark):
    """One name gains two percent over the six bars from its event; the second event, two days later, is collapsed."""
    days = business_days(dt.date(2017, 6, 1), 400)
    idx = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, date date")
    flat = idx.join(spark.range(50).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("ticker")), F.lit(True))
    wob = F.lit(100.0) * (1 + F.when(F.col("i") % 2 == 0, 0.002).otherwise(0.0))
    drift = F.pow(F.lit(1.02), F.least(F.lit(6), F.greatest(F.lit(0), F.col("i") - 319)) / 6)
    prices = flat.select("ticker", "date", wob.alias("close")).union(idx.select(F.lit("EVENT"), "date", wob * drift)).withColumn("volume", F.lit(1.0)).withColumn("high", F.col("close")).withColumn("low", F.col("close"))
    cal = panel.calendar(prices)
    rets = eventstudy.returns(panel.dense_grid(prices, cal))
    events = spark.createDataFrame([("EVENT", days[320]), ("EVENT", days[322])], "ticker string, when date")
    row = eventstudy.report(asof.next_bar(events, cal), rets, ((0, 5),)).first()
    assert row["n"] == 1 and row["n_collapsed"] == 1 and row["mean_car"] == pytest.approx(0.02, abs=0.004)
    path = {r["day"]: r["mean_car"] for r in eventstudy.daily_path(asof.next_bar(events, cal), rets, 5).collect()}
    assert path[5] == pytest.approx(row["mean_car"]) and path[0] < path[5]
