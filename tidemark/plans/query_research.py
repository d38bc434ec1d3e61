"""Queries on joins, events, windows, cross-sections, portfolios, event studies, significance and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, calibration, eventstudy, panel, portfolio, screens, stats, text, xsection
from tidemark.operators import events as ev
from tidemark.operators.upsert import replace_by_key
from tidemark.plans import backtest, backtest_sql
from tidemark.plans.registry import day, query, rounded
from tidemark.standins import Feeds

_DATES = "(SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of FROM {orders})"
_SIGN = "CASE WHEN transaction_type = 'P' THEN 1 WHEN transaction_type = 'Sale (Full)' THEN -1 ELSE 0 END"
_MID = "CASE amount WHEN '$15,001 - $50,000' THEN 32500.5 WHEN '$50,001 - $100,000' THEN 75000.5 WHEN '$100,001 - $250,000' THEN 175000.5 WHEN '$250,000' THEN 250000.0 ELSE 0.0 END"
_CONGRESS = f"SELECT 'congress' AS source, ticker, coalesce(disclosure_date, transaction_date) AS \"when\", {_SIGN} * {_MID} AS signed_weight FROM {{trades}} WHERE amended IS NOT TRUE AND ticker_ok IS NOT FALSE AND {_SIGN} <> 0 AND {_MID} > 0"


def _dates(f: Feeds) -> DataFrame:
    return f.orders.select(F.trunc("o_orderdate", "quarter").alias("as_of")).distinct()


@query("SELECT r.thesis_id, outcome, conviction FROM {reviews} r JOIN {forecasts} t ON r.thesis_id = t.thesis_id WHERE (status IN ('right', 'wrong') OR outcome IN ('right', 'wrong')) AND outcome <> 'unclear'")
def j1_graded_reviews(f: Feeds) -> DataFrame:
    return calibration.graded(f.reviews, f.forecasts).select("thesis_id", "outcome", "conviction")


_J3 = """WITH q AS (SELECT DISTINCT ticker, as_of FROM {fundamentals}, (SELECT make_date(CAST(1993 + i AS INT), 2, 14) AS as_of FROM range(12) t(i)) d)
SELECT ticker, as_of, period_end, CASE WHEN eps IS NOT NULL THEN round(eps, 6) END AS eps, round(net_income, 2) AS net_income FROM (
SELECT q.ticker, q.as_of, f.period_end, f.eps, f.net_income, row_number() OVER (PARTITION BY q.ticker, q.as_of ORDER BY f.filing_date DESC, f.period_end DESC) AS n FROM q LEFT JOIN {fundamentals} f ON f.ticker = q.ticker AND f.filing_date < q.as_of) x WHERE n = 1"""


@query(_J3)
def j3_fundamentals_asof(f: Feeds) -> DataFrame:
    days = F.array(*(day(f"{1993 + i}-02-14") for i in range(12)))
    left = f.fundamentals.select("ticker").distinct().withColumn("as_of", F.explode(days))
    out = asof.as_of(left, f.fundamentals, ["ticker"], "as_of", "filing_date", ["period_end", "eps", "net_income"], strict=True, ties=["period_end"])
    return out.select("ticker", "as_of", "period_end", F.round("eps", 6).alias("eps"), F.round("net_income", 2).alias("net_income"))


_J4 = """SELECT t.trade_id, p.date AS bar, round(p.close, 6) AS close FROM {trades} t LEFT JOIN LATERAL (SELECT date, close FROM {prices} p WHERE p.ticker = t.ticker AND p.date <= t.transaction_date AND p.date >= t.transaction_date - 10 ORDER BY date DESC LIMIT 1) p ON true"""


@query(_J4)
def j4_last_close_within(f: Feeds) -> DataFrame:
    out = asof.as_of(f.trades.select("trade_id", "ticker", "transaction_date"), f.prices.select("ticker", "date", "close").withColumn("bar", F.col("date")), ["ticker"], "transaction_date", "date", ["bar", "close"], within_days=10)
    return out.select("trade_id", "bar", F.round("close", 6).alias("close"))


@query("""WITH s AS (SELECT snap_date, lead(snap_date) OVER (ORDER BY snap_date) AS until FROM (SELECT DISTINCT snap_date FROM {membership}) d),
q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {orders} WHERE CAST(o_orderdate AS DATE) >= (SELECT min(snap_date) FROM {membership}))
SELECT DISTINCT day, ticker FROM q JOIN s ON day >= s.snap_date AND (until IS NULL OR day < until) JOIN {membership} m ON m.snap_date = s.snap_date""")
def j5_members_as_of(f: Feeds) -> DataFrame:
    first = f.membership.agg(F.min("snap_date").alias("first"))
    days = f.orders.select(F.col("o_orderdate").cast("date").alias("day")).join(F.broadcast(first), F.col("day") >= F.col("first"))
    return asof.members_as_of(days.select("day"), f.membership)


@query("""SELECT DISTINCT ticker FROM {membership} WHERE snap_date <= DATE '1997-12-31' AND snap_date >= (SELECT max(snap_date) FROM {membership} WHERE snap_date <= DATE '1997-05-05')""")
def j6_members_in_window(f: Feeds) -> DataFrame:
    return asof.members_in_window(f.membership, day("1997-05-05"), day("1997-12-31"))


@query(f"SELECT as_of, ticker, count(*) AS n, sum(signed_weight) AS weight FROM {_DATES} d JOIN ({_CONGRESS}) e ON e.\"when\" < d.as_of AND e.\"when\" >= d.as_of - 120 GROUP BY 1, 2")
def j7_window_join(f: Feeds) -> DataFrame:
    return asof.window_events(_dates(f), ev.congress_events(f.trades), 120).groupBy("as_of", "ticker").agg(F.count("*").alias("n"), F.sum("signed_weight").alias("weight"))


_CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS bar_ix FROM (SELECT DISTINCT date FROM {weekly}) c)"


@query(f"WITH {_CAL} SELECT stake_id, min(bar_ix) AS event_ix FROM {{stakes}} s JOIN cal ON cal.date >= s.filing_date WHERE filing_date >= (SELECT min(date) FROM cal) GROUP BY 1")
def j8_next_bar(f: Feeds) -> DataFrame:
    return asof.next_bar(f.stakes.withColumnRenamed("filing_date", "when"), panel.calendar(f.weekly)).select("stake_id", F.col("event_ix").cast("long").alias("event_ix"))


@query("""WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS bar_ix FROM (SELECT DISTINCT date FROM {prices}) c)
SELECT as_of, bar_ix, row_number() OVER (ORDER BY as_of) - 1 AS month_ix FROM (SELECT max(date) AS as_of, max(bar_ix) AS bar_ix FROM cal GROUP BY date_trunc('month', date)) m WHERE bar_ix >= 12 AND bar_ix < (SELECT max(bar_ix) FROM cal)""")
def j9_x1_rebalance_bars(f: Feeds) -> DataFrame:
    out = panel.rebalance_bars(panel.calendar(f.prices), panel.MONTHLY)
    return out.select("as_of", F.col("bar_ix").cast("long").alias("bar_ix"), F.col("month_ix").cast("long").alias("month_ix"))


@query("""WITH first AS (SELECT ticker, min(date) AS d FROM {prices} GROUP BY 1), near AS (SELECT t.trade_id, t.ticker, max(p.date) AS d FROM {trades} t LEFT JOIN {prices} p ON p.ticker = t.ticker AND p.date <= t.transaction_date GROUP BY 1, 2)
SELECT trade_id, coalesce(near.d, first.d) AS snap_date FROM near LEFT JOIN first USING (ticker)""")
def j10_nearest_prior(f: Feeds) -> DataFrame:
    return asof.nearest_prior(f.trades.select("trade_id", "ticker", F.col("transaction_date").alias("when")), f.prices).select("trade_id", "snap_date")


@query(f"SELECT ticker, \"when\", count(*) AS n, sum(signed_weight) AS weight FROM ({_CONGRESS}) e GROUP BY 1, 2")
def e1_congress_events(f: Feeds) -> DataFrame:
    return ev.congress_events(f.trades).groupBy("ticker", "when").agg(F.count("*").alias("n"), F.sum("signed_weight").alias("weight"))


@query("""SELECT ticker, filing_date AS "when", round(greatest(percent_rank() OVER (PARTITION BY date_trunc('month', filing_date) ORDER BY value), 0.01) * ln(1 + filers), 6) AS signed_weight FROM (
SELECT i.*, c.filers FROM {insiders} i JOIN (SELECT ticker, date_trunc('month', filing_date) AS mon, count(DISTINCT filer) AS filers FROM {insiders} WHERE value > 0 GROUP BY 1, 2) c ON i.ticker = c.ticker AND date_trunc('month', i.filing_date) = c.mon WHERE value > 0) x""")
def e3_w1_w2_insider_events(f: Feeds) -> DataFrame:
    return rounded(ev.insider_events(f.insiders).drop("source"))


_FUND = """WITH filings AS (SELECT manager, filing_date, row_number() OVER (PARTITION BY manager ORDER BY filing_date) AS seq FROM (SELECT DISTINCT manager, filing_date FROM {holdings}) d),
h AS (SELECT h.*, seq FROM {holdings} h JOIN filings USING (manager, filing_date)),
moves AS (SELECT coalesce(n.manager, o.manager) AS manager, coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.seq, o.seq + 1) AS seq, n.shares AS s, o.shares AS p, n.value AS v
  FROM (SELECT * FROM h WHERE seq > 1) n FULL JOIN h o ON n.manager = o.manager AND n.ticker = o.ticker AND n.seq = o.seq + 1),
m AS (SELECT moves.*, f.filing_date, CASE WHEN p IS NULL THEN 'NEW' WHEN s IS NULL THEN 'EXIT' WHEN s > p THEN 'ADD' WHEN s < p THEN 'TRIM' END AS action FROM moves JOIN filings f ON moves.manager = f.manager AND moves.seq = f.seq),
w AS (SELECT m.ticker, m.filing_date AS "when", CASE WHEN action IN ('NEW', 'ADD') THEN 1.0 ELSE -0.5 END AS side, CASE WHEN action = 'EXIT' THEN p * (SELECT arg_max(close, date) FROM {prices} x WHERE x.ticker = m.ticker AND x.date <= m.filing_date AND x.date >= m.filing_date - 10) ELSE v END AS mag FROM m WHERE action IS NOT NULL)
"""


@query(_FUND + "SELECT ticker, \"when\", count(*) AS n, round(sum(side * ln(1 + mag)), 4) AS weight FROM w WHERE mag > 0 GROUP BY 1, 2")
def e2_fund_events(f: Feeds) -> DataFrame:
    events, _ = ev.fund_events(ev.holding_moves(f.holdings), f.prices)
    return events.groupBy("ticker", "when").agg(F.count("*").alias("n"), F.round(F.sum("signed_weight"), 4).alias("weight"))


@query("SELECT ticker, filing_date AS \"when\", count(*) AS n FROM {stakes} GROUP BY 1, 2")
def e4_activism_events(f: Feeds) -> DataFrame:
    return ev.activism_events(f.stakes).groupBy("ticker", "when").agg(F.sum("signed_weight").cast("long").alias("n"))


@query("SELECT event_type AS ticker, CAST(ts AS DATE) AS \"when\", sum(CASE WHEN value > 40 THEN 1.0 WHEN value < 5 THEN -1.0 ELSE 0.0 END) AS weight FROM {events} GROUP BY 1, 2")
def e5_statement_events(f: Feeds) -> DataFrame:
    rows = f.events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("date").alias("statement_date"), F.when(F.col("value") > 40, "positive").when(F.col("value") < 5, "negative").alias("stance"))
    return ev.statement_events(rows).groupBy("ticker", "when").agg(F.sum("signed_weight").alias("weight"))


@query("SELECT ticker, date, round(short_volume / total_volume, 6) AS short_fraction FROM {shorts} WHERE total_volume > 0")
def e6_short_fraction(f: Feeds) -> DataFrame:
    return rounded(ev.short_fraction(f.shorts))


@query(f"SELECT as_of, ticker, 'congress' AS source, round(sum(signed_weight * pow(0.5, date_diff('day', \"when\", as_of) / 180.0)), 3) AS flow FROM {_DATES} d JOIN ({_CONGRESS}) e ON e.\"when\" < d.as_of AND e.\"when\" >= d.as_of - 365 GROUP BY 1, 2")
def a1_decayed_flow(f: Feeds) -> DataFrame:
    return rounded(ev.decayed_flow(_dates(f), ev.congress_events(f.trades), "congress", 180, 365), 3)


@query("""WITH s AS (SELECT date, row_number() OVER (ORDER BY date) AS ix FROM (SELECT DISTINCT date FROM {shorts} WHERE total_volume > 0) d),
q AS (SELECT as_of, max(ix) AS ix FROM (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of FROM {orders}) d JOIN s ON s.date < d.as_of GROUP BY 1)
SELECT as_of, ticker, round(avg(short_volume / total_volume), 6) AS short_fraction FROM q JOIN s ON s.ix BETWEEN q.ix - 4 AND q.ix JOIN {shorts} t ON t.date = s.date WHERE total_volume > 0 GROUP BY 1, 2""")
def a2_short_pressure(f: Feeds) -> DataFrame:
    return rounded(ev.short_pressure(_dates(f), ev.short_fraction(f.shorts)))


@query("""SELECT f.ticker, f.filing_date, f.period_end, coalesce((SELECT product(ratio) FROM {splits} s WHERE s.ticker = f.ticker AND s.ratio > 0 AND s.date > f.filing_date AND s.date <= DATE '2002-06-30'), 1.0) AS split_factor FROM {fundamentals} f""")
def a3_split_factor(f: Feeds) -> DataFrame:
    return ev.split_factor(f.fundamentals, f.splits, day("2002-06-30")).select("ticker", "filing_date", "period_end", "split_factor")


def _grid(f: Feeds) -> DataFrame:
    return panel.dense_grid(f.prices, panel.calendar(f.prices))


_GRID = """cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS bar_ix FROM (SELECT DISTINCT date FROM {prices}) c),
ends AS (SELECT ticker, min(bar_ix) AS a, max(bar_ix) AS b FROM {prices} JOIN cal USING (date) GROUP BY 1),
grid AS (SELECT e.ticker, c.bar_ix, c.date, p.close, p.volume FROM ends e JOIN cal c ON c.bar_ix BETWEEN e.a AND e.b LEFT JOIN {prices} p ON p.ticker = e.ticker AND p.date = c.date),
rets AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY bar_ix)) AS r FROM grid),
feats AS (SELECT ticker, bar_ix, date, close, ln(lag(close, 1) OVER t / lag(close, 12) OVER t) AS mom,
  CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY bar_ix ROWS 9 PRECEDING) = 10 THEN close / avg(close) OVER (PARTITION BY ticker ORDER BY bar_ix ROWS 9 PRECEDING) - 1 END AS trend,
  CASE WHEN count(r) OVER (PARTITION BY ticker ORDER BY bar_ix ROWS 10 PRECEDING) = 11 THEN stddev_pop(r) OVER (PARTITION BY ticker ORDER BY bar_ix ROWS 10 PRECEDING) * sqrt(12.0) END AS vol,
  quantile_cont(close * volume, 0.5) OVER (PARTITION BY ticker ORDER BY bar_ix ROWS 5 PRECEDING) AS dollar_volume
  FROM rets WINDOW t AS (PARTITION BY ticker ORDER BY bar_ix))"""


@query(f"WITH {_GRID} SELECT ticker, date, round(mom, 6) AS mom, round(trend, 6) AS trend, round(vol, 6) AS vol, round(dollar_volume, 0) AS dollar_volume FROM feats")
def w4_w7_x2_price_features(f: Feeds) -> DataFrame:
    out = panel.features(_grid(f), panel.MONTHLY)
    return out.select("ticker", "date", F.round("mom", 6).alias("mom"), F.round("trend", 6).alias("trend"), F.round("vol", 6).alias("vol"), F.round("dollar_volume", 0).alias("dollar_volume"))


_ROWS = f"""{_GRID},
months AS (SELECT date AS as_of, bar_ix, row_number() OVER (ORDER BY date) - 1 AS month_ix FROM cal WHERE bar_ix >= 12 AND bar_ix < (SELECT max(bar_ix) FROM cal)),
at_months AS (SELECT m.month_ix, m.as_of, f.*, CASE WHEN lead(m.month_ix) OVER w = m.month_ix + 1 AND close > 0 THEN lead(close) OVER w / close - 1 END AS fwd FROM feats f JOIN months m ON f.bar_ix = m.bar_ix WINDOW w AS (PARTITION BY f.ticker ORDER BY m.month_ix)),
el AS (SELECT a.*, s.sector FROM at_months a LEFT JOIN {{sectors}} s USING (ticker) WHERE close IS NOT NULL AND mom IS NOT NULL AND trend IS NOT NULL AND vol IS NOT NULL QUALIFY count(*) OVER (PARTITION BY month_ix) >= 5)"""


def _at_months(f: Feeds) -> DataFrame:
    cal = panel.calendar(f.prices)
    months = panel.rebalance_bars(cal, panel.MONTHLY)
    at = panel.features(panel.dense_grid(f.prices, cal), panel.MONTHLY).join(F.broadcast(months), "bar_ix")  # a row per month
    return panel.forward_returns(at)


def _month_rows(f: Feeds) -> DataFrame:
    """Eligible rows at rebalance dates with features, sector and forward return."""
    return xsection.eligible(_at_months(f).join(f.sectors, "ticker", "left"), ["close", "mom", "trend", "vol"], 5)


@query(f"WITH {_ROWS} SELECT month_ix, ticker, round(fwd, 6) AS fwd FROM el")
def w8_x3_forward_returns(f: Feeds) -> DataFrame:
    return _month_rows(f).select(F.col("month_ix").cast("long").alias("month_ix"), "ticker", F.round("fwd", 6).alias("fwd"))


_Z = "greatest(-3.0, least(3.0, (mom - avg(mom) OVER m) / stddev_pop(mom) OVER m))"


@query(f"WITH {_ROWS} SELECT month_ix, ticker, round({_Z}, 6) AS z FROM el WINDOW m AS (PARTITION BY month_ix)")
def x4_winsor_z(f: Feeds) -> DataFrame:
    return xsection.winsor_z(_month_rows(f), "mom", "z", by=("month_ix",)).select(F.col("month_ix").cast("long").alias("month_ix"), "ticker", F.round("z", 6).alias("z"))


@query("""SELECT event_id, round(CASE WHEN a IS NULL AND b IS NULL THEN c WHEN c IS NULL THEN x ELSE (x + c) / 2 END, 6) AS both_blocks, round(x, 6) AS one_block FROM (SELECT event_id, a, b, c, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS x
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS a, CASE WHEN event_id % 3 = 0 THEN value * 2 END AS b, CASE WHEN event_id % 5 = 0 THEN value + 1 END AS c FROM {events}) e) y""")
def x5_block_composite(f: Feeds) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    rows = f.events.select("event_id", F.when(k % 2 == 0, v).alias("a"), F.when(k % 3 == 0, v * 2).alias("b"), F.when(k % 5 == 0, v + 1).alias("c"))
    return rounded(xsection.composite(rows, {"x": ["a", "b"], "y": ["c"]}, {"both_blocks": ["x", "y"], "one_block": ["x"]}).select("event_id", "both_blocks", "one_block"))


_DEMEAN = "fwd - CASE WHEN sector IS NOT NULL AND count(fwd) OVER (PARTITION BY month_ix, sector) >= 5 THEN avg(fwd) OVER (PARTITION BY month_ix, sector) ELSE avg(fwd) OVER (PARTITION BY month_ix) END"


@query(f"WITH {_ROWS} SELECT month_ix, ticker, round({_DEMEAN}, 6) AS fwd_dm FROM el")
def x6_sector_demean(f: Feeds) -> DataFrame:
    return xsection.sector_demean(_month_rows(f)).select(F.col("month_ix").cast("long").alias("month_ix"), "ticker", F.round("fwd_dm", 6).alias("fwd_dm"))


_IC = f"""ic AS (SELECT month_ix, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(x, y) END AS ic FROM (SELECT month_ix, row_number() OVER (PARTITION BY month_ix ORDER BY mom, ticker) AS x, row_number() OVER (PARTITION BY month_ix ORDER BY fwd, ticker) AS y FROM el WHERE fwd IS NOT NULL) r GROUP BY 1)"""


@query(f"WITH {_ROWS}, {_IC} SELECT month_ix, n, round(ic, 6) AS ic FROM ic")
def x7_rank_ic(f: Feeds) -> DataFrame:
    return rounded(xsection.rank_ic(_month_rows(f), "mom", "fwd").withColumn("month_ix", F.col("month_ix").cast("long")))


@query(f"WITH {_ROWS} SELECT month_ix, round(count(fwd) / count(*), 6) AS coverage FROM el GROUP BY 1")
def x8_x14_coverage(f: Feeds) -> DataFrame:
    return rounded(xsection.coverage(_month_rows(f), ("month_ix",), "fwd").withColumn("month_ix", F.col("month_ix").cast("long")))


@query(f"""WITH {_ROWS}, r AS (SELECT *, count(*) OVER (PARTITION BY month_ix) AS n, row_number() OVER (PARTITION BY month_ix ORDER BY mom DESC, ticker) AS t, row_number() OVER (PARTITION BY month_ix ORDER BY mom, ticker) AS b FROM el WHERE fwd IS NOT NULL)
SELECT month_ix, n, round(avg(CASE WHEN t <= greatest(1, floor(n * 0.1)) THEN fwd END) - avg(fwd), 6) AS top_excess, round(avg(CASE WHEN b <= greatest(1, floor(n * 0.1)) THEN fwd END) - avg(fwd), 6) AS bottom_excess FROM r WHERE n >= 5 GROUP BY 1, 2""")
def x9_t6_tails(f: Feeds) -> DataFrame:
    return rounded(xsection.tails(_month_rows(f), "mom", "fwd", least=5).withColumn("month_ix", F.col("month_ix").cast("long")))


@query(f"""WITH {_ROWS}, mid AS (SELECT month_ix, quantile_cont(dollar_volume, 0.5) AS v FROM el GROUP BY 1 HAVING count(dollar_volume) >= 5) SELECT month_ix, ticker, CASE WHEN dollar_volume >= v THEN 'large' ELSE 'small' END AS half FROM el JOIN mid USING (month_ix) WHERE dollar_volume IS NOT NULL""")
def x10_size_halves(f: Feeds) -> DataFrame:
    return xsection.size_halves(_month_rows(f), least=5).select(F.col("month_ix").cast("long").alias("month_ix"), "ticker", "half")


@query(f"""WITH {_ROWS} SELECT month_ix, decile, round(avg(fwd), 6) AS ret, count(*) AS n FROM (SELECT month_ix, fwd, CAST(ntile(10) OVER (PARTITION BY month_ix ORDER BY mom, ticker) AS INT) AS decile, count(*) OVER (PARTITION BY month_ix) AS c FROM el WHERE fwd IS NOT NULL) d WHERE c >= 10 GROUP BY 1, 2""")
def x12_t5_deciles(f: Feeds) -> DataFrame:
    return rounded(xsection.deciles(_month_rows(f), "mom", "fwd", least=10).withColumn("month_ix", F.col("month_ix").cast("long")))


_HELD = """ranked AS (SELECT *, count(*) OVER (PARTITION BY month_ix) AS n, row_number() OVER (PARTITION BY month_ix ORDER BY mom DESC, ticker) AS t FROM el WHERE fwd IS NOT NULL),
held AS (SELECT month_ix, ticker, fwd, dense_rank() OVER (ORDER BY month_ix) AS seq FROM ranked WHERE n >= 5 AND t <= greatest(1, floor(n * 0.1))),
turn AS (SELECT h.month_ix, h.seq, avg(h.fwd) AS gross, count(*) AS n, CASE WHEN h.seq = 1 THEN 1.0 ELSE 1 - count(b.ticker) / count(*) END AS turnover FROM held h LEFT JOIN held b ON b.ticker = h.ticker AND b.seq = h.seq - 1 GROUP BY 1, 2)"""


@query(f"WITH {_ROWS}, {_HELD} SELECT month_ix, n, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - turnover * 0.001, 6) AS net FROM turn")
def x11_t8_top_bucket(f: Feeds) -> DataFrame:
    rows = _month_rows(f).filter("fwd IS NOT NULL")
    out = portfolio.net_of_cost(portfolio.turnover(portfolio.holdings(rows, "mom", least=5)))
    return rounded(out.select(F.col("month_ix").cast("long").alias("month_ix"), "n", "gross", "turnover", "net"))


@query(f"WITH {_ROWS} SELECT month_ix, round(avg(fwd), 6) AS ret, count(*) AS n FROM el WHERE fwd IS NOT NULL GROUP BY 1")
def x13_equal_weight_benchmark(f: Feeds) -> DataFrame:
    rows = _month_rows(f).filter("fwd IS NOT NULL")
    return rounded(rows.groupBy(F.col("month_ix").cast("long").alias("month_ix")).agg(F.avg("fwd").alias("ret"), F.count("*").alias("n")))


@query(f"""WITH {_ROWS}, proxy AS (SELECT month_ix, fwd AS ret FROM at_months WHERE ticker = 'T00001' AND fwd IS NOT NULL), rest AS (SELECT month_ix, avg(fwd) AS ret, count(*) AS n FROM at_months WHERE ticker <> 'T00001' AND fwd IS NOT NULL GROUP BY 1)
SELECT month_ix, round(rest.ret, 6) AS equal_weighted, n, round(proxy.ret, 6) AS cap_weighted FROM rest LEFT JOIN proxy USING (month_ix)""")
def x13_cap_weighted_proxy(f: Feeds) -> DataFrame:
    own, rest = portfolio.proxy_returns(_at_months(f), "T00001")
    means = rest.filter("fwd IS NOT NULL").groupBy("month_ix").agg(F.avg("fwd").alias("equal_weighted"), F.count("*").alias("n"))
    out = means.join(own.withColumnRenamed("ret", "cap_weighted"), "month_ix", "left")
    return rounded(out.withColumn("month_ix", F.col("month_ix").cast("long")))


@query(f"""WITH {_ROWS}, {_HELD}, g AS (SELECT month_ix, exp(sum(ln(1 + gross)) OVER (ORDER BY month_ix)) AS growth, gross FROM turn), d AS (SELECT *, growth / max(growth) OVER (ORDER BY month_ix) - 1 AS dd FROM g)
SELECT 'top' AS series, count(*) AS n, round(pow(exp(sum(ln(1 + gross))), 12.0 / count(*)) - 1, 6) AS cagr, round(avg(gross) / stddev_pop(gross) * sqrt(12.0), 6) AS sharpe, round(min(dd), 6) AS max_drawdown FROM d""")
def x15_w9_annualise(f: Feeds) -> DataFrame:
    rows = _month_rows(f).filter("fwd IS NOT NULL")
    held = portfolio.turnover(portfolio.holdings(rows, "mom", least=5)).withColumn("series", F.lit("top"))
    return rounded(portfolio.annualise(held, "gross"))


@query(f"""WITH {_ROWS}, {_IC}, e AS (SELECT month_ix, ic - avg(ic) OVER () AS e, avg(ic) OVER () AS m, count(*) OVER () AS n FROM ic WHERE ic IS NOT NULL),
l AS (SELECT max(n) AS n, max(m) AS m, greatest(1, least(floor(4 * pow(max(n) / 100.0, 2.0 / 9)), max(n) - 1)) AS lag FROM e),
o AS (SELECT e, row_number() OVER (ORDER BY month_ix) AS i FROM e),
g AS (SELECT b.i - a.i AS k, avg(a.e * b.e) AS g FROM o a JOIN o b ON b.i >= a.i AND b.i - a.i <= (SELECT lag FROM l) GROUP BY 1)
SELECT 'mom' AS series, max(n) AS n, round(max(m), 6) AS mean, CAST(max(lag) AS INT) AS lag, round(max(m) / sqrt(sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lag + 1)) * g END) / max(n)), 5) AS t FROM g, l""")
def x16_w10_newey_west(f: Feeds) -> DataFrame:
    ic = xsection.rank_ic(_month_rows(f), "mom", "fwd").withColumn("series", F.lit("mom")).withColumnRenamed("ic", "value")
    out = stats.newey_west(ic)
    return out.select("series", "n", F.round("mean", 6).alias("mean"), "lag", F.round("t", 5).alias("t"))


@query(f"WITH {_ROWS}, {_IC} SELECT 'mom' AS series, count(ic) AS n, round(avg(ic), 6) AS mean, round(avg(ic) / stddev_pop(ic) * sqrt(count(ic)), 5) AS t FROM ic")
def x17_naive_t(f: Feeds) -> DataFrame:
    ic = xsection.rank_ic(_month_rows(f), "mom", "fwd").withColumn("series", F.lit("mom")).withColumnRenamed("ic", "value")
    out = stats.naive_t(ic)
    return out.select("series", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query("""WITH s AS (SELECT event_type AS series, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS month_ix, round(avg(value), 6) AS value FROM {events} GROUP BY 1, 2)
SELECT a.series AS a, b.series AS b, count(*) AS n, round(CASE WHEN count(*) >= 6 THEN corr(a.value, b.value) END, 5) AS corr FROM s a JOIN s b USING (month_ix) GROUP BY 1, 2""")
def x18_series_correlation(f: Feeds) -> DataFrame:
    s = f.events.groupBy(F.col("event_type").alias("series"), F.datediff(F.col("ts").cast("date"), day("2024-01-01")).alias("month_ix")).agg(F.round(F.avg("value"), 6).alias("value"))
    return rounded(stats.series_correlation(s), 5)


@query(f"""WITH {_ROWS}, {_HELD}, b AS (SELECT month_ix, avg(fwd) AS ret FROM el WHERE fwd IS NOT NULL GROUP BY 1) SELECT 'top' AS series, round(avg(CASE WHEN gross > ret THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(turnover), 6) AS avg_turnover, count(*) AS n FROM turn JOIN b USING (month_ix)""")
def x19_hit_rate(f: Feeds) -> DataFrame:
    rows = _month_rows(f).filter("fwd IS NOT NULL")
    held = portfolio.turnover(portfolio.holdings(rows, "mom", least=5)).withColumn("series", F.lit("top"))
    return rounded(portfolio.hit_rate(held, rows.groupBy("month_ix").agg(F.avg("fwd").alias("ret")), "gross"))


#: What flows, buys and blocks read of the trades.
_TRADED = ["trade_id", "member", "ticker", "transaction_type", "amount", "transaction_date", "disclosure_date", "amended", "ticker_ok"]


def _inputs(f: Feeds) -> backtest.Inputs:
    f.hold("prices", "membership", "shorts", "facts", "holdings", trades=_TRADED)
    moves, _ = ev.fund_events(ev.holding_moves(f.holdings), f.prices)
    events = ev.congress_events(f.trades).union(moves).union(ev.insider_events(f.buys)).union(ev.activism_events(f.blocks))
    return backtest.Inputs(f.prices, f.membership, f.sectors, events, ev.short_fraction(f.shorts), f.facts, f.fact_splits)


FACTORS = ["mom", "trend", "vol", "value", "quality", "congress", "fund", "insider", "activism", "short"]


def _report(f: Feeds) -> dict[str, DataFrame]:
    return backtest.report(_inputs(f), FACTORS, backtest.SMALL)


_BASE = "WITH " + backtest_sql.factor_rows(_GRID, _CONGRESS, _FUND.strip().removeprefix("WITH "))
_SCORED = f"{_BASE}, {backtest_sql.scored_rows()}"
_VERDICT = "CASE WHEN abs(t) >= 3 THEN 'strong' WHEN abs(t) >= 2 THEN 'suggestive' ELSE 'none' END"


@query(_SCORED + backtest_sql.gate(stats.step_up_t(13, 1), stats.step_up_t(316, 1)))
def x20_backtest_ic(f: Feeds) -> DataFrame:
    return rounded(_report(f)["gate"])


@query(_SCORED + backtest_sql.summary())
def x20_backtest_summary(f: Feeds) -> DataFrame:
    r = _report(f)
    return rounded(r["summary"].join(r["hits"].drop("n"), "series"))


@query(_SCORED + backtest_sql.long_short())
def x20_backtest_long_short(f: Feeds) -> DataFrame:
    return rounded(_report(f)["long_short"])


@query(_BASE + backtest_sql.split_sample("congress", "1998-12-31", 1995).replace("{verdict}", _VERDICT))
def x21_split_sample(f: Feeds) -> DataFrame:
    rows = backtest.factor_table(_inputs(f), backtest.SMALL).filter("fwd IS NOT NULL")
    return rounded(backtest.split_sample(rows, "congress", "1998-12-31", backtest.SMALL, 1995))


@query(_SCORED + backtest_sql.snapshot("2002-01-01", "2001-12-01"))
def x22_factor_snapshot(f: Feeds) -> DataFrame:
    """A run's factors put into the history of an earlier day and an earlier run of the same day."""
    now = backtest.snapshot(_report(f), day("2002-01-01"), FACTORS)
    history = now.withColumn("ic_mean", F.lit(0.0)).union(now.withColumn("snapshot_date", day("2001-12-01")))
    return rounded(replace_by_key(history, now, ["snapshot_date", "factor"]))


_WEEKLY = """cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS bar_ix FROM (SELECT DISTINCT date FROM {weekly}) c),
ends AS (SELECT ticker, min(bar_ix) AS a, max(bar_ix) AS b FROM {weekly} JOIN cal USING (date) GROUP BY 1),
grid AS (SELECT e.ticker, c.bar_ix, p.close FROM ends e JOIN cal c ON c.bar_ix BETWEEN e.a AND e.b LEFT JOIN {weekly} p ON p.ticker = e.ticker AND p.date = c.date),
r0 AS (SELECT ticker, bar_ix, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY bar_ix) - 1 AS ret FROM grid),
rets AS (SELECT *, avg(ret) OVER (PARTITION BY bar_ix) AS market, ret - avg(ret) OVER (PARTITION BY bar_ix) AS abnormal FROM r0)"""
_EVENTS = "ev AS (SELECT s.ticker, min(cal.bar_ix) AS event_ix, stake_id FROM {stakes} s JOIN cal ON cal.date >= s.filing_date WHERE filing_date >= (SELECT min(date) FROM cal) GROUP BY 1, 3)"


def _weekly(f: Feeds) -> tuple[DataFrame, DataFrame, DataFrame]:
    cal = panel.calendar(f.weekly)
    grid = panel.dense_grid(f.weekly, cal)
    events = asof.next_bar(f.stakes.withColumnRenamed("filing_date", "when"), cal).select("ticker", "event_ix", "when")
    return grid, eventstudy.returns(grid), events


@query(f"WITH {_WEEKLY} SELECT ticker, bar_ix, round(ret, 6) AS ret, round(market, 6) AS market, round(abnormal, 6) AS abnormal FROM rets")
def v1_abnormal_returns(f: Feeds) -> DataFrame:
    return rounded(_weekly(f)[1].withColumn("bar_ix", F.col("bar_ix").cast("long")))


@query(f"""WITH {_WEEKLY}, {_EVENTS}, e AS (SELECT DISTINCT ticker, event_ix FROM ev), fit AS (SELECT e.ticker, e.event_ix, count(*) AS n, covar_samp(ret, market) / var_pop(market) AS beta, avg(ret) AS y, avg(market) AS x
FROM e JOIN rets r ON r.ticker = e.ticker AND r.bar_ix >= e.event_ix - 56 AND r.bar_ix < e.event_ix - 4 WHERE ret IS NOT NULL AND market IS NOT NULL GROUP BY 1, 2)
SELECT e.ticker, e.event_ix, coalesce(n, 0) AS n, CASE WHEN n >= 20 THEN round(beta, 5) END AS beta, CASE WHEN n >= 20 THEN round(y - beta * x, 5) END AS alpha FROM e LEFT JOIN fit USING (ticker, event_ix)""")
def v2_market_models(f: Feeds) -> DataFrame:
    _, rets, events = _weekly(f)
    out = eventstudy.market_models(events, rets, gap=4, length=52, least=20)
    return rounded(out.withColumn("event_ix", F.col("event_ix").cast("long")), 5)


@query(f"""WITH RECURSIVE {_WEEKLY}, {_EVENTS}, e AS (SELECT DISTINCT ticker, event_ix FROM ev),
kept AS (SELECT ticker, min(event_ix) AS event_ix FROM e GROUP BY 1 UNION ALL SELECT k.ticker, (SELECT min(e.event_ix) FROM e WHERE e.ticker = k.ticker AND e.event_ix >= k.event_ix + 6) AS event_ix FROM kept k WHERE k.event_ix IS NOT NULL AND EXISTS (SELECT 1 FROM e WHERE e.ticker = k.ticker AND e.event_ix >= k.event_ix + 6))
SELECT k.ticker, k.event_ix, c.n - d.n AS n_collapsed FROM kept k JOIN (SELECT ticker, count(*) AS n FROM ev GROUP BY 1) c USING (ticker) JOIN (SELECT ticker, count(*) AS n FROM kept GROUP BY 1) d USING (ticker)""")
def v3_overlap_collapse(f: Feeds) -> DataFrame:
    out = asof.overlap_collapse(_weekly(f)[2], 6)
    return out.select("ticker", F.col("event_ix").cast("long").alias("event_ix"), F.col("n_collapsed").cast("long").alias("n_collapsed"))


@query(f"""WITH {_WEEKLY}, {_EVENTS}, e AS (SELECT DISTINCT ticker, event_ix FROM ev) SELECT e.ticker, e.event_ix, round(CASE WHEN count(abnormal) = 6 THEN sum(abnormal) END, 6) AS car FROM e JOIN range(6) t(i) ON true LEFT JOIN rets r ON r.ticker = e.ticker AND r.bar_ix = e.event_ix + t.i GROUP BY 1, 2""")
def v4_window_sums(f: Feeds) -> DataFrame:
    _, rets, events = _weekly(f)
    return rounded(eventstudy.window_sums(events.select("ticker", "event_ix").distinct(), rets, 0, 5).withColumn("event_ix", F.col("event_ix").cast("long")))


def _kept(name: str, span: int, events: str = "e") -> str:
    """The events of CTE ``events`` that a greedy collapse over ``span`` bars keeps, as a recursive CTE."""
    after = f"e2.ticker = k.ticker AND e2.event_ix >= k.event_ix + {span}"
    return f"""{name} AS (SELECT ticker, min(event_ix) AS event_ix FROM {events} GROUP BY 1 UNION ALL
SELECT k.ticker, (SELECT min(e2.event_ix) FROM {events} e2 WHERE {after}) AS event_ix FROM {name} k WHERE k.event_ix IS NOT NULL AND EXISTS (SELECT 1 FROM {events} e2 WHERE {after}))"""


_STUDY = ((0, 5), (0, 20), (-5, -1))


#: Of the stakes one in four is a sale, which a study leaves out, as it does what came before a year.
_FROM_YEAR = 1994
_BOUGHT = f"ev AS (SELECT s.ticker, min(cal.bar_ix) AS event_ix, stake_id FROM {{stakes}} s JOIN cal ON cal.date >= s.filing_date WHERE filing_date >= greatest((SELECT min(date) FROM cal), DATE '{_FROM_YEAR}-01-01') AND stake_id % 4 <> 0 GROUP BY 1, 3)"


def _study(i: int, first: int, last: int) -> tuple[str, str]:
    """The CTEs of window ``i`` of the event study, and its row."""
    n = last - first + 1
    heads = f"""{_kept(f'kept{i}', n)},
cars{i} AS (SELECT k.ticker, k.event_ix, CASE WHEN count(r.abnormal) = {n} THEN sum(r.abnormal) END AS car, CASE WHEN count(coalesce(ret - alpha - beta * market, abnormal)) = {n} THEN sum(coalesce(ret - alpha - beta * market, abnormal)) END AS car_mm
  FROM kept{i} k JOIN range({first}, {last + 1}) t(i) ON true LEFT JOIN models m ON m.ticker = k.ticker AND m.event_ix = k.event_ix LEFT JOIN rets r ON r.ticker = k.ticker AND r.bar_ix = k.event_ix + t.i WHERE k.event_ix IS NOT NULL GROUP BY 1, 2),
o{i} AS (SELECT car - avg(car) OVER () AS e, row_number() OVER (ORDER BY event_ix, ticker) AS i FROM cars{i} WHERE car IS NOT NULL),
l{i} AS (SELECT count(*) AS n, CAST(greatest(1, least(floor(4 * pow(count(*) / 100.0, 2.0 / 9)), count(*) - 1)) AS INT) AS lag FROM o{i}),
g{i} AS (SELECT k, avg(a.e * b.e) AS g FROM o{i} a JOIN (SELECT unnest(range(lag + 1)) AS k FROM l{i}) ks ON true JOIN o{i} b ON b.i = a.i + k GROUP BY 1)"""
    row = f"""SELECT '{first}..{last}' AS days, count(car) AS n, round(avg(car), 6) AS mean_car, round(avg(car_mm), 6) AS mean_car_mm, round(avg(CASE WHEN car IS NOT NULL THEN CAST(car > 0 AS INT) END), 6) AS hit_rate, count(*) - count(car) AS n_skipped,
round(avg(car) / sqrt((SELECT sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lag + 1)) * g END) FROM g{i}, l{i}) / count(car)), 6) AS t, (SELECT count(*) FROM ev) - count(*) AS n_collapsed, (SELECT count(*) FROM models WHERE beta IS NULL) AS no_beta, (SELECT count(*) FROM ev) AS n_events_total FROM cars{i}"""
    return heads, row


_STUDIES = [_study(i, *w) for i, w in enumerate(_STUDY)]


@query(f"""WITH RECURSIVE {_WEEKLY}, {_BOUGHT}, e AS (SELECT DISTINCT ticker, event_ix FROM ev), fit AS (SELECT e.ticker, e.event_ix, count(*) AS n, CASE WHEN var_pop(market) > 0 THEN covar_samp(ret, market) / var_pop(market) END AS beta, avg(ret) AS y, avg(market) AS x
FROM e JOIN rets r ON r.ticker = e.ticker AND r.bar_ix >= e.event_ix - 56 AND r.bar_ix < e.event_ix - 4 WHERE ret IS NOT NULL AND market IS NOT NULL GROUP BY 1, 2),
models AS (SELECT e.ticker, e.event_ix, CASE WHEN n >= 20 THEN beta END AS beta, CASE WHEN n >= 20 THEN y - beta * x END AS alpha FROM e LEFT JOIN fit USING (ticker, event_ix)),
{', '.join(h for h, _ in _STUDIES)} {' UNION ALL '.join(r for _, r in _STUDIES)}""")
def v5_event_study(f: Feeds) -> DataFrame:
    cal = panel.calendar(f.weekly)
    rets = eventstudy.returns(panel.dense_grid(f.weekly, cal))
    stakes = f.stakes.select("ticker", F.col("filing_date").alias("when"), F.when(F.col("stake_id") % 4 == 0, -1.0).otherwise(1.0).alias("signed_weight"))
    events = asof.next_bar(eventstudy.purchases(stakes, _FROM_YEAR), cal)
    return rounded(eventstudy.report(events, rets, _STUDY, gap=4, length=52, least=20).withColumnRenamed("window", "days"))


@query(f"""WITH RECURSIVE {_WEEKLY}, {_EVENTS}, e AS (SELECT DISTINCT ticker, event_ix FROM ev WHERE event_ix + 20 <= (SELECT max(bar_ix) FROM rets)), {_kept('kept', 21)},
p AS (SELECT k.ticker, k.event_ix, t.i AS day, abnormal FROM kept k JOIN range(21) t(i) ON true LEFT JOIN rets r ON r.ticker = k.ticker AND r.bar_ix = k.event_ix + t.i),
c AS (SELECT day, sum(abnormal) OVER (PARTITION BY ticker, event_ix ORDER BY day) AS car FROM p QUALIFY count(abnormal) OVER (PARTITION BY ticker, event_ix) = 21)
SELECT CAST(day AS INT) AS day, count(*) AS n, round(avg(car), 6) AS mean_car, round(stddev_pop(car) / sqrt(count(*)), 6) AS se FROM c GROUP BY 1""")
def v6_daily_path(f: Feeds) -> DataFrame:
    _, rets, events = _weekly(f)
    return rounded(eventstudy.daily_path(events, rets, 20))


@query(f"""WITH {_WEEKLY}, {_EVENTS}, a AS (SELECT ticker, bar_ix, lead(close, 1) OVER w / close - 1 AS r1, lead(close, 5) OVER w / close - 1 AS r5 FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY bar_ix)),
p AS (SELECT bar_ix, avg(close) AS close FROM grid GROUP BY 1), m AS (SELECT bar_ix, lead(close, 1) OVER (ORDER BY bar_ix) / close - 1 AS m1, lead(close, 5) OVER (ORDER BY bar_ix) / close - 1 AS m5 FROM p)
SELECT e.ticker, e.event_ix, round(r1 - m1, 6) AS abn_1, round(r5 - m5, 6) AS abn_5 FROM (SELECT DISTINCT ticker, event_ix FROM ev) e JOIN a ON a.ticker = e.ticker AND a.bar_ix = e.event_ix JOIN m ON m.bar_ix = a.bar_ix""")
def v7_price_reaction(f: Feeds) -> DataFrame:
    grid, _, events = _weekly(f)
    proxy = grid.groupBy("bar_ix").agg(F.avg("close").alias("close"))
    out = eventstudy.price_reaction(events.select("ticker", "event_ix").distinct(), grid.select("ticker", "bar_ix", "close"), proxy, (1, 5))
    return rounded(out.withColumn("event_ix", F.col("event_ix").cast("long")))


def _tests(f: Feeds) -> DataFrame:
    return f.events.groupBy(F.col("event_type").alias("family"), (F.col("user_id") % 10).alias("k")).agg((F.avg("value") / F.stddev_pop("value") * F.sqrt(F.count("*").cast("double")) / 5).alias("t")).select("family", F.col("k").cast("string").alias("name"), "t")


_TESTS = "tests AS (SELECT event_type AS family, CAST(user_id % 10 AS VARCHAR) AS name, avg(value) / stddev_pop(value) * sqrt(count(*)) / 5 AS t FROM {events} GROUP BY 1, 2)"
_BARS = ", ".join(f"({n}, {k}, {stats.step_up_t(n, k)!r})" for n in range(1, 11) for k in range(1, n + 1))


@query(f"""WITH {_TESTS}, ranked AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, CAST(row_number() OVER (PARTITION BY family ORDER BY abs(t) DESC, name) AS INT) AS rank FROM tests),
bars(bn, bk, critical_t) AS (VALUES {_BARS}), held AS (SELECT * FROM ranked JOIN bars ON n = bn AND rank = bk)
SELECT n, rank, family, name, round(t, 6) AS t, round(critical_t, 6) AS critical_t, coalesce(rank <= max(CASE WHEN abs(t) >= critical_t THEN rank END) OVER (PARTITION BY family), false) AS passes FROM held""")
def g2_step_up(f: Feeds) -> DataFrame:
    out = stats.step_up(_tests(f))
    return rounded(out.select(F.col("n").cast("long").alias("n"), F.col("rank").cast("int").alias("rank"), "family", "name", "t", "critical_t", "passes"))


@query(f"""WITH {_TESTS} SELECT family, name, round(t, 6) AS t, round({stats.step_up_t(13, 1)!r}, 6) AS own_bar, round({stats.step_up_t(316, 1)!r}, 6) AS zoo_bar,
CASE WHEN abs(t) >= {stats.step_up_t(316, 1)!r} THEN 'passes both' WHEN abs(t) >= {stats.step_up_t(13, 1)!r} THEN 'passes own' ELSE 'fails' END AS verdict FROM tests""")
def g1_g3_gate(f: Feeds) -> DataFrame:
    return rounded(stats.gate(_tests(f), own_tests=13))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS n_tests, max(l_orderkey) + 1 AS next_id FROM {lineitem}")
def a16_trials(f: Feeds) -> DataFrame:
    return stats.trials(f.lineitem.select(F.col("l_linenumber").alias("n_tests"), F.col("l_orderkey").alias("run_id")))


_GRADED = "graded AS (SELECT r.thesis_id, reviewed_on, author, conviction, CAST(conviction AS DOUBLE) / 5 AS prob, CASE WHEN outcome = 'right' THEN 1.0 ELSE 0.0 END AS hit FROM {reviews} r JOIN {forecasts} t ON r.thesis_id = t.thesis_id WHERE outcome <> 'unclear')"


@query(f"WITH {_GRADED} SELECT author, count(*) AS n, round(avg(pow(prob - hit, 2)), 6) AS brier FROM graded GROUP BY ROLLUP (author)")
def c1_brier(f: Feeds) -> DataFrame:
    return rounded(calibration.brier(calibration.graded(f.reviews, f.forecasts)))


@query(f"WITH {_GRADED} SELECT conviction, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(prob), 6) AS prob, count(*) >= 5 AND avg(hit) < avg(prob) - 0.1 AS overconfident FROM graded GROUP BY 1")
def c2_c3_buckets(f: Feeds) -> DataFrame:
    return rounded(calibration.buckets(calibration.graded(f.reviews, f.forecasts)))


@query(f"""WITH {_GRADED} SELECT author, thesis_id, reviewed_on, round(avg(pow(prob - hit, 2)) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS cumulative, CASE WHEN count(*) OVER (w ROWS 9 PRECEDING) = 10 THEN round(avg(pow(prob - hit, 2)) OVER (w ROWS 9 PRECEDING), 6) END AS rolling
FROM graded WINDOW w AS (PARTITION BY author ORDER BY reviewed_on, thesis_id)""")
def c4_w11_trend(f: Feeds) -> DataFrame:
    return rounded(calibration.trend(calibration.graded(f.reviews, f.forecasts)))


@query(f"""WITH {_GRADED} SELECT author, thesis_id, reviewed_on, round(avg(pow(prob - hit, 2)) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS cumulative, CASE WHEN count(*) OVER (w ROWS 9 PRECEDING) = 10 THEN round(avg(pow(prob - hit, 2)) OVER (w ROWS 9 PRECEDING), 6) END AS rolling
FROM graded WINDOW w AS (ORDER BY reviewed_on, thesis_id)""")
def c4_trend_over_all(f: Feeds) -> DataFrame:
    return rounded(calibration.trend_over_all(calibration.graded(f.reviews, f.forecasts)))


@query("SELECT count(*) FILTER (WHERE decision_quality = 'good') AS good, count(*) FILTER (WHERE decision_quality = 'flawed') AS flawed, round(count(*) FILTER (WHERE decision_quality = 'good') / count(decision_quality), 6) AS process_score FROM {reviews}")
def c5_decisions(f: Feeds) -> DataFrame:
    return rounded(calibration.decisions(f.reviews))


@query("""SELECT count(*) FILTER (WHERE status = 'open' AND review_date <= DATE '2024-09-01') AS n_due, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'open') AS n_open,
(SELECT list(thesis_id ORDER BY opened, thesis_id) FROM (SELECT opened, thesis_id FROM {forecasts} WHERE status = 'open' ORDER BY opened, thesis_id LIMIT 3) o) AS oldest FROM {forecasts}""")
def c6_digest(f: Feeds) -> DataFrame:
    return calibration.digest(f.forecasts, day("2024-09-01"))


@query("SELECT ticker, date, CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING) = 5 THEN round(avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), 4) END AS sma FROM {prices}")
def w12_moving_average(f: Feeds) -> DataFrame:
    return rounded(panel.moving_average(f.prices, 5).select("ticker", "date", "sma"), 4)


@query("""WITH RECURSIVE b AS (SELECT ticker, date, row_number() OVER w - 1 AS k, close - lag(close) OVER w AS mv FROM {prices} WHERE close IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)),
r AS (SELECT ticker, date, k, CAST(0 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS loss FROM b WHERE k = 0 UNION ALL
SELECT b.ticker, b.date, b.k, CASE WHEN b.k <= 14 THEN gain + greatest(mv, 0) / 14 ELSE (gain * 13 + greatest(mv, 0)) / 14 END, CASE WHEN b.k <= 14 THEN loss + greatest(-mv, 0) / 14 ELSE (loss * 13 + greatest(-mv, 0)) / 14 END FROM r JOIN b ON b.ticker = r.ticker AND b.k = r.k + 1)
SELECT ticker, date, CASE WHEN k >= 14 THEN round(CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END, 4) END AS rsi FROM r""")
def w13_wilder_rsi(f: Feeds) -> DataFrame:
    return rounded(panel.wilder_rsi(f.prices), 4)


@query("""SELECT ticker, date, round(ret_pct, 4) AS ret_pct, round(v, 4) AS avg_volume, CASE WHEN s IS NULL THEN NULL WHEN close >= a AND a >= s THEN 'UPTREND' WHEN close < a AND a < s THEN 'DOWNTREND' WHEN a >= s THEN 'PULLING BACK' ELSE 'RECOVERING' END AS state FROM (
SELECT ticker, date, close, (close / lag(close, 3) OVER w - 1) * 100 AS ret_pct, CASE WHEN count(volume) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(volume) OVER (w ROWS 2 PRECEDING) END AS v, CASE WHEN count(close) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(close) OVER (w ROWS 2 PRECEDING) END AS a,
CASE WHEN count(close) OVER (w ROWS 5 PRECEDING) = 6 THEN avg(close) OVER (w ROWS 5 PRECEDING) END AS s FROM {prices} WINDOW w AS (PARTITION BY ticker ORDER BY date)) x""")
def w14_bar_state(f: Feeds) -> DataFrame:
    return rounded(panel.bar_state(f.prices, 3, 3, 6).select("ticker", "date", "ret_pct", "avg_volume", "state"), 4)


_SWING = """b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM {prices}), h AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS d, (high - low) / close AS rng FROM b WHERE n <= 20),
g AS (SELECT *, CASE WHEN sign(d) <> lag(sign(d)) OVER (PARTITION BY ticker ORDER BY date) THEN 1 ELSE 0 END AS flip FROM h),
s AS (SELECT ticker, count(*) AS n, avg(rng) AS m, stddev_samp(rng) AS sd, CAST(sum(flip) AS BIGINT) AS direction_changes, greatest(0, least(1, 1 - abs(arg_max(close, date) - arg_min(close, date)) / sum(abs(d)))) AS oscillation, (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) AS drift FROM g GROUP BY 1 HAVING count(*) >= 10)"""


@query(f"WITH {_SWING} SELECT ticker, n, direction_changes, round(oscillation, 6) AS oscillation, round(drift, 6) AS drift, round(m * 100 / (1 + sd / m), 4) AS score FROM s")
def d3_w15_swing_metrics(f: Feeds) -> DataFrame:
    out = panel.swing_metrics(f.prices, 20)
    return out.select("ticker", "n", "direction_changes", F.round("oscillation", 6).alias("oscillation"), F.round("drift", 6).alias("drift"), F.round("score", 4).alias("score"))


@query(f"WITH {_SWING} SELECT ticker, row_number() OVER (ORDER BY m * 100 / (1 + sd / m) DESC, ticker) AS rank FROM s QUALIFY rank <= 15")
def t2_swing_top(f: Feeds) -> DataFrame:
    out = screens.ranked_with_forced(panel.swing_metrics(f.prices, 20).filter("score > 0"), "score", 15)
    return out.select("ticker", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SWING} SELECT ticker, round(oscillation, 6) AS oscillation, round(m * 100 / (1 + sd / m), 4) AS score FROM s WHERE contains(lower(ticker), '00') AND oscillation >= 0.7 AND drift >= -0.5")
def p14_swingers(f: Feeds) -> DataFrame:
    """The swing screen's filters: part of a symbol, a floor, swingers only, the best score first."""
    out = screens.contains_filter(panel.swing_metrics(f.prices, 20), "00", "ticker", {"drift": -0.5}, swingers=True, sort="score")
    return out.select("ticker", F.round("oscillation", 6).alias("oscillation"), F.round("score", 4).alias("score"))


@query("""WITH b AS (SELECT ticker, date, close, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n, count(*) OVER (PARTITION BY ticker) AS c FROM {prices})
SELECT ticker, max(c) AS n, round(max(CASE WHEN n = least(1, c) THEN close END) / max(CASE WHEN n = least(12, c) THEN close END) - 1, 6) AS momentum, round(stddev_samp(CASE WHEN n <= 12 THEN r END) * sqrt(12.0), 6) AS vol,
CASE WHEN max(c) >= 10 THEN max(CASE WHEN n = 1 THEN close END) > avg(CASE WHEN n <= 10 THEN close END) END AS above_trend FROM b GROUP BY 1 HAVING max(c) >= 12""")
def d1_live_factors(f: Feeds) -> DataFrame:
    out = panel.live_factors(f.prices, panel.MONTHLY, least=12)
    return rounded(out.select("ticker", "n", "momentum", "vol", "above_trend"))


_LIVE_DAY = "2001-12-31"
LIVE = {"price": ["momentum", "trend_distance"], "fund": ["value", "quality"], "flow": ["congress", "fund_flow"]}


def _live(f: Feeds) -> DataFrame:
    """The live composite of the gated universe: prices, facts known before the day, and flows to the day."""
    f.hold("holdings", prices=["ticker", "date", "close"])
    live = panel.live_factors(f.prices, panel.MONTHLY, least=12).withColumn("as_of", day(_LIVE_DAY))
    live = ev.fundamental_factors(live, f.facts, f.fact_splits)
    traded = f.prices.join(f.holdings.select("ticker").distinct(), "ticker", "left_semi")  # no fund moves in the others
    moves, _ = ev.fund_events(ev.holding_moves(f.holdings), traded)
    horizons = {s: backtest.Settings().flows[s] for s in ("congress", "fund")}
    events = ev.in_reach(ev.congress_events(f.trades).union(moves), day(_LIVE_DAY), day(_LIVE_DAY), horizons)
    flows = ev.decayed_flows(f.spark.range(1).select(day(_LIVE_DAY).alias("as_of")), events, horizons)
    for source, name in (("congress", "congress"), ("fund", "fund_flow")):
        live = live.join(flows.filter(F.col("source") == source).select("ticker", F.col("flow").alias(name)), "ticker", "left")
    return screens.live_composite(live, LIVE)


_LIVE_Z = lambda c: f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER () >= 2 THEN CASE WHEN stddev_pop({c}) OVER () > 0 THEN greatest(-3.0, least(3.0, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())) ELSE 0.0 END END"
_LIVE_MEAN = lambda a, b: f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE ({a} + {b}) / 2 END"
_LIVE = f"""b AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n, count(*) OVER (PARTITION BY ticker) AS c FROM {{prices}} WHERE close IS NOT NULL),
px AS (SELECT ticker, max(CASE WHEN n = 1 THEN close END) AS close, max(CASE WHEN n = least(1, c) THEN close END) / max(CASE WHEN n = least(12, c) THEN close END) - 1 AS momentum, CASE WHEN max(c) >= 10 THEN max(CASE WHEN n = 1 THEN close END) / avg(CASE WHEN n <= 10 THEN close END) - 1 END AS trend_distance FROM b GROUP BY 1 HAVING max(c) >= 12),
known AS (SELECT * FROM {{facts}} WHERE filing_date < DATE '{_LIVE_DAY}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, period_end DESC) = 1),
restated AS (SELECT k.*, coalesce((SELECT product(ratio) FROM {{fact_splits}} s WHERE s.ticker = k.ticker AND s.date > k.filing_date AND s.date <= current_date), 1.0) AS factor FROM known k),
cong AS (SELECT ticker, sum(signed_weight * pow(0.5, date_diff('day', "when", DATE '{_LIVE_DAY}') / 180.0)) AS congress FROM ({_CONGRESS}) e WHERE "when" < DATE '{_LIVE_DAY}' AND "when" >= DATE '{_LIVE_DAY}' - 365 GROUP BY 1),
{_FUND.strip().removeprefix('WITH ').rstrip()},
fund AS (SELECT ticker, sum(side * ln(1 + mag) * pow(0.5, date_diff('day', "when", DATE '{_LIVE_DAY}') / 270.0)) AS fund_flow FROM w WHERE mag > 0 AND "when" < DATE '{_LIVE_DAY}' AND "when" >= DATE '{_LIVE_DAY}' - 540 GROUP BY 1),
names AS (SELECT px.*, CASE WHEN px.close > 0 THEN eps / factor / px.close END AS value, CASE WHEN equity <> 0 THEN net_income / equity END AS quality, congress, fund_flow FROM px LEFT JOIN restated USING (ticker) LEFT JOIN cong USING (ticker) LEFT JOIN fund USING (ticker) WHERE trend_distance IS NULL OR trend_distance > 0),
z AS (SELECT ticker, {', '.join(f'{_LIVE_Z(c)} AS z_{c}' for cols in LIVE.values() for c in cols)} FROM names),
blocks3 AS (SELECT *, {', '.join(f'{_LIVE_MEAN(f"z_{cols[0]}", f"z_{cols[1]}")} AS {b}' for b, cols in LIVE.items())} FROM z),
live AS (SELECT *, coalesce((coalesce(price, 0) + coalesce(fund, 0) + coalesce(flow, 0)) / nullif(CAST(price IS NOT NULL AS INT) + CAST(fund IS NOT NULL AS INT) + CAST(flow IS NOT NULL AS INT), 0), -999.0) AS composite FROM blocks3)"""


@query(f"""WITH {_LIVE}, r AS (SELECT ticker, composite, row_number() OVER (ORDER BY composite DESC NULLS LAST, ticker) AS rank, substr(ticker, 6, 1) = '3' AS f FROM live)
SELECT ticker, round(composite, 4) AS composite, rank, f AND rank > 30 AS forced FROM r WHERE rank <= 30 OR f""")
def d2_t1_live_composite(f: Feeds) -> DataFrame:
    forced = f.sectors.filter("substr(ticker, 6, 1) = '3'").select("ticker")
    return rounded(screens.ranked_with_forced(_live(f), "composite", 30, forced).select("ticker", "composite", F.col("rank").cast("long").alias("rank"), "forced"), 4)


LIVE_FACTORS = [f"z_{c}" for cols in LIVE.values() for c in cols]
_LIVE_POINTS = f"l AS (SELECT ticker, composite, unnest([{', '.join(map(repr, LIVE_FACTORS))}]) AS factor, unnest([{', '.join(LIVE_FACTORS)}]) AS z FROM live)"
_LIVE_TITLES = f"t AS (SELECT ([{', '.join(map(repr, LIVE_FACTORS))}])[p_partkey % 5 + 1] AS top, min(p_name) AS note FROM {{part}} GROUP BY 1)"


@query(f"""WITH {_LIVE}, {_LIVE_POINTS}, {_LIVE_TITLES},
g AS (SELECT ticker, composite, coalesce(string_agg(factor, ',' ORDER BY round(z, 9) DESC, factor) FILTER (WHERE z >= 0.5), '') AS bull, coalesce(string_agg(factor, ',' ORDER BY round(z, 9), factor) FILTER (WHERE z <= -0.5), '') AS risk, first(factor ORDER BY round(abs(z), 9) DESC NULLS LAST, factor DESC) AS top FROM l GROUP BY 1, 2)
SELECT ticker, round(composite, 6) AS composite, bull, risk, CASE WHEN composite >= 1.0 THEN 5 WHEN composite >= 0.6 THEN 4 WHEN composite >= 0.2 THEN 3 WHEN composite >= -0.2 THEN 2 ELSE 1 END AS conviction, note FROM g LEFT JOIN t USING (top)""")
def d4_p11_cases(f: Feeds) -> DataFrame:
    factor = F.element_at(F.array(*map(F.lit, LIVE_FACTORS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return rounded(screens.cases(_live(f), LIVE_FACTORS, f.part.select(factor.alias("factor"), F.col("p_name").alias("title"))))


@query(f"""WITH {_LIVE}, {_LIVE_POINTS},
s AS (SELECT q.vec_id AS q, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS sim FROM {{embeddings}} q, {{embeddings}} e WHERE q.vec_id < {len(LIVE_FACTORS)} AND e.vec_id >= {len(LIVE_FACTORS)}),
n AS (SELECT ([{', '.join(map(repr, LIVE_FACTORS))}])[q + 1] AS factor, id AS note, round(sim, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) = 1)
SELECT ticker, side, CAST(row_number() OVER (PARTITION BY ticker, side ORDER BY round(abs(z), 9) DESC, factor) AS INT) AS place, factor, round(z, 5) AS z, note, similarity FROM (SELECT *, CASE WHEN z >= 0.5 THEN 'bull' WHEN z <= -0.5 THEN 'risk' END AS side FROM l) p LEFT JOIN n USING (factor) WHERE side IS NOT NULL""")
def d4_case_points(f: Feeds) -> DataFrame:
    """Each argument with the note that is nearest to its factor's question; the first vectors stand for the questions."""
    vectors = f.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = F.col("id") < len(LIVE_FACTORS)
    hits = text.top_k(vectors.filter(~asked), vectors.filter(asked), 1)
    factor = F.element_at(F.array(*map(F.lit, LIVE_FACTORS)), (F.col("query_id") + 1).cast("int"))
    return rounded(screens.case_points(_live(f), LIVE_FACTORS, hits.select(factor.alias("factor"), F.col("id").alias("note"), "similarity")), 5)


@query("SELECT ticker, CAST(min(priority) AS INT) AS priority FROM (SELECT ticker, 0 AS priority FROM {stakes} UNION ALL SELECT n_name, 1 FROM {nation} UNION ALL SELECT ticker, 2 FROM {sectors}) u GROUP BY 1")
def t7_first_of_lists(f: Feeds) -> DataFrame:
    return screens.first_of_lists(f.stakes, f.nation.select(F.col("n_name").alias("ticker")), f.sectors)


def strongest_buying(f: Feeds, top: int = 5) -> DataFrame:
    """Per quarter: the names with the strongest decayed net buying, z-scored within the quarter."""
    flow = ev.decayed_flow(_dates(f), ev.congress_events(f.trades), "congress", 180, 365)
    z = xsection.winsor_z(flow, "flow", "z", by=("as_of",))
    rank = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("flow"), "ticker"))
    return rounded(z.withColumn("rank", rank).filter(F.col("rank") <= top).select("as_of", "ticker", "flow", "z", "rank"), 4)


@query(f"""WITH flow AS (SELECT as_of, ticker, sum(signed_weight * pow(0.5, date_diff('day', "when", as_of) / 180.0)) AS flow FROM {_DATES} d JOIN ({_CONGRESS}) e ON e."when" < d.as_of AND e."when" >= d.as_of - 365 GROUP BY 1, 2)
SELECT as_of, ticker, round(flow, 4) AS flow, round(CASE WHEN n >= 5 THEN CASE WHEN sd > 0 THEN greatest(-3.0, least(3.0, (flow - m) / sd)) ELSE 0.0 END END, 4) AS z, CAST(rank AS INT) AS rank FROM (
SELECT *, count(*) OVER w AS n, avg(flow) OVER w AS m, stddev_pop(flow) OVER w AS sd, row_number() OVER (PARTITION BY as_of ORDER BY flow DESC, ticker) AS rank FROM flow WINDOW w AS (PARTITION BY as_of)) x WHERE rank <= 5""")
def flagship_strongest_buying(f: Feeds) -> DataFrame:
    return strongest_buying(f)
