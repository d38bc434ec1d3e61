"""The factor backtest as SQL, the oracle of its queries: written from the semantics, with windows and range joins where the
plan has as-of joins, running sums and stacked series."""

from __future__ import annotations

FACTORS = ("mom", "trend", "vol", "value", "quality", "congress", "fund", "insider", "activism", "short")
_HORIZONS = {"congress": (180, 365), "fund": (270, 540), "insider": (90, 180), "activism": (365, 730)}


def _z(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER m >= 5 THEN CASE WHEN stddev_pop({x}) OVER m > 0 THEN greatest(-3.0, least(3.0, ({x} - avg({x}) OVER m) / stddev_pop({x}) OVER m)) ELSE 0.0 END END"


def _mean(*xs: str) -> str:
    return f"(({' + '.join(f'coalesce({x}, 0)' for x in xs)}) / nullif({' + '.join(f'CAST({x} IS NOT NULL AS INT)' for x in xs)}, 0))"


def factor_rows(grid: str, congress: str, fund: str) -> str:
    """CTEs up to ``base``: members at rebalance dates with raw factors. ``grid`` has cal and feats, ``fund`` has w."""
    case = lambda i: "CASE source " + " ".join(f"WHEN '{s}' THEN {h[i]}" for s, h in _HORIZONS.items()) + " END"
    flows = ", ".join(f"max(CASE WHEN source = '{s}' THEN flow END) AS {s}" for s in _HORIZONS)
    return f"""{grid},
months AS (SELECT date AS as_of, bar_ix, row_number() OVER (ORDER BY date) - 1 AS month_ix FROM cal WHERE bar_ix >= 12 AND bar_ix < (SELECT max(bar_ix) FROM cal)),
at_months AS (SELECT m.month_ix, m.as_of, f.ticker, f.close, f.mom, f.trend, f.vol, CASE WHEN lead(m.month_ix) OVER t = m.month_ix + 1 AND close > 0 THEN lead(close) OVER t / close - 1 END AS fwd FROM feats f JOIN months m ON f.bar_ix = m.bar_ix WINDOW t AS (PARTITION BY f.ticker ORDER BY m.month_ix)),
members AS (SELECT DISTINCT m.as_of, x.ticker FROM months m JOIN {{membership}} x ON x.snap_date = (SELECT max(y.snap_date) FROM {{membership}} y WHERE y.snap_date <= m.as_of)),
held AS (SELECT a.*, s.sector FROM at_months a JOIN members USING (as_of, ticker) LEFT JOIN {{sectors}} s USING (ticker)),
known AS (SELECT h.month_ix, h.ticker, f.* EXCLUDE (ticker) FROM held h JOIN {{facts}} f ON f.ticker = h.ticker AND f.filing_date < h.as_of QUALIFY row_number() OVER (PARTITION BY h.month_ix, h.ticker ORDER BY f.filing_date DESC, f.period_end DESC) = 1),
restated AS (SELECT k.*, coalesce((SELECT product(ratio) FROM {{fact_splits}} s WHERE s.ticker = k.ticker AND s.ratio > 0 AND s.date > k.filing_date AND s.date <= current_date), 1.0) AS factor FROM known k),
{fund},
flow_events AS ({congress}
  UNION ALL SELECT 'fund', ticker, "when", side * ln(1 + mag) FROM w WHERE mag > 0
  UNION ALL SELECT 'insider', ticker, filing_date, greatest(percent_rank() OVER (PARTITION BY date_trunc('month', filing_date) ORDER BY value), 0.01) * ln(1 + filers) FROM (
    SELECT i.*, c.filers FROM {{buys}} i JOIN (SELECT ticker, date_trunc('month', filing_date) AS mon, count(DISTINCT filer) AS filers FROM {{buys}} WHERE value > 0 GROUP BY 1, 2) c ON i.ticker = c.ticker AND date_trunc('month', i.filing_date) = c.mon WHERE value > 0) x
  UNION ALL SELECT 'activism', ticker, filing_date, 1.0 FROM {{blocks}}),
flows AS (SELECT month_ix, ticker, source, sum(signed_weight * pow(0.5, date_diff('day', "when", as_of) / CAST({case(0)} AS DOUBLE))) AS flow FROM months JOIN flow_events e ON e."when" < as_of AND e."when" >= as_of - CAST({case(1)} AS INT) GROUP BY 1, 2, 3),
flow_columns AS (SELECT month_ix, ticker, {flows} FROM flows GROUP BY 1, 2),
sessions AS (SELECT date, row_number() OVER (ORDER BY date) AS ix FROM (SELECT DISTINCT date FROM {{shorts}} WHERE total_volume > 0) d),
last_session AS (SELECT month_ix, max(ix) AS ix FROM months JOIN sessions s ON s.date < as_of GROUP BY 1),
pressure AS (SELECT month_ix, ticker, -avg(short_volume / total_volume) AS short FROM last_session q JOIN sessions s ON s.ix BETWEEN q.ix - 4 AND q.ix JOIN {{shorts}} t ON t.date = s.date WHERE total_volume > 0 GROUP BY 1, 2),
base AS (SELECT h.*, CASE WHEN close > 0 THEN eps / factor / close END AS value, CASE WHEN equity <> 0 THEN net_income / equity END AS quality, {', '.join(_HORIZONS)}, short
  FROM held h LEFT JOIN restated USING (month_ix, ticker) LEFT JOIN flow_columns USING (month_ix, ticker) LEFT JOIN pressure USING (month_ix, ticker))"""


def scored_rows() -> str:
    """CTEs after ``base``: ``scored`` (z, blocks, variants, demeaned return), ``ic`` by series and ``ic_stats``."""
    series = [f"z_{f}" for f in FACTORS] + ["full", "price", "price_fund"]
    stacked = " UNION ALL ".join(f"SELECT month_ix, ticker, fwd_dm, '{s}' AS series, \"{s}\" AS score FROM scored" for s in series)
    return f"""eligible AS (SELECT * FROM base WHERE close IS NOT NULL AND mom IS NOT NULL AND trend IS NOT NULL AND vol IS NOT NULL QUALIFY count(*) OVER (PARTITION BY month_ix) >= 5),
z AS (SELECT *, {', '.join(f'{_z(f)} AS z_{f}' for f in FACTORS)},
  fwd - CASE WHEN sector IS NOT NULL AND count(fwd) OVER (PARTITION BY month_ix, sector) >= 5 THEN avg(fwd) OVER (PARTITION BY month_ix, sector) ELSE avg(fwd) OVER m END AS fwd_dm FROM eligible WINDOW m AS (PARTITION BY month_ix)),
blocks_of AS (SELECT *, {_mean('z_mom', 'z_trend')} AS price, {_mean('z_value', 'z_quality')} AS fund_block, {_mean('z_congress', 'z_fund')} AS flow_block FROM z),
scored AS (SELECT *, {_mean('price', 'fund_block', 'flow_block')} AS "full", {_mean('price', 'fund_block')} AS price_fund FROM blocks_of WHERE fwd IS NOT NULL),
stacked AS ({stacked}),
ic AS (SELECT series, month_ix, CASE WHEN count(*) >= 10 THEN corr(x, y) END AS value FROM (SELECT series, month_ix, row_number() OVER (PARTITION BY series, month_ix ORDER BY score, ticker) AS x, row_number() OVER (PARTITION BY series, month_ix ORDER BY fwd_dm, ticker) AS y FROM stacked WHERE score IS NOT NULL AND fwd_dm IS NOT NULL) r GROUP BY 1, 2),
{newey_west('ic', 'ic_stats')}"""


def newey_west(source: str, out: str) -> str:
    """CTEs that end in ``out`` (series, n, mean, lag, t, naive_t) of a table of (series, month_ix, value)."""
    return f"""{out}_e AS (SELECT series, value - avg(value) OVER s AS e, avg(value) OVER s AS mean, stddev_pop(value) OVER s AS sd, count(*) OVER s AS n, row_number() OVER (PARTITION BY series ORDER BY month_ix) AS i FROM {source} WHERE value IS NOT NULL WINDOW s AS (PARTITION BY series)),
{out}_l AS (SELECT series, max(n) AS n, max(mean) AS mean, max(sd) AS sd, CAST(greatest(1, least(floor(4 * pow(max(n) / 100.0, 2.0 / 9)), max(n) - 1)) AS INT) AS lag FROM {out}_e GROUP BY 1),
{out}_g AS (SELECT a.series, b.i - a.i AS k, avg(a.e * b.e) AS g FROM {out}_e a JOIN {out}_e b ON a.series = b.series AND b.i >= a.i JOIN {out}_l l ON l.series = a.series WHERE b.i - a.i <= lag GROUP BY 1, 2),
{out}_v AS (SELECT series, sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lag + 1)) * g END) AS lrv FROM {out}_g JOIN {out}_l USING (series) GROUP BY 1),
{out} AS (SELECT series, n, mean, lag, CASE WHEN n >= 3 AND lrv > 1e-300 THEN mean / sqrt(lrv / n) ELSE 0.0 END AS t, CASE WHEN sd > 0 THEN mean / sd * sqrt(n) ELSE 0.0 END AS naive_t FROM {out}_l JOIN {out}_v USING (series))"""


def holdings(name: str, score: str, least: int, side: str = "DESC") -> str:
    """CTEs that end in ``name`` (month_ix, seq, gross, turnover, n) of the bucket of a score."""
    return f"""{name}_r AS (SELECT month_ix, ticker, fwd, count(*) OVER (PARTITION BY month_ix) AS c, row_number() OVER (PARTITION BY month_ix ORDER BY {score} {side}, ticker) AS p FROM scored WHERE {score} IS NOT NULL),
{name}_h AS (SELECT month_ix, ticker, fwd, dense_rank() OVER (ORDER BY month_ix) AS seq FROM {name}_r WHERE c >= {least} AND p <= greatest(1, floor(c * 0.1))),
{name} AS (SELECT h.month_ix, h.seq, avg(h.fwd) AS gross, CASE WHEN h.seq = 1 THEN 1.0 ELSE 1 - count(b.ticker) / count(*) END AS turnover, count(*) AS n FROM {name}_h h LEFT JOIN {name}_h b ON b.ticker = h.ticker AND b.seq = h.seq - 1 GROUP BY 1, 2)"""


def summary() -> str:
    """Query after ``scored``: CAGR, Sharpe, drawdown, hit rate and turnover of each variant."""
    variants = ("full", "price", "price_fund")
    every = " UNION ALL ".join(f"SELECT '{v}' AS series, month_ix, gross - turnover * 0.001 AS net, turnover FROM top_{v}" for v in variants)
    return f""", {', '.join(holdings(f'top_{v}', f'"{v}"', 5) for v in variants)}, every AS ({every}),
grown AS (SELECT *, exp(sum(ln(1 + net)) OVER w) AS growth FROM every WINDOW w AS (PARTITION BY series ORDER BY month_ix)),
deep AS (SELECT *, growth / max(growth) OVER (PARTITION BY series ORDER BY month_ix) - 1 AS dd FROM grown),
bench AS (SELECT month_ix, avg(fwd) AS ret FROM scored GROUP BY 1)
SELECT series, count(*) AS n, round(pow(exp(sum(ln(1 + net))), 12.0 / count(*)) - 1, 6) AS cagr, round(avg(net) / nullif(stddev_pop(net), 0) * sqrt(12.0), 6) AS sharpe, round(min(dd), 6) AS max_drawdown,
  round(avg(CASE WHEN net > ret THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(turnover), 6) AS avg_turnover FROM deep JOIN bench USING (month_ix) GROUP BY 1"""


def long_short() -> str:
    return f""", {holdings('high', '"full"', 10)}, {holdings('low', '"full"', 10, 'ASC')}
SELECT month_ix, round(h.gross - l.gross, 6) AS gross, round(h.gross - l.gross - h.turnover * 0.001 - l.turnover * 0.0025, 6) AS net FROM high h JOIN low l USING (month_ix)"""


def gate(own_bar: float, zoo_bar: float) -> str:
    return f"""
SELECT series, n, round(mean, 6) AS mean, lag, round(t, 6) AS t, round({own_bar!r}, 6) AS own_bar, round({zoo_bar!r}, 6) AS zoo_bar, CASE WHEN abs(t) >= {zoo_bar!r} THEN 'passes both' WHEN abs(t) >= {own_bar!r} THEN 'passes own' ELSE 'fails' END AS verdict FROM ic_stats"""


def split_sample(factor: str, split_after: str, start_year: int) -> str:
    """Query after ``base``."""
    return f""", rated AS (SELECT month_ix, ticker, fwd, CASE WHEN as_of <= DATE '{split_after}' THEN 'in' ELSE 'out' END AS series, {_z(factor)} AS score FROM base WHERE fwd IS NOT NULL AND year(as_of) >= {start_year} WINDOW m AS (PARTITION BY month_ix)),
split_ic AS (SELECT series, month_ix, CASE WHEN count(*) >= 5 THEN corr(x, y) END AS value FROM (SELECT series, month_ix, row_number() OVER (PARTITION BY series, month_ix ORDER BY score, ticker) AS x, row_number() OVER (PARTITION BY series, month_ix ORDER BY fwd, ticker) AS y FROM rated WHERE score IS NOT NULL) r GROUP BY 1, 2),
{newey_west('split_ic', 'split_stats')}
SELECT series, n, round(mean, 6) AS mean, lag, round(t, 6) AS t, round(naive_t, 6) AS naive_t, {{verdict}} AS verdict FROM split_stats"""


def snapshot(day: str, earlier: str) -> str:
    """Query after ``ic_stats``: the history with the run of a day and that of an earlier one."""
    shares = " UNION ALL ".join(f"SELECT '{f}' AS factor, avg(c) AS coverage FROM (SELECT count(z_{f}) / count(*) AS c FROM scored GROUP BY month_ix) x" for f in FACTORS)
    return f""", shares AS ({shares}),
priced AS (SELECT avg(c) AS universe_coverage FROM (SELECT m.as_of, count(p.ticker) / count(*) AS c FROM members m LEFT JOIN (SELECT DISTINCT ticker, date FROM {{prices}} WHERE close IS NOT NULL) p ON p.ticker = m.ticker AND p.date = m.as_of GROUP BY 1) x),
run AS (SELECT factor, round(mean, 6) AS ic_mean, round(naive_t, 6) AS ic_tstat, round(t, 6) AS ic_tstat_nw, round(coverage, 6) AS coverage, (SELECT count(DISTINCT month_ix) FROM scored) AS n_months, (SELECT round(universe_coverage, 6) FROM priced) AS universe_coverage FROM ic_stats JOIN shares ON series = 'z_' || factor)
SELECT DATE '{day}' AS snapshot_date, * FROM run UNION ALL SELECT DATE '{earlier}', * FROM run"""
