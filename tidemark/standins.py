"""Stand-in feeds over the driver's star-schema tables, in SQL that Spark and DuckDB read alike.

Every operator takes plain columns, so a real feed needs no stand-in. A name in braces is a table or another stand-in.
Sums run over decimals, so both engines add the same numbers whatever their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.storage import stored

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TICKER = "concat('T', lpad(CAST({} AS STRING), 5, '0'))"
_BAR = """CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS close,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS volume"""

STANDINS = {
    "prices": f"SELECT {_TICKER.format('l_suppkey')} AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, {_BAR} FROM {{lineitem}} GROUP BY 1, 2",
    "weekly": f"SELECT n_name AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_BAR} FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "sectors": f"SELECT {_TICKER.format('s_suppkey')} AS ticker, r_name AS sector FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey",
    "trades": f"""SELECT o_orderkey AS trade_id, concat('M', CAST(o_custkey AS STRING)) AS member, {_TICKER.format('first_supp')} AS ticker,
  CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'Sale (Full)' ELSE 'Exchange' END AS transaction_type,
  CASE WHEN o_totalprice < 50000 THEN '$15,001 - $50,000' WHEN o_totalprice < 100000 THEN '$50,001 - $100,000' WHEN o_totalprice < 250000 THEN '$100,001 - $250,000' WHEN o_totalprice < 450000 THEN '$250,000' ELSE '--' END AS amount,
  CAST(o_orderdate AS DATE) AS transaction_date, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 97 AS INT) END AS disclosure_date,
  concat('https://reports.example/', CAST(o_orderkey % 997 AS STRING)) AS report_url, CASE WHEN o_orderkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber,
  CASE WHEN o_orderkey % 53 = 0 THEN true END AS amended, CASE WHEN o_orderkey % 59 = 0 THEN false END AS ticker_ok
  FROM {{orders}} JOIN (SELECT l_orderkey, min(l_suppkey) AS first_supp FROM {{lineitem}} GROUP BY 1) f ON o_orderkey = l_orderkey""",
    "holdings": f"""SELECT concat('F', CAST(l_suppkey % 20 AS STRING)) AS manager, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS filing_date, {_TICKER.format('l_partkey % 100')} AS ticker,
  CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS shares, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS value FROM {{lineitem}} GROUP BY 1, 2, 3""",
    "insiders": "SELECT n_name AS ticker, concat('C', CAST(o_custkey AS STRING)) AS filer, CAST(o_orderdate AS DATE) AS filing_date, o_totalprice AS value, o_orderkey AS buy_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'",
    "fundamentals": """SELECT ticker, make_date(y, 12, 31) AS period_end, make_date(y + 1, 2, 14) AS filing_date, ni / 1000000 AS eps, ni AS net_income, CASE WHEN y % 7 = 0 THEN NULL ELSE ni * 4 END AS equity FROM (
  SELECT n_name AS ticker, CAST(year(o_orderdate) AS INT) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS ni FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2) f
  UNION ALL SELECT ticker, make_date(y - 1, 12, 31), make_date(y + 1, 2, 14), CAST(y AS DOUBLE), NULL, NULL FROM (SELECT DISTINCT n_name AS ticker, CAST(year(o_orderdate) AS INT) AS y FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) g""",
    "splits": "SELECT n_name AS ticker, make_date(CAST(1998 + p_partkey % 6 AS INT), CAST(1 + p_partkey % 12 AS INT), 15) AS date, CAST(1 + p_size % 3 AS DOUBLE) AS ratio FROM {part} JOIN {nation} ON p_partkey = n_nationkey",
    "shorts": f"""SELECT {_TICKER.format('l_suppkey')} AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) ELSE 0 END) AS BIGINT) AS short_volume, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS total_volume FROM {{lineitem}} GROUP BY 1, 2""",
    "membership": f"SELECT DISTINCT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS snap_date, {_TICKER.format('l_suppkey')} AS ticker FROM {{lineitem}} WHERE l_linenumber = 1",
    "runs": "SELECT event_type AS source, ts AS ran_at, value < 400 AS ok, event_id FROM {events}",
    "forecasts": """SELECT d.doc_id AS thesis_id, d.source AS author, CAST(1 + d.doc_id % 5 AS INT) AS conviction, CASE WHEN d.doc_id % 4 = 0 THEN 'open' WHEN d.doc_id % 9 = 0 THEN 'pending' WHEN quality = 1 THEN 'right' ELSE 'wrong' END AS status,
  make_date(2024, 1, 1) + CAST(d.doc_id % 300 AS INT) AS opened, make_date(2024, 6, 1) + CAST(d.doc_id % 300 AS INT) AS review_date, quality FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "reviews": """SELECT thesis_id, make_date(2024, 7, 1) + CAST(thesis_id % 400 AS INT) AS reviewed_on, CASE WHEN thesis_id % 13 = 0 THEN 'unclear' WHEN quality = 1 THEN 'right' ELSE 'wrong' END AS outcome,
  CASE WHEN thesis_id % 3 = 0 THEN 'good' WHEN thesis_id % 3 = 1 THEN 'flawed' END AS decision_quality FROM {forecasts} WHERE status <> 'pending'""",
    "stakes": "SELECT n_name AS ticker, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS stake_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    "facts": f"""SELECT ticker, make_date(y, 12, 31) AS period_end, make_date(y + 1, 2, 14) AS filing_date, ni / 1000000 AS eps, ni AS net_income, CASE WHEN y % 7 = 0 THEN NULL ELSE ni * 4 END AS equity FROM (
  SELECT {_TICKER.format('l_suppkey')} AS ticker, CAST(year(l_shipdate) AS INT) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS ni FROM {{lineitem}} GROUP BY 1, 2) x""",
    "fact_splits": f"SELECT {_TICKER.format('s_suppkey')} AS ticker, make_date(CAST(1994 + s_suppkey % 5 AS INT), CAST(1 + s_suppkey % 12 AS INT), 15) AS date, CAST(2 + s_suppkey % 2 AS DOUBLE) AS ratio FROM {{supplier}} WHERE s_acctbal > 0",
    "buys": "SELECT ticker, member AS filer, transaction_date AS filing_date, CAST(trade_id % 1000 AS DOUBLE) AS value, trade_id AS buy_id FROM {trades} WHERE transaction_type = 'P'",
    "blocks": "SELECT ticker, transaction_date AS filing_date, trade_id AS stake_id FROM {trades} WHERE transaction_type = 'Exchange'",
}


class Feeds:
    """The tables of one folder and the stand-ins over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in STANDINS):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.spark.sql(STANDINS[name], **{n: getattr(self, n) for n in _names(STANDINS[name])})
        return self._made[name]

    def hold(self, *names: str, **columns: list[str]) -> None:
        """Stores stand-ins that a query reads more than once, whole or (by keyword) the columns that it reads; each is then
        made from its tables once. Stand-ins over them read what is stored, so they are asked for later."""
        for name in (*names, *columns):
            self._made[name] = stored(getattr(self, name).select(columns.get(name, "*")), name)


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def duck_sql(sql: str) -> str:
    """``sql`` for DuckDB, with the stand-ins that it names in braces as common table expressions before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n in STANDINS and n not in order:
                visit(STANDINS[n])
                order.append(n)

    visit(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    heads = [f"{n} AS ({plain(STANDINS[n])})" for n in order]
    body = plain(sql).strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else ""
    if recursive:
        body = f"WITH {body[len('WITH RECURSIVE '):]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {recursive}" + ",\n".join([*heads, body[5:]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body
