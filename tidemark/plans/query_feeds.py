"""Queries on sources, parsing, upserts and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import audit, panel, upsert
from tidemark.operators.events import holding_moves, holdings_rollup
from tidemark.plans.registry import day, query, rounded
from tidemark.sources import bundles, documents, files
from tidemark.standins import Feeds
from tidemark.storage import fresh_path

TRADE_KEY = ["member", "ticker", "transaction_type", "amount", "transaction_date", "chamber"]
_SIGN = "CASE WHEN transaction_type = 'P' THEN 1 WHEN transaction_type = 'Sale (Full)' THEN -1 ELSE 0 END"
_MID = "CASE amount WHEN '$15,001 - $50,000' THEN 32500.5 WHEN '$50,001 - $100,000' THEN 75000.5 WHEN '$100,001 - $250,000' THEN 175000.5 WHEN '$250,000' THEN 250000.0 ELSE 0.0 END"


@query("SELECT ticker, date, close, high, low, volume FROM {prices} WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND ticker IN (SELECT ticker FROM {sectors} WHERE sector = (SELECT min(r_name) FROM {region}))")
def s1_read_panel(f: Feeds) -> DataFrame:
    first = f.region.agg(F.min("r_name").alias("sector"))
    return panel.read_panel(f.prices, day("1998-01-01"), day("1999-12-31"), f.sectors.join(F.broadcast(first), "sector"))


@query("SELECT snap_date, replace(ticker, '.', '-') AS ticker FROM {membership}")
def s2_membership_lines(f: Feeds) -> DataFrame:
    line = f.membership.groupBy("snap_date").agg(F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("t")).select(F.concat(F.date_format("snap_date", "yyyy-MM-dd"), F.lit(',"'), "t", F.lit('"')).alias("line"))
    return files.parse_membership(line.union(f.nation.select(F.concat(F.lit("# "), "n_name"))))


@query("SELECT sector, count(*) AS n FROM {sectors} GROUP BY 1")
def s3_sector_map(f: Feeds) -> DataFrame:
    return f.sectors.groupBy("sector").agg(F.count("*").alias("n"))


_SHORT_LINES = "concat_ws('|', date_format(date, 'yyyyMMdd'), ticker, CAST(short_volume AS STRING), '0', CASE WHEN short_volume % 7 = 0 THEN 'n/a' ELSE CAST(total_volume AS STRING) END, 'N')"


@query("SELECT date, ticker, short_volume, total_volume FROM {shorts} WHERE short_volume % 7 <> 0")
def s4_short_volume_lines(f: Feeds) -> DataFrame:
    return files.parse_short_volume(f.shorts.select(F.expr(_SHORT_LINES).alias("line")))


@query("""SELECT ticker, filer, 'officer' AS role, filing_date, filing_date AS date, CAST(buy_id % 100 + 1 AS DOUBLE) AS shares, 2.5 AS price, (buy_id % 100 + 1) * 2.5 AS value
FROM {insiders} WHERE buy_id % 3 <> 0""")
def s5_insider_bundle(f: Feeds) -> DataFrame:
    rows = f.insiders.withColumn("acc", F.col("buy_id").cast("string"))
    stamp = F.upper(F.date_format("filing_date", "dd-MMM-yyyy"))
    subs = rows.select(F.col("acc").alias("ACCESSION_NUMBER"), stamp.alias("FILING_DATE"), F.when(F.col("buy_id") % 3 == 0, "3").otherwise("4").alias("DOCUMENT_TYPE"), F.col("ticker").alias("ISSUERTRADINGSYMBOL"))
    one = lambda cik, name: rows.select(F.col("acc").alias("ACCESSION_NUMBER"), F.lit(cik).alias("RPTOWNERCIK"), name.alias("RPTOWNERNAME"), F.lit("Director, Officer").alias("RPTOWNER_RELATIONSHIP"))
    owners = one("1", F.col("filer")).union(one("2", F.lit("other")))
    trades = rows.select(F.col("acc").alias("ACCESSION_NUMBER"), stamp.alias("TRANS_DATE"), F.lit("P").alias("TRANS_CODE"), (F.col("buy_id") % 100 + 1).cast("string").alias("TRANS_SHARES"), F.lit("2.5").alias("TRANS_PRICEPERSHARE"), F.lit("A").alias("TRANS_ACQUIRED_DISP_CD"))
    universe = f.nation.select(F.upper("n_name").alias("ticker"))
    return files.insider_buys(subs, owners, trades, universe)


#: Filings of an archive, about.
_ARCHIVE = 2_000


@query("""SELECT ticker, filer, CASE buy_id % 4 WHEN 0 THEN 'director' WHEN 1 THEN 'officer' WHEN 2 THEN 'owner' ELSE 'other' END AS role, filing_date, filing_date AS date, CAST(buy_id % 100 + 1 AS DOUBLE) AS shares, 2.5 AS price, (buy_id % 100 + 1) * 2.5 AS value
FROM {insiders} WHERE buy_id % 3 <> 0 AND buy_id % 7 <> 0""")
def s5_insider_archives(f: Feeds) -> DataFrame:
    """The bundle written as archives and read back by the data source. A filing's first owner has the larger CIK, so only
    the order of the file tells which one counts; some trades are disposals."""
    n = -(-f.insiders.count() // _ARCHIVE)
    rows = f.insiders.withColumn("acc", F.col("buy_id").cast("string")).withColumn("part", F.pmod(F.xxhash64("buy_id"), F.lit(max(1, n)))).withColumn("line", F.col("buy_id") * 2)
    stamp = F.upper(F.date_format("filing_date", "dd-MMM-yyyy"))
    key = F.col("acc").alias("ACCESSION_NUMBER")
    kind = F.element_at(F.array(*map(F.lit, ("Director", "Officer", "TenPercentOwner", ""))), (F.col("buy_id") % 4 + 1).cast("int"))
    subs = rows.select("part", "line", key, stamp.alias("FILING_DATE"), F.when(F.col("buy_id") % 3 == 0, "3").otherwise("4").alias("DOCUMENT_TYPE"), F.col("ticker").alias("ISSUERTRADINGSYMBOL"))
    one = lambda step, cik, name, kind: rows.select("part", (F.col("line") + step).alias("line"), key, F.lit(cik).alias("RPTOWNERCIK"), name.alias("RPTOWNERNAME"), kind.alias("RPTOWNER_RELATIONSHIP"))
    owners = one(0, "9", F.col("filer"), kind).union(one(1, "1", F.lit("other"), F.lit("Officer")))
    side = F.when(F.col("buy_id") % 7 == 0, "D").when(F.col("buy_id") % 2 == 0, "A").otherwise("")
    trades = rows.select("part", "line", key, stamp.alias("TRANS_DATE"), F.lit("P").alias("TRANS_CODE"), (F.col("buy_id") % 100 + 1).cast("string").alias("TRANS_SHARES"), F.lit("2.5").alias("TRANS_PRICEPERSHARE"), side.alias("TRANS_ACQUIRED_DISP_CD"))
    folder = f"{fresh_path(f.spark, 'query')}/bundles"
    bundles.write_bundles(dict(zip(bundles.INSIDER_TABLES, (subs, owners, trades))), "part", folder)
    return files.insider_buys(*bundles.insider_tables(f.spark, folder), f.nation.select(F.upper("n_name").alias("ticker")))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM {orders}")
def s6_month_name_dates(f: Feeds) -> DataFrame:
    text = F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    return f.orders.select("o_orderkey", sc.month_name_day(text).alias("day"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'officer' WHEN s_suppkey % 4 = 1 THEN 'director' WHEN s_suppkey % 4 = 2 THEN 'owner' ELSE 'other' END AS role FROM {supplier}")
def s7_owner_roles(f: Feeds) -> DataFrame:
    k = F.col("s_suppkey") % 4
    return f.supplier.select("s_suppkey", sc.owner_role(F.when(k == 0, "Director;Officer").when(k == 1, "Director,TenPercentOwner").when(k == 2, "TenPercentOwner")).alias("role"))


@query(f"""SELECT member AS senator, ticker, transaction_type, amount, transaction_date, report_url FROM {{trades}} WHERE trade_id % 5 <> 0""")
def s8_disclosure_html(f: Feeds) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td class='x'> <b>"), c, F.lit("</b>&nbsp;</td>"))
    symbol = F.when(F.col("trade_id") % 5 == 0, "--").otherwise(F.col("ticker"))
    row = F.concat(F.lit("<tr>"), cell(F.lit("1")), cell(F.date_format("transaction_date", "MM/dd/yyyy")), cell(F.lit("Self")), cell(symbol), cell(F.lit("Asset &amp; Co")), cell(F.lit("Stock")), cell(F.col("transaction_type")), cell(F.col("amount")), F.lit("</tr>"))
    pages = f.trades.select(F.col("report_url").alias("url"), F.concat("member", F.lit(" (Senator)")).alias("senator"), "disclosure_date", F.concat(F.lit("<table>"), row, F.lit("<tr><td>short</td></tr></table>")).alias("html"))
    return documents.disclosure_trades(pages).select("senator", "ticker", "transaction_type", "amount", "transaction_date", "report_url")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(substr(p_name, 1, 3)) END AS symbol FROM {part}")
def s10_asset_cells(f: Feeds) -> DataFrame:
    k = F.col("p_partkey") % 3
    cell = F.concat("p_name", F.when(k == 0, F.concat(F.lit(" ("), F.upper(F.substring("p_name", 1, 3)), F.lit(") [ST]"))).when(k == 1, F.lit(" (X) [ST]")).otherwise(F.lit(" [GS]")))
    return f.part.select("p_partkey", documents.cell_symbol(cell).alias("symbol"))


@query("SELECT concat('item ', CAST(item_id AS STRING)) AS title, concat('https://feed.example/', CAST(item_id AS STRING)) AS link, make_date(2024, 3, CAST(1 + item_id % 28 AS INT)) AS day, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM {benchmark}")
def s11_rss_items(f: Feeds) -> DataFrame:
    stamp = F.date_format(F.make_date(F.lit(2024), F.lit(3), (1 + F.col("item_id") % 28).cast("int")), "d MMM yyyy")
    item = F.concat(F.lit("<item><title>item "), F.col("item_id").cast("string"), F.lit("</title><link>https://feed.example/"), F.col("item_id").cast("string"), F.lit("</link><pubDate>Mon, "), stamp, F.lit(" 10:00:00 GMT</pubDate><description><![CDATA[<p>"), "text", F.lit("</p>]]></description></item>"))
    return documents.feed_items(f.benchmark.select(F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>")).alias("xml")))


_ENTITIES = sorted(documents.ENTITIES | documents.BARE_ENTITIES)
_CHARACTERS = ", ".join("('{}', '{}', {})".format(n, (documents.ENTITIES | documents.BARE_ENTITIES)[n].replace("'", "''"), k) for k, n in enumerate(_ENTITIES))

_WHITE = "[\\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


@query(r"""WITH v(name, c, k) AS (VALUES %s), bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs') AS t FROM {pages}),
p AS (SELECT page_id, unnest(string_split(t, '&')) AS piece, generate_subscripts(string_split(t, '&'), 1) AS place FROM bare),
r AS (SELECT *, regexp_extract(piece, '^(#[0-9]+;|[A-Za-z0-9]+;|%s)', 1) AS name FROM p),
j AS (SELECT page_id, place, CASE WHEN place = 1 THEN piece WHEN name LIKE '#%%' THEN concat(chr(CAST(regexp_extract(name, '[0-9]+') AS INT)), substr(piece, length(name) + 1)) WHEN c IS NOT NULL THEN concat(c, substr(piece, length(name) + 1)) ELSE concat('&', piece) END AS s FROM r LEFT JOIN v USING (name))
SELECT page_id, trim(regexp_replace(string_agg(s, '' ORDER BY place), '%s', ' ', 'g')) AS body FROM j GROUP BY 1""" % (_CHARACTERS, "|".join(documents.BARE_ENTITIES), _WHITE))
def s12_html_text(f: Feeds) -> DataFrame:
    return f.pages.select("page_id", documents.html_text(F.col("html")).alias("body"))


@query(f"SELECT o_orderkey, trim(regexp_replace(concat('A ', c, 'x & B', chr(CAST(160 + o_orderkey % 40000 AS INT)), '.'), '{_WHITE}', ' ', 'g')) AS body FROM {{orders}} JOIN (VALUES {_CHARACTERS}) v(name, c, k) ON k = o_orderkey % {len(_ENTITIES)}")
def s12_entities(f: Feeds) -> DataFrame:
    """Every named reference in turn, an ampersand that is none, and a numbered reference."""
    names = F.split(F.lit(" ".join(_ENTITIES)), " ")
    page = F.concat(F.lit("<p>A &"), F.element_at(names, (F.col("o_orderkey") % len(_ENTITIES) + 1).cast("int")), F.lit("x & B&#"), (F.col("o_orderkey") % 40000 + 160).cast("string"), F.lit(";.</p>"))
    return f.orders.select("o_orderkey", documents.html_text(page).alias("body"))


@query(r"""WITH n AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, doc_id % 7 = 3 AS bad, concat('notes/', CASE WHEN doc_id % 3 = 0 THEN 'Tier-2/' ELSE '' END, CAST(doc_id AS VARCHAR)) AS path FROM {documents})
SELECT path, CASE WHEN NOT bad THEN concat('note ', doc_id) END AS title, CASE WHEN NOT bad AND doc_id % 4 = 0 THEN 1 WHEN NOT bad AND doc_id % 4 = 1 THEN 4 WHEN doc_id % 3 = 0 THEN 2 END AS tier,
CASE WHEN bad THEN '' ELSE array_to_string(list_sort(list_distinct([x for x in [lower(trim(lang)), lower(trim(source)), 'shared'] if x <> ''])), ',') END AS tags, CASE WHEN bad THEN 0 ELSE 2 END AS n_factors,
CAST(CASE WHEN bad THEN length(t) ELSE length(concat('note ', doc_id)) + 2 + 8 + 2 + length(regexp_replace(t, '^\s+', '')) END AS INT) AS body_chars FROM n""")
def s13_note_front_matter(f: Feeds) -> DataFrame:
    """A note per document; of one in seven the front matter isn't well formed."""
    key = F.col("doc_id")
    first = F.when(key % 7 == 3, F.concat(F.lit("title: note: "), key.cast("string"))).otherwise(F.concat(F.lit("title: note "), key.cast("string")))
    priority = F.when(key % 4 == 0, "Critical").when(key % 4 == 1, "low").otherwise("none")
    of = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("---\n"), first, F.lit("\naliases: [one, \"two\"]\ntags: ["), of("lang"), F.lit(", "), of("source"), F.lit("]\ndomains: Shared\nretrieval_priority: "), priority, F.lit("\nfactors:\n  - mom\n  - value\ntype: research-finding\n---\n"))
    path = F.concat(F.lit("notes/"), F.when(key % 3 == 0, "Tier-2/").otherwise(""), key.cast("string"))
    notes = f.documents.select(path.alias("path"), F.concat(head, of("text")).alias("text"))
    return documents.parse_notes(notes).select("path", "title", "tier", F.array_join("tags", ",").alias("tags"), F.size("factors").alias("n_factors"), F.length("body").alias("body_chars"))


@query("""SELECT concat('notes/', CAST(doc_id AS STRING)) AS path, factor, count(*) AS n FROM {documents}, (VALUES ('mom'), ('*')) v(factor) GROUP BY 1, 2""")
def s14_factor_links(f: Feeds) -> DataFrame:
    notes = f.documents.select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string")).alias("path"), F.lit("---\nfactors: [mom, '*']\ntype: research-finding\n---\nx").alias("text"))
    return documents.factor_links(documents.parse_notes(notes)).groupBy("path", "factor").agg(F.count("*").alias("n"))


@query("""SELECT ticker, period_end, min(filing_date) AS filing_date, arg_min(net_income, filing_date) FILTER (WHERE net_income IS NOT NULL) AS net_income,
  arg_min(equity, filing_date) FILTER (WHERE equity IS NOT NULL) AS equity, arg_min(eps, filing_date) FILTER (WHERE eps IS NOT NULL) AS eps FROM {fundamentals} GROUP BY 1, 2""")
def s15_earliest_facts(f: Feeds) -> DataFrame:
    long = f.fundamentals.unpivot(["ticker", "period_end", "filing_date"], ["net_income", "equity", "eps"], "concept", "value")
    return files.earliest_facts(long, {"net_income": ["net_income"], "equity": ["equity", "equity_with_minority"], "eps": ["eps"]})


@query("SELECT url, count(*) AS n FROM {pages} WHERE url NOT IN (SELECT url FROM {pages} WHERE page_id % 3 = 0) GROUP BY 1")
def s16_skip_known(f: Feeds) -> DataFrame:
    return upsert.skip_known(f.pages.select("url"), f.pages.filter("page_id % 3 = 0")).groupBy("url").agg(F.count("*").alias("n"))


@query("""SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) NOT IN (0, 6)
  AND CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM {orders} WHERE o_orderpriority = '1-URGENT')""")
def s17_missing_sessions(f: Feeds) -> DataFrame:
    return files.missing_sessions(day("1998-01-01"), day("1998-12-31"), f.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("date").alias("date")))


@query("""SELECT t.ticker, CASE WHEN a IS NULL OR a > DATE '1996-06-01' THEN 'full' WHEN date_diff('day', b, DATE '2001-12-01') > 40 THEN 'tail' ELSE 'covered' END AS plan
FROM (SELECT DISTINCT ticker FROM {prices}) t LEFT JOIN (SELECT ticker, min(date) AS a, max(date) AS b FROM {prices} WHERE substr(ticker, 6, 1) <> '7' GROUP BY 1) c ON t.ticker = c.ticker""")
def s18_fetch_plan(f: Feeds) -> DataFrame:
    cover = f.prices.filter("substr(ticker, 6, 1) <> '7'").groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("stop"))
    return files.fetch_plan(f.prices.select("ticker").distinct(), cover, day("1996-06-01"), day("2001-12-01"), 40)


@query("SELECT trade_id AS id, ticker, amount FROM {trades} WHERE trade_id % 3 <> 1")
def u1_insert_new(f: Feeds) -> DataFrame:
    rows = f.trades.select(F.col("trade_id").alias("id"), "ticker", "amount")
    stored, incoming = rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 1")
    return upsert.insert_new(stored, incoming.union(incoming))[0]


@query("SELECT substr(sha256(concat_ws('|', report_url, ticker, transaction_type, amount, CAST(transaction_date AS VARCHAR))), 1, 16) AS id, count(*) AS n FROM {trades} GROUP BY 1")
def u1_content_ids(f: Feeds) -> DataFrame:
    return f.trades.select(sc.content_id(*map(F.col, ("report_url", "ticker", "transaction_type", "amount", "transaction_date"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


_MOVES = """WITH filings AS (SELECT manager, filing_date, row_number() OVER (PARTITION BY manager ORDER BY filing_date) AS seq FROM (SELECT DISTINCT manager, filing_date FROM {holdings}) d),
h AS (SELECT h.*, seq FROM {holdings} h JOIN filings USING (manager, filing_date)),
moves AS (SELECT coalesce(n.manager, o.manager) AS manager, coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.seq, o.seq + 1) AS seq, n.shares AS s, o.shares AS p, n.value AS v
  FROM (SELECT * FROM h WHERE seq > 1) n FULL JOIN h o ON n.manager = o.manager AND n.ticker = o.ticker AND n.seq = o.seq + 1),
m AS (SELECT moves.manager, ticker, f.filing_date, CASE WHEN p IS NULL THEN 'NEW' WHEN s IS NULL THEN 'EXIT' WHEN s > p THEN 'ADD' WHEN s < p THEN 'TRIM' END AS action,
  coalesce(s, 0) AS shares, coalesce(p, 0) AS prev_shares, coalesce(v, 0) AS value, CASE WHEN p IS NULL THEN NULL WHEN s IS NULL THEN -1.0 ELSE s / p - 1 END AS pct_change FROM moves JOIN filings f ON moves.manager = f.manager AND moves.seq = f.seq)
"""


@query(_MOVES + "SELECT manager, ticker, filing_date, action, shares, prev_shares, value, round(pct_change, 6) AS pct_change FROM m WHERE action IS NOT NULL")
def a5_holding_moves(f: Feeds) -> DataFrame:
    return rounded(holding_moves(f.holdings))


@query("SELECT concat('F', CAST(l_suppkey % 20 AS STRING)) AS manager, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS filing_date, concat('T', CAST(l_partkey % 100 AS STRING)) AS ticker, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shares, max(l_returnflag) AS issuer FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY 1, 2, 3")
def a4_holdings_rollup(f: Feeds) -> DataFrame:
    lines = f.lineitem.select(F.concat(F.lit("F"), (F.col("l_suppkey") % 20).cast("string")).alias("manager"), F.trunc("l_shipdate", "quarter").alias("filing_date"), F.concat(F.lit("t"), (F.col("l_partkey") % 100).cast("string")).alias("ticker"),
                              F.when(F.col("l_linestatus") == "F", "Shares").otherwise("Put").alias("type"), F.col("l_quantity").cast("long").alias("shares"), F.col("l_quantity").cast("long").alias("value"), F.col("l_returnflag").alias("issuer"))
    return holdings_rollup(lines).drop("value")


@query("""WITH old AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'EXIT' ELSE 'ADD' END AS action, o_totalprice AS value, o_orderpriority AS note FROM {orders} WHERE o_orderkey % 2 = 0),
new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'EXIT' ELSE 'TRIM' END AS action, o_totalprice + 1 AS value, 'new' AS note FROM {orders} WHERE o_orderkey % 4 <> 2)
SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NULL OR (old.action = 'EXIT' AND new.action <> 'EXIT') THEN old.action ELSE new.action END AS action,
CASE WHEN new.id IS NULL OR (old.action = 'EXIT' AND new.action <> 'EXIT') THEN old.value ELSE new.value END AS value, CASE WHEN old.id IS NULL THEN new.note ELSE old.note END AS note FROM old FULL JOIN new ON old.id = new.id""")
def u2_terminal_upsert(f: Feeds) -> DataFrame:
    k = F.col("o_orderkey")
    old = f.orders.filter(k % 2 == 0).select(k.alias("id"), F.when(k % 3 == 0, "EXIT").otherwise("ADD").alias("action"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("note"))
    new = f.orders.filter(k % 4 != 2).select(k.alias("id"), F.when(k % 5 == 0, "EXIT").otherwise("TRIM").alias("action"), (F.col("o_totalprice") + 1).alias("value"), F.lit("new").alias("note"))
    return upsert.terminal_upsert(old, new, ["action", "value"])


@query("""WITH old AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS filing_date, o_totalprice AS fact FROM {orders} WHERE o_orderkey % 2 = 0),
new AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 2 AS INT) AS filing_date, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * 2 END AS fact FROM {orders} WHERE o_orderkey % 3 = 0)
SELECT coalesce(old.id, new.id) AS id, least(old.filing_date, new.filing_date) AS filing_date, coalesce(new.fact, old.fact) AS fact FROM old FULL JOIN new ON old.id = new.id""")
def u3_earliest_filing_upsert(f: Feeds) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    old = f.orders.filter(k % 2 == 0).select(k.alias("id"), d.alias("filing_date"), F.col("o_totalprice").alias("fact"))
    new = f.orders.filter(k % 3 == 0).select(k.alias("id"), F.date_add(d, (k % 5 - 2).cast("int")).alias("filing_date"), F.when(k % 7 != 0, F.col("o_totalprice") * 2).alias("fact"))
    return upsert.earliest_filing_upsert(old, new, ["id"], "filing_date", ["fact"])


@query("""WITH old AS (SELECT event_id AS id, event_type AS stance, CASE WHEN event_id % 4 = 0 THEN 'real' END AS verdict FROM {events} WHERE event_id % 2 = 0),
new AS (SELECT event_id AS id, 'positive' AS stance, CASE WHEN event_id % 5 = 0 THEN 'other' END AS verdict FROM {events} WHERE event_id % 3 = 0)
SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NOT NULL THEN new.stance ELSE old.stance END AS stance, coalesce(old.verdict, new.verdict) AS verdict FROM old FULL JOIN new ON old.id = new.id""")
def u4_keep_verdict_upsert(f: Feeds) -> DataFrame:
    k = F.col("event_id")
    old = f.events.filter(k % 2 == 0).select(k.alias("id"), F.col("event_type").alias("stance"), F.when(k % 4 == 0, "real").alias("verdict"))
    new = f.events.filter(k % 3 == 0).select(k.alias("id"), F.lit("positive").alias("stance"), F.when(k % 5 == 0, "other").alias("verdict"))
    return upsert.keep_verdict_upsert(old, new, ["id"], ["stance"], ["verdict"])


@query("SELECT ticker, date, CASE WHEN year(date) >= 1999 THEN volume * 2 ELSE volume END AS volume FROM {prices}")
def u5_replace_by_key(f: Feeds) -> DataFrame:
    rows = f.prices.select("ticker", "date", "volume")
    return upsert.replace_by_key(rows, rows.filter("year(date) >= 1999").withColumn("volume", F.col("volume") * 2), ["ticker", "date"])


@query("SELECT ticker, min(date) AS start, max(date) AS stop FROM {prices} GROUP BY 1")
def u6_widen_coverage(f: Feeds) -> DataFrame:
    cover = lambda rows: rows.groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("stop"))
    return upsert.widen_coverage(cover(f.prices.filter("year(date) < 1999")), cover(f.prices.filter("year(date) >= 1998")))


_TWICE = "(SELECT *, 0 AS k FROM {trades} UNION ALL SELECT trade_id, member, ticker, transaction_type, amount, transaction_date, disclosure_date + 3, concat(report_url, '/a'), chamber, amended, ticker_ok, 1 FROM {trades} WHERE trade_id % 4 = 0)"


def _with_amendments(f: Feeds) -> DataFrame:
    again = f.trades.filter("trade_id % 4 = 0").withColumn("disclosure_date", F.date_add("disclosure_date", 3)).withColumn("report_url", F.concat("report_url", F.lit("/a")))
    return f.trades.withColumn("k", F.lit(0)).union(again.withColumn("k", F.lit(1)))


@query(f"""SELECT trade_id, k, CASE WHEN row_number() OVER (PARTITION BY {', '.join(TRADE_KEY)} ORDER BY coalesce(disclosure_date, DATE '1900-01-01') DESC, report_url DESC, trade_id) > 1 THEN true END AS amended FROM {_TWICE} t
QUALIFY count(*) OVER (PARTITION BY {', '.join(TRADE_KEY)}, disclosure_date, report_url) = 1""")
def u7_mark_amended(f: Feeds) -> DataFrame:
    rows = _with_amendments(f)
    marked = upsert.mark_amended(rows, TRADE_KEY)
    same = F.count("*").over(Window.partitionBy(*TRADE_KEY, "disclosure_date", "report_url"))
    return marked.withColumn("_same", same).filter("_same = 1").select("trade_id", "k", "amended")


@query("SELECT p_partkey, regexp_full_match(upper(p_type), '[A-Z]{1,5}([./][A-Z]{1,2})?') AS ok FROM {part}")
def u8_symbol_quarantine(f: Feeds) -> DataFrame:
    return f.part.select("p_partkey", sc.valid_symbol(F.upper("p_type")).alias("ok"))


@query("""WITH o AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM {prices} WHERE year(date) >= 1998)
SELECT DISTINCT ticker FROM o WHERE n <= 10 AND CAST(substr(ticker, 2) AS INT) % 9 = 0""")
def u9_adjustment_drift(f: Feeds) -> DataFrame:
    new = f.prices.filter("year(date) >= 1998").withColumn("close", F.when(F.substring("ticker", 2, 5).cast("int") % 9 == 0, F.col("close") * 1.02).otherwise(F.col("close")))
    return upsert.adjustment_drift(f.prices, new)


@query("SELECT p_name, p_brand, count(*) AS n FROM (SELECT p_name, p_brand FROM {part} WHERE NOT starts_with(p_brand, 'Brand#1') UNION ALL SELECT 'new', p_brand FROM {part} WHERE starts_with(p_brand, 'Brand#1')) x GROUP BY 1, 2")
def u10_replace_prefix(f: Feeds) -> DataFrame:
    rows = f.part.select("p_name", "p_brand")
    new = rows.filter(F.col("p_brand").startswith("Brand#1")).withColumn("p_name", F.lit("new"))
    return upsert.replace_prefix(rows, new, "p_brand", "Brand#1").groupBy("p_name", "p_brand").agg(F.count("*").alias("n"))


@query("SELECT thesis_id, concat_ws(',', CASE WHEN conviction > 4 THEN 'conviction' END, CASE WHEN status NOT IN ('open', 'right', 'wrong') THEN 'status' END) AS violations FROM {forecasts}")
def u11_validate(f: Feeds) -> DataFrame:
    rules = {"conviction": F.col("conviction").between(1, 4), "status": F.col("status").isin("open", "right", "wrong")}
    return upsert.validate(f.forecasts, rules).select("thesis_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT thesis_id, CASE WHEN status IN ('open', 'pending') THEN CASE WHEN opened + 2 > DATE '2024-05-01' THEN 'pending' ELSE 'open' END ELSE status END AS status FROM {forecasts}")
def u12_cooling_off(f: Feeds) -> DataFrame:
    return upsert.cooling_off(f.forecasts.withColumn("activate_at", F.date_add("opened", 2)), day("2024-05-01")).select("thesis_id", "status")


@query(f"SELECT trade_id, CAST({_MID} AS DOUBLE) AS mid, {_SIGN} AS sign, CASE WHEN transaction_type = 'Sale (Full)' THEN -1 ELSE 0 END AS sign_english, {_SIGN} AS sign_profile, coalesce(disclosure_date, transaction_date) AS known, date_diff('day', transaction_date, disclosure_date) AS lag FROM {{trades}}")
def p1_p2_p4_p5_trade_columns(f: Feeds) -> DataFrame:
    kind = F.col("transaction_type")
    return f.trades.select("trade_id", sc.amount_midpoint(F.col("amount")).alias("mid"), sc.trade_sign(kind).alias("sign"), sc.trade_sign(kind, "english").alias("sign_english"), sc.trade_sign(kind, "profile").alias("sign_profile"),
                           sc.known_on(F.col("disclosure_date"), F.col("transaction_date")).alias("known"), F.datediff("disclosure_date", "transaction_date").cast("long").alias("lag"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM {orders}")
def p3_two_date_formats(f: Feeds) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return f.orders.select("o_orderkey", sc.day_of(text, "MM/dd/yyyy", "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '#')) AS person, c_name AS company FROM {customer}")
def p6_p7_names(f: Feeds) -> DataFrame:
    person = F.concat(F.lit("Hon. "), "c_name", F.lit(", Jr."))
    return f.customer.select("c_custkey", sc.person_key(person).alias("person"), sc.company_key(F.concat("c_name", F.lit(", Inc."))).alias("company"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END AS stance, round(pow(0.5, value / 90), 6) AS decay, round(CASE WHEN value - 5 <> 0 THEN value / (value - 5) END, 4) AS ratio FROM {events}")
def p8_p9_p10_stance_decay_ratio(f: Feeds) -> DataFrame:
    word = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative")
    return f.events.select("event_id", sc.stance_sign(word).alias("stance"), F.round(sc.half_life_decay(F.col("value"), 90), 6).alias("decay"), F.round(sc.safe_ratio(F.col("value"), F.col("value") - 5), 4).alias("ratio"))


@query("""SELECT event_id, CASE WHEN z >= 1.0 THEN 5 WHEN z >= 0.6 THEN 4 WHEN z >= 0.2 THEN 3 WHEN z >= -0.2 THEN 2 ELSE 1 END AS conviction, CASE WHEN z >= 0.5 THEN 'bull' WHEN z <= -0.5 THEN 'risk' END AS side,
CASE WHEN value < 30 THEN 'oversold' WHEN value < 40 THEN 'weak' WHEN value < 60 THEN 'neutral' WHEN value < 70 THEN 'strong' ELSE 'overbought' END AS rsi_band, CASE WHEN abs(z) >= 3 THEN 'strong' WHEN abs(z) >= 2 THEN 'suggestive' ELSE 'none' END AS verdict
FROM (SELECT event_id, value, (value - 20) / 10 AS z FROM {events}) e""")
def p11_p12_p15_bands(f: Feeds) -> DataFrame:
    z = (F.col("value") - 20) / 10
    bands = sc.band(F.col("value"), (30, 40, 60, 70), ("oversold", "weak", "neutral", "strong", "overbought"))
    return f.events.select("event_id", sc.conviction(z).alias("conviction"), sc.case_side(z).alias("side"), bands.alias("rsi_band"), sc.verdict(z).alias("verdict"))


@query("""SELECT thesis_id, CAST(conviction AS DOUBLE) / 5 * 40 + CASE conviction % 3 WHEN 0 THEN 25 WHEN 1 THEN 15 ELSE 5 END + CASE WHEN conviction > 3 THEN 20 ELSE 5 END + 5 AS score FROM {forecasts}""")
def p13_attention_score(f: Feeds) -> DataFrame:
    c = F.col("conviction")
    zone = F.when(c % 3 == 0, "deep").when(c % 3 == 1, "fair").otherwise("rich")
    none = F.lit(None).cast("string")
    return f.forecasts.select("thesis_id", sc.attention(c, zone, F.when(c > 3, "strong").otherwise("flat"), F.col("author"), F.lit(""), none).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '5d' WHEN event_id % 3 = 1 THEN '1d' ELSE '20d' END AS horizon, value AS reaction FROM {events}")
def p16_headline_reaction(f: Feeds) -> DataFrame:
    at = lambda k: F.when(F.col("event_id") % 3 == k, F.col("value"))
    return f.events.withColumn("h", sc.headline_reaction(at(0), at(1), at(2))).select("event_id", "h.horizon", "h.reaction")


@query(f"""SELECT chamber, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS excess, CAST(sum(greatest(0, n - 1 - marked)) AS BIGINT) AS unmarked, CAST(sum(marked) AS BIGINT) AS marked FROM (
SELECT {', '.join(TRADE_KEY)}, count(*) AS n, count(DISTINCT report_url) AS urls, count(*) FILTER (WHERE amended) AS marked FROM {_TWICE} t GROUP BY {', '.join(TRADE_KEY)} HAVING count(DISTINCT report_url) > 1) g GROUP BY 1""")
def a10_duplicate_groups(f: Feeds) -> DataFrame:
    return audit.duplicate_groups(_with_amendments(f), TRADE_KEY)


@query("""SELECT count(DISTINCT CASE WHEN NOT good THEN ticker END) AS bad_distinct, count(*) FILTER (WHERE NOT good) AS bad_rows, count(*) FILTER (WHERE good AND ticker NOT IN (SELECT DISTINCT upper(substr(p_type, 1, 4)) FROM {part} WHERE p_partkey % 2 = 0)) AS outside_rows
FROM (SELECT ticker, regexp_full_match(ticker, '[A-Z]{1,5}([./][A-Z]{1,2})?') AS good FROM (SELECT CASE WHEN p_size % 4 = 0 THEN p_brand ELSE upper(substr(p_type, 1, 4)) END AS ticker FROM {part}) p) g""")
def a11_bad_symbols(f: Feeds) -> DataFrame:
    rows = f.part.select(F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).otherwise(F.upper(F.substring("p_type", 1, 4))).alias("ticker"))
    return audit.bad_symbols(rows, f.part.filter("p_partkey % 2 = 0").select(F.upper(F.substring("p_type", 1, 4)).alias("ticker")))


@query("SELECT l_returnflag AS value, count(*) AS n FROM {lineitem} GROUP BY 1")
def a12_value_counts(f: Feeds) -> DataFrame:
    return audit.value_counts(f.lineitem, "l_returnflag")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE disclosure_date IS NULL) AS null_disclosure_date, count(*) FILTER (WHERE amended IS NULL) AS null_amended, count(*) FILTER (WHERE ticker_ok IS NULL) AS null_ticker_ok FROM {trades}")
def a12_null_counts(f: Feeds) -> DataFrame:
    return audit.null_counts(f.trades, ["disclosure_date", "amended", "ticker_ok"])


@query("SELECT manager, filing_date, ticker, CAST(rank AS INT) AS rank FROM (SELECT manager, filing_date, ticker, row_number() OVER (PARTITION BY manager, filing_date ORDER BY value DESC, ticker) AS rank FROM {holdings}) h WHERE rank > 30")
def a12_ranked_beyond(f: Feeds) -> DataFrame:
    ranked = f.holdings.withColumn("rank", F.row_number().over(Window.partitionBy("manager", "filing_date").orderBy(F.desc("value"), "ticker")))
    return audit.ranked_beyond(ranked, "rank").select("manager", "filing_date", "ticker", "rank")


_KINDS = ("P", "p ", "Purchase", "S (partial)", "Sale (Full)", "s", "SELL", "Exchange", "E", "")


@query(f"""SELECT trade_id, kind, CASE WHEN contains(lower(kind), 'purchase') THEN 1 WHEN contains(lower(kind), 'sale') THEN -1 ELSE 0 END AS english,
CASE WHEN contains(lower(kind), 'purchase') OR trim(lower(kind)) = 'p' THEN 1 WHEN contains(lower(kind), 'sale') OR contains(lower(kind), 'sell') OR trim(lower(kind)) = 's' OR starts_with(lower(kind), 's (') THEN -1 ELSE 0 END AS profile
FROM (SELECT trade_id, {list(_KINDS)}[1 + trade_id % {len(_KINDS)}] AS kind FROM {{trades}}) t""")
def p2b_p2c_sign_dialects(f: Feeds) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("trade_id") % len(_KINDS) + 1).cast("int"))
    rows = f.trades.select("trade_id", kind.alias("kind"))
    return rows.select("trade_id", "kind", sc.trade_sign(F.col("kind"), "english").alias("english"), sc.trade_sign(F.col("kind"), "profile").alias("profile"))


_NAMED = {"z": "(value - 20) / 10", "rsi": "value", "pe": "value - 5", "range_pct": "(value - 1) / 300 * 100", "market_cap": "value * value * 100000000", "composite": "(value - 20) / 20"}


def _bands(metric: str, value: str) -> str:
    over = ">" if metric == "pe" else ">="
    return f"CASE WHEN {value} IS NOT NULL{f' AND {value} > 0' if metric == 'pe' else ''} THEN {' + '.join(f'CAST({value} {over} {float(c)!r} AS INT)' for c in sc.METRIC_CUTS[metric])} END AS {metric}"


@query(f"SELECT event_id, {', '.join(_bands(m, v) for m, v in _NAMED.items())} FROM {{events}}")
def p12_metric_bands(f: Feeds) -> DataFrame:
    return f.events.select("event_id", *(sc.metric_band(m, sc.range_place(F.col("value"), F.lit(1.0), F.lit(301.0)) if m == "range_pct" else F.expr(v)).alias(m) for m, v in _NAMED.items()))


@query("""SELECT c_custkey, lower(c_mktsegment) || ' ' || lower(c_name) AS person, c_name || CASE WHEN c_custkey % 4 = 3 THEN ' Group' ELSE '' END AS company FROM {customer}""")
def p6_p7_name_forms(f: Feeds) -> DataFrame:
    """Titles, suffixes and legal forms of several kinds around the same names; a group stays a group."""
    pick = lambda *forms: F.element_at(F.array(*map(F.lit, forms)), (F.col("c_custkey") % len(forms) + 1).cast("int"))
    person = F.concat(pick("Sen. ", "Dr ", "", "Mrs. ", "HON. "), "c_mktsegment", pick(" ", "  "), "c_name", pick("", " V", ", Sr.", " III", " II"))
    company = F.concat("c_name", pick(" Ltd.", ", Incorporated", " N.V.", " Group", " PLC", " Technologies", " Companies", " Group"))
    company = F.when(F.col("c_custkey") % 4 == 3, F.concat("c_name", F.lit(" Group"))).otherwise(F.regexp_replace(company, " Group$", " Co"))
    return f.customer.select("c_custkey", sc.person_key(person).alias("person"), sc.company_key(company).alias("company"))
