"""Queries on dashboards, list views, text, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import person_key
from tidemark.operators import audit, dashboards, screens, text
from tidemark.operators import events as ev
from tidemark.plans.registry import day, query, rounded
from tidemark.sources import documents, files
from tidemark.standins import Feeds
from tidemark.storage import fresh_path
from tidemark.streaming import feeds

_MID = "CASE amount WHEN '$15,001 - $50,000' THEN 32500.5 WHEN '$50,001 - $100,000' THEN 75000.5 WHEN '$100,001 - $250,000' THEN 175000.5 WHEN '$250,000' THEN 250000.0 ELSE 0.0 END"
_SIDED = f"sided AS (SELECT *, sign = 1 AS b, sign = -1 AS s, CASE WHEN sign = 1 THEN mid ELSE 0 END AS buy, CASE WHEN sign = -1 THEN mid ELSE 0 END AS sell, date_diff('day', transaction_date, disclosure_date) AS lag FROM (SELECT *, CAST({_MID} AS DOUBLE) AS mid, CASE WHEN transaction_type = 'P' THEN 1 WHEN transaction_type = 'Sale (Full)' THEN -1 ELSE 0 END AS sign FROM {{trades}}) t)"
_SIDES = "count(*) FILTER (WHERE b) AS n_buys, count(*) FILTER (WHERE s) AS n_sells, sum(buy) AS bought, sum(sell) AS sold"


def _sided(f: Feeds) -> DataFrame:
    return dashboards.sided(f.trades, "full")


@query(f"WITH {_SIDED} SELECT count(*) AS n, count(DISTINCT member) AS members, count(DISTINCT ticker) AS tickers, {_SIDES} FROM sided")
def a6_totals(f: Feeds) -> DataFrame:
    return dashboards.totals(_sided(f))


@query(f"WITH {_SIDED} SELECT strftime(coalesce(disclosure_date, transaction_date), '%Y-%m') AS month, count(*) AS n, {_SIDES} FROM sided GROUP BY 1")
def a6_by_month(f: Feeds) -> DataFrame:
    return dashboards.by_month(_sided(f))


@query(f"WITH {_SIDED} SELECT ticker, count(*) AS n, sum(buy) - sum(sell) AS net, max(transaction_date) AS last_date, {_SIDES} FROM sided GROUP BY 1 ORDER BY abs(sum(buy) - sum(sell)) DESC, ticker LIMIT 25")
def a6_top_tickers(f: Feeds) -> DataFrame:
    return dashboards.top_tickers(_sided(f))


@query(f"WITH {_SIDED} SELECT member, count(*) AS n, {_SIDES} FROM sided GROUP BY 1 ORDER BY n DESC, member LIMIT 15")
def a6_top_members(f: Feeds) -> DataFrame:
    return dashboards.top_members(_sided(f))


@query(f"WITH {_SIDED} SELECT CASE WHEN lag <= 30 THEN '0-30' WHEN lag <= 45 THEN '31-45' WHEN lag <= 90 THEN '46-90' ELSE '90+' END AS band, count(*) AS n FROM sided WHERE lag >= 0 GROUP BY 1")
def a6_lag_histogram(f: Feeds) -> DataFrame:
    return dashboards.lag_histogram(_sided(f))


@query(f"WITH {_SIDED} SELECT list_sort(list(lag))[CAST(floor(count(lag) / 2) AS BIGINT) + 1] AS median FROM sided WHERE lag IS NOT NULL")
def a6_upper_median_lag(f: Feeds) -> DataFrame:
    return dashboards.upper_median(_sided(f), "lag").select(F.col("median").cast("long").alias("median"))


@query(f"WITH {_SIDED} SELECT member, count(*) AS n, count(DISTINCT ticker) AS tickers, {_SIDES}, round(avg(CASE WHEN lag BETWEEN 0 AND 365 THEN lag END), 6) AS mean_lag, max(transaction_date) AS last_date FROM sided GROUP BY 1")
def a7_member_profile(f: Feeds) -> DataFrame:
    return rounded(dashboards.member_profile(_sided(f)))


@query(f"WITH {_SIDED} SELECT member, ticker, count(*) AS n, sum(buy) - sum(sell) AS net, max(transaction_date) AS last_date, {_SIDES}, CAST(row_number() OVER (PARTITION BY member ORDER BY abs(sum(buy) - sum(sell)) DESC, ticker) AS INT) AS place FROM sided GROUP BY 1, 2 QUALIFY place <= 20")
def a7_a9_member_tickers(f: Feeds) -> DataFrame:
    return dashboards.top_tickers(_sided(f), 20, member=True)


def _moves(f: Feeds) -> DataFrame:
    return f.holdings.select("manager", "ticker", "value", F.when(F.col("shares") < 60, "NEW").otherwise("ADD").alias("action"))


_MOVES = "moves AS (SELECT manager, ticker, value, CASE WHEN shares < 60 THEN 'NEW' ELSE 'ADD' END AS action FROM {holdings})"


@query(f"WITH {_MOVES} SELECT ticker, count(DISTINCT manager) AS managers, round(sum(value), 2) AS value, count(*) AS n, max(CASE WHEN action = 'NEW' THEN 1 ELSE 0 END) AS has_new FROM moves GROUP BY 1")
def a8_managers_by_ticker(f: Feeds) -> DataFrame:
    return rounded(dashboards.managers_by_ticker(_moves(f)), 2)


@query(f"WITH {_MOVES} SELECT manager, round(sum(value), 2) AS value, count(*) FILTER (WHERE action = 'NEW') AS n_new, count(*) FILTER (WHERE action <> 'NEW') AS n_other FROM moves GROUP BY 1")
def a8_tickers_by_manager(f: Feeds) -> DataFrame:
    return rounded(dashboards.tickers_by_manager(_moves(f)), 2)


@query(f"WITH {_MOVES} SELECT ticker, count(DISTINCT manager) AS managers FROM moves GROUP BY 1 ORDER BY managers DESC, sum(value) DESC, ticker LIMIT 10")
def a8_crowded(f: Feeds) -> DataFrame:
    return dashboards.crowded(_moves(f)).select("ticker", "managers")


@query(f"WITH {_SIDED} SELECT 'congress' AS source, count(*) AS stored, count(*) FILTER (WHERE amended IS NOT TRUE AND ticker_ok IS NOT FALSE AND sign <> 0 AND mid > 0) AS events, round(count(*) FILTER (WHERE amended IS NOT TRUE AND ticker_ok IS NOT FALSE AND sign <> 0 AND mid > 0) / count(*), 6) AS yield FROM sided UNION ALL SELECT 'activism', count(*), count(*), 1.0 FROM {{stakes}}")
def a13_event_yield(f: Feeds) -> DataFrame:
    return rounded(audit.event_yield({"congress": (f.trades, ev.congress_events(f.trades)), "activism": (f.stakes, ev.activism_events(f.stakes))}))


@query("""SELECT source, max(ran_at) AS last_run, arg_max(ok, ran_at) AS last_ok, max(ran_at) FILTER (WHERE ok) AS last_good, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ran_at) FILTER (WHERE ok))) AS BIGINT) AS age_s,
coalesce(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ran_at) FILTER (WHERE ok))) > CASE source WHEN 'view' THEN 3600 ELSE 172800 END, true) AS stale FROM {runs} GROUP BY 1""")
def a14_j2_freshness(f: Feeds) -> DataFrame:
    runs = f.runs.withColumn("ran_at", F.col("ran_at").cast("timestamp"))
    return dashboards.freshness(runs, {"view": 3600}, F.lit("2024-02-01").cast("timestamp"), 172_800)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE value >= 0.5) AS strong, count(*) FILTER (WHERE value >= 0.2 AND value < 0.5) AS buy, round(avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM {events}")
def a15_forecast_kpis(f: Feeds) -> DataFrame:
    return rounded(dashboards.forecast_kpis(f.events.select(F.col("value").alias("composite"), (F.col("value") > 40).cast("double").alias("hit"))))


@query("SELECT DISTINCT author AS ticker FROM {forecasts} WHERE status = 'open' AND conviction >= 4 UNION SELECT DISTINCT concat('c', CAST(conviction AS STRING)) FROM {forecasts} WHERE status = 'open' AND conviction >= 4")
def a15b_active_tickers(f: Feeds) -> DataFrame:
    rows = f.forecasts.withColumn("tickers", F.array("author", F.concat(F.lit("c"), F.col("conviction").cast("string"))))
    return dashboards.active_tickers(rows, ("open",), 4)


@query("SELECT ticker, round(close, 6) AS close FROM {prices} WHERE date = (SELECT max(date) FROM {prices})")
def a17_latest_snapshot(f: Feeds) -> DataFrame:
    return screens.latest_snapshot(f.prices, "date").select("ticker", F.round("close", 6).alias("close"))


@query("SELECT trade_id, ticker FROM {trades} WHERE chamber = 'house' AND ticker IN ('T00001', 'T00002', 'T00003') AND transaction_date >= DATE '1997-01-01' ORDER BY coalesce(disclosure_date, transaction_date) DESC, trade_id LIMIT 50")
def t3_t4_latest_trades(f: Feeds) -> DataFrame:
    order = [F.desc(F.coalesce("disclosure_date", "transaction_date")), F.asc("trade_id")]
    return screens.latest_rows(f.trades, {"chamber": "house", "ticker": ["T00001", "T00002", "T00003"], "member": None}, order, 50, ("transaction_date", day("1997-01-01"))).select("trade_id", "ticker")


@query("SELECT ticker, trade_id, CAST(row_number() OVER (PARTITION BY ticker ORDER BY transaction_date DESC, trade_id) AS INT) AS place FROM {trades} QUALIFY place <= 10")
def q1_latest_per_ticker(f: Feeds) -> DataFrame:
    return screens.latest_per_entity(f.trades, "ticker", [F.desc("transaction_date"), F.asc("trade_id")]).select("ticker", "trade_id", "place")


_CONTEXT = {"trades": ("{trades}", "transaction_date", "trade_id"), "prices": ("{prices}", "date", "date"), "shorts": ("{shorts}", "date", "date"), "facts": ("{facts}", "filing_date", "period_end")}


@query("SELECT source, ticker, day, row_id, CAST(row_number() OVER (PARTITION BY source, ticker ORDER BY day DESC NULLS LAST, row_id) AS INT) AS place FROM ("
       + " UNION ALL ".join(f"SELECT '{k}' AS source, ticker, {d} AS day, CAST({i} AS VARCHAR) AS row_id FROM {t}" for k, (t, d, i) in _CONTEXT.items()) + ") u QUALIFY place <= 10")
def q1_ticker_context(f: Feeds) -> DataFrame:
    return screens.context({k: (getattr(f, t.strip("{}")), d, i) for k, (t, d, i) in _CONTEXT.items()})


@query("SELECT p_partkey FROM {part} WHERE contains(lower(p_name), 'red') AND p_size >= 20")
def p14_screen_filter(f: Feeds) -> DataFrame:
    return screens.contains_filter(f.part, "RED", "p_name", {"p_size": 20}).select("p_partkey")


@query("SELECT DISTINCT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE (SELECT min(c_custkey) FROM {customer} WHERE c_custkey % 2 = 0) END AS person_id FROM {customer}")
def j13_resolve_people(f: Feeds) -> DataFrame:
    names = f.customer.select(F.col("c_name").alias("name"))
    roster = f.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("person_id"), F.concat("c_name", F.lit(" person")).alias("full"))
    return dashboards.resolve_people(names, roster, person_key(F.concat(F.lit("Sen. "), "name", F.lit(" Person"))), person_key(F.col("full")))


@query("SELECT member, CASE WHEN member IN (SELECT concat('M', CAST(c_custkey AS STRING)) FROM {customer} WHERE c_mktsegment = 'MACHINERY') THEN 2.0 ELSE 1.0 END AS weight, count(*) AS n FROM {trades} GROUP BY 1, 2")
def j14_committee_weight(f: Feeds) -> DataFrame:
    high = f.customer.filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("member"))
    return dashboards.committee_weight(f.trades.select("member"), high, "member").groupBy("member", "weight").agg(F.count("*").alias("n"))


_CHUNKS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM {documents}),
c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 50, 1), 350)) AS s FROM w WHERE len(w) > 0)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(s / 350 AS INT) AS idx, substr(sha256(concat_ws('#', CAST(doc_id AS VARCHAR), CAST(CAST(s / 350 AS INT) AS VARCHAR))), 1, 16) AS id, md5(array_to_string(w[s + 1 : s + 400], ' ')) AS digest FROM c")
def r1_chunks(f: Feeds) -> DataFrame:
    return text.chunks(f.documents, path="doc_id").select("doc_id", "idx", "id", F.md5("chunk").alias("digest"))


@query("SELECT doc_id FROM {documents} WHERE lang IN ('en', 'de') OR source = 'src3'")
def r2_tagged(f: Feeds) -> DataFrame:
    return text.tagged(f.documents.withColumn("tags", F.array("lang", "source")), ["en", "de", "src3"]).select("doc_id")


@query(f"""WITH {_CHUNKS}, h AS (SELECT doc_id, idx, md5(lower(unnest(l))) AS h FROM (SELECT doc_id, CAST(s / 350 AS INT) AS idx, w[s + 1 : s + 400] AS l FROM c) x),
v AS (SELECT doc_id, idx, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 384 AS place, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS x FROM h GROUP BY 1, 2, 3)
SELECT doc_id AS path, idx, 384 AS dimension, CAST(max(abs(x)) > 0 AS INT)::DOUBLE AS norm, CAST(count(*) FILTER (WHERE x > 0) AS INT) AS positive, CAST(count(*) FILTER (WHERE x < 0) AS INT) AS negative,
CAST(CASE WHEN max(abs(x)) > 0 THEN arg_max(place, 1000 * abs(x) - place) ELSE 0 END AS INT) AS strongest FROM v GROUP BY 1, 2""")
def r3_embeddings(f: Feeds) -> DataFrame:
    out = text.embed(text.chunks(f.documents.select(F.col("doc_id").alias("path"), "text")))
    size = F.transform("embedding", F.abs)
    some = lambda keep: F.size(F.filter("embedding", keep))
    return out.select(
        "path", "idx", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"),
        some(lambda x: x > 0).alias("positive"), some(lambda x: x < 0).alias("negative"), (F.array_position(size, F.array_max(size)) - 1).cast("int").alias("strongest"),
    )


_TOPK = "s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM {embeddings} q, {embeddings} e WHERE q.vec_id % 50 = 0)"


@query(f"WITH {_TOPK} SELECT query_id, id, round(sim, 5) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, id) AS INT) AS place FROM s QUALIFY place <= 10")
def r4_cosine_top_k(f: Feeds) -> DataFrame:
    corpus = f.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return rounded(text.top_k(corpus, corpus.filter("id % 50 = 0"), 10), 5)


@query(f"WITH {_TOPK}, t AS (SELECT query_id, id, round(sim, 12) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, id) <= 25), b AS (SELECT query_id, t.id, sim, label FROM t JOIN {{embeddings}} e ON e.vec_id = t.id QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, t.id) = 1) SELECT query_id, id, label AS note, round(sim, 5) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, label) AS INT) AS place FROM b QUALIFY place <= 5")
def r4_best_per_note(f: Feeds) -> DataFrame:
    corpus = f.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    hits = text.top_k(corpus, corpus.filter("id % 50 = 0"), 25)
    return rounded(text.best_per_note(hits, f.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("note")), 5), 5)


@query("SELECT title, factor FROM (SELECT p_name AS title, CASE WHEN p_size % 5 = 0 THEN '*' WHEN p_size % 5 = 1 THEN 'mom' ELSE 'value' END AS factor FROM {part}) x WHERE factor IN ('mom', '*')")
def r5_evidence(f: Feeds) -> DataFrame:
    k = F.col("p_size") % 5
    links = f.part.select(F.col("p_name").alias("title"), F.when(k == 0, "*").when(k == 1, "mom").otherwise("value").alias("factor"), F.lit("research-finding").alias("type"), F.col("p_brand").alias("verdict"))
    return text.evidence_for(links, "mom").select("title", "factor")


_COMMON = ", ".join(f"'{w}'" for w in text.COMMON_WORDS)


@query(rf"""WITH named AS (SELECT CASE WHEN item_id % 7 = 3 THEN 'WM' ELSE 'B' || item_id END AS ticker, lower(CASE WHEN item_id % 5 = 0 THEN w[1] ELSE array_to_string(w[1 : 2 + CAST(item_id % 5 AS INT)], ' ') END) AS core FROM (SELECT item_id, string_split(text, ' ') AS w FROM {{benchmark}}) b),
keys AS (SELECT DISTINCT ticker, core FROM (SELECT ticker, regexp_replace(regexp_replace(core, '^[\s,.&]+|[\s,.&]+$', '', 'g'), '[\s,]+', ' ', 'g') AS core FROM named WHERE ticker <> 'WM') k WHERE contains(core, ' ') OR (length(core) >= 4 AND core NOT IN ({_COMMON}))),
sentences AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS sentence_ix, unnest(l) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS l FROM {{documents}}) d),
near AS MATERIALIZED (SELECT doc_id, ticker, sentence_ix, sentence, core FROM sentences JOIN keys ON contains(lower(sentence), core)),
said AS (SELECT doc_id, ticker, min(sentence_ix) AS sentence_ix FROM near WHERE regexp_matches(lower(sentence), '(^|[^\p{{L}}\p{{N}}_])\Q' || core || '\E($|[^\p{{L}}\p{{N}}_])') GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY doc_id) <= 8)
SELECT doc_id, ticker, sentence_ix, CASE WHEN regexp_matches(substr(sentence, 1, 280), '{text.NEGATIVE_CUES}') THEN 'negative' ELSE 'positive' END AS stance FROM said JOIN sentences USING (doc_id, sentence_ix) WHERE NOT regexp_matches(substr(sentence, 1, 280), '{"|".join(text.MENU_TEXTS)}')""")
def r6_mentions(f: Feeds) -> DataFrame:
    """Companies named by the first one to six words of each benchmark item, with legal suffixes of several kinds."""
    w, k = F.split("text", " "), F.col("item_id") % 5
    core = F.when(k == 0, F.element_at(w, 1)).otherwise(F.array_join(F.slice(w, F.lit(1), (k + 2).cast("int")), " "))
    suffix = F.element_at(F.array(*map(F.lit, ("", ", Inc.", " Corp", " PLC"))), (F.col("item_id") % 4 + 1).cast("int"))
    ticker = F.when(F.col("item_id") % 7 == 3, "WM").otherwise(F.concat(F.lit("B"), F.col("item_id").cast("string")))
    return text.mentions(f.documents, f.benchmark.select(F.concat(core, suffix).alias("name"), ticker.alias("ticker"))).select("doc_id", "ticker", "sentence_ix", "stance")


@query("SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS place, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*href=\"([^\"]*)\"[^>]*>', 1) AS l FROM {pages}) x")
def s8_page_links(f: Feeds) -> DataFrame:
    return documents.links_of(f.pages)


def _scratch(f: Feeds) -> str:
    return fresh_path(f.spark, "query")


@query("SELECT o_orderkey, c_mktsegment FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
def k1_k2_snapshot_and_replace(f: Feeds) -> DataFrame:
    folder = _scratch(f)
    tables = {"orders": f.orders.select("o_orderkey", "o_custkey"), "customer": f.customer.select("c_custkey", "c_mktsegment")}
    places = files.snapshot(tables, f"{folder}/snapshot", "2024-01-01T00-00-00")
    back = f.spark.read.parquet(places["orders"]).join(f.spark.read.parquet(places["customer"]), F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_mktsegment")
    files.replace_table(back.limit(1), f"{folder}/result")
    files.replace_table(back, f"{folder}/result")
    files.replace_table(back.filter("false"), f"{folder}/result")  # refused: an empty result leaves the table
    return f.spark.read.parquet(f"{folder}/result")


@query("SELECT c_name AS Last, CAST(make_date(2024, 1, CAST(1 + c_custkey % 28 AS INT)) AS DATE) AS filing_date FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_custkey % 28 < 20")
def s9_filing_index(f: Feeds) -> DataFrame:
    """A member of an index is a customer; an index, in a file of its own, has a thousand."""
    folder = _scratch(f)
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "P").otherwise("C")
    day_ = (F.col("c_custkey") % 28 + 1).cast("string")
    body = F.concat(F.lit("<Member><Last>"), "c_name", F.lit("</Last><First>x</First><FilingType>"), kind, F.lit("</FilingType><FilingDate>1/"), day_, F.lit("/2024</FilingDate><DocID>1</DocID></Member>"))
    part = F.floor(F.col("c_custkey") / 1000)
    members = f.customer.groupBy(part.alias("part")).agg(F.array_join(F.collect_list(body), "").alias("m"))
    members.select("part", F.concat(F.lit("<Members>"), "m", F.lit("</Members>")).alias("value")).write.partitionBy("part").text(f"{folder}/index")
    index = documents.filing_index(f.spark, f"{folder}/index")
    return documents.filings_between(index, day("2024-01-01"), day("2024-01-20")).select("Last", "filing_date")


@query("SELECT ticker, sector FROM {sectors}")
def s3_sector_file(f: Feeds) -> DataFrame:
    """The map read back from files of commented lines under a header."""
    folder = _scratch(f)
    line = F.concat_ws(",", "ticker", "sector")
    head = f.spark.createDataFrame([("# sectors, current only",), ("ticker,sector",)], "value string")
    head.coalesce(1).write.text(f"{folder}/head")
    f.sectors.select(line.alias("value")).write.text(f"{folder}/lines")
    return files.read_sectors(f.spark, f"{folder}/head").union(files.read_sectors(f.spark, f"{folder}/lines", header=False))


@query("SELECT date, ticker, short_volume, total_volume FROM {shorts}")
def st1_short_volume_stream(f: Feeds) -> DataFrame:
    folder = _scratch(f)
    lines = F.concat_ws("|", F.date_format("date", "yyyyMMdd"), "ticker", F.col("short_volume").cast("string"), F.lit("0"), F.col("total_volume").cast("string"), F.lit("N"))
    f.shorts.select(lines.alias("value")).write.text(f"{folder}/in")
    table = feeds.PartTable(f.spark, f"{folder}/table", feeds.SHORT_SCHEMA, feeds.SHORT_PART)
    seen = feeds.PartTable(f.spark, f"{folder}/seen", feeds.COVERAGE_SCHEMA, feeds.COVERAGE_PART)
    for run in range(2):  # the second run sees the same files through a new checkpoint and changes nothing
        feeds.stream_short_volume(f.spark, f"{folder}/in", table, seen, f"{folder}/cp{run}").awaitTermination()
    return table.read()


_DISCLOSURE = "id long, member string, year int, disclosure_date date, report_url string"


@query("""SELECT id, row_number() OVER (PARTITION BY member, year(transaction_date) ORDER BY coalesce(disclosure_date, DATE '1900-01-01') DESC, report_url DESC) > 1 AS amended FROM (SELECT trade_id AS id, member, transaction_date, disclosure_date, concat(report_url, CAST(trade_id AS STRING)) AS report_url FROM {trades}) t""")
def st2_disclosure_stream(f: Feeds) -> DataFrame:
    """A report on a year replaces a member's earlier ones. Later disclosures come first; a restart from the checkpoint then meets all rows: late ones, and ids that it knows."""
    folder = _scratch(f)
    rows = f.trades.select(F.col("trade_id").alias("id"), "member", F.year("transaction_date").alias("year"), "disclosure_date", F.concat("report_url", F.col("trade_id").cast("string")).alias("report_url"))
    for drop in (rows.filter("disclosure_date >= DATE '1998-05-01'"), rows):
        drop.write.mode("append").json(f"{folder}/in")
        feeds.stream_disclosures(f.spark, f"{folder}/in", _DISCLOSURE, f"{folder}/changes", ["member", "year"], f"{folder}/cp").awaitTermination()
    return feeds.disclosures(f.spark, _DISCLOSURE, f"{folder}/changes").select("id", F.coalesce("amended", F.lit(False)).alias("amended"))
