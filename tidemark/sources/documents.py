"""Feeds that come as documents: HTML tables and text, XML indexes, RSS items, extracted cells, and notes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import content_id, day_of

# Cells that stand for no symbol.
NO_SYMBOL = ("", "--", "N/A", "TICKER")


#: The public table of named references: those that end in a semicolon, common ones first, and the old ones that need
#: none, longest first.
COMMON = ("amp;", "nbsp;", "lt;", "gt;", "quot;")
ENTITIES = {n: html5[n] for n in (*COMMON, *sorted(html5)) if n.endswith(";")}
BARE_ENTITIES = {n: html5[n] for n in sorted(html5, key=lambda n: (-len(n), n)) if not n.endswith(";")}
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Characters beyond ASCII's that count as white space.
_WIDE_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NO_CHARACTER = "\ufffd"


def _map_literal(table: dict[str, str]) -> Column:
    """A map that the optimizer folds into one literal."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


def _of_old_code_page(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _numbered(reference: Column) -> Column:
    """The character of ``#123`` or ``#x1F``: codes 128 to 159 are read in the old Western code page, codes that are no
    characters give the replacement character, control codes nothing."""
    hexadecimal = F.regexp_extract(reference, r"^#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.regexp_extract(reference, r"^#0*([0-9]*)", 1)
    beyond = F.lit(0x110000)
    code = F.when(reference.rlike("^#[xX]"), F.when(F.length(hexadecimal) > 6, beyond).otherwise(F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("int")))
    code = code.otherwise(F.when(F.length(decimal) > 7, beyond).otherwise(F.concat(F.lit("0"), decimal).cast("int")))
    western = F.create_map(*(F.lit(x) for c in range(0x80, 0xA0) for x in (c, _of_old_code_page(c))))

    def character(c: Column) -> Column:
        out = F.when((c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), _NO_CHARACTER).when(c == 0x0D, "\r").when(c.between(0x80, 0x9F), F.try_element_at(western, c))
        out = out.when(c.between(1, 8) | (c == 0x0B) | c.between(0x0E, 0x1F) | (c == 0x7F) | c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(0xFFFE) == 0xFFFE), "")
        out = out.when(c == 0xFEFF, "\ufeff")  # alone, a decoder takes it for a byte-order mark
        return out.otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))

    return F.transform(F.array(code), character)[0]


def unescaped(source: Column) -> Column:
    """Character references resolved in one pass, as HTML 5 reads them: the longest known name counts, with or without its
    semicolon, and what is no reference stays."""
    named, bare = _map_literal(ENTITIES), _map_literal(BARE_ENTITIES)
    any_bare = f"^({'|'.join(BARE_ENTITIES)})"

    def split(piece: Column, place: Column) -> Column:
        reference = F.when(place > 0, F.regexp_extract(piece, _REFERENCE, 1)).otherwise("")
        return F.struct(piece.alias("piece"), reference.alias("reference"), (place == 0).alias("first"))

    def named_or_bare(x: Column) -> Column:
        """The characters that a reference by name stands for, and how much of the piece they replace; null where it's none."""
        reference = x["reference"]
        long = F.when(reference.endswith(";") & ~reference.startswith("#"), F.try_element_at(named, reference))
        short = F.when((reference != "") & ~reference.startswith("#"), F.regexp_extract(reference, any_bare, 1)).otherwise("")
        return x.withField("long", long).withField("short", short)

    def resolved(x: Column) -> Column:
        piece, reference, short = x["piece"], x["reference"], x["short"]
        after = lambda part: F.substring(piece, F.length(part) + 1, F.length(piece))
        out = F.when(x["first"], piece).when(reference == "", F.concat(F.lit("&"), piece)).when(reference.startswith("#"), F.concat(_numbered(reference), after(reference)))
        out = out.when(x["long"].isNotNull(), F.concat(x["long"], after(reference))).when(short != "", F.concat(F.try_element_at(bare, short), after(short)))
        return out.otherwise(F.concat(F.lit("&"), piece))

    pieces = F.transform(F.transform(F.transform(F.split(source, "&"), split), named_or_bare), resolved)
    return F.array_join(pieces, "")


def html_text(source: Column) -> Column:
    """Text of an HTML page: scripts and styles out, tags to spaces, references resolved, white space squeezed."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    bare = unescaped(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(F.translate(bare, _WIDE_SPACES, " " * len(_WIDE_SPACES)), r"\s+", " "))


def _rows(source: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))


def _cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))


def table_cells(source: Column) -> Column:
    """Array of rows, each an array of cleaned cells."""
    return F.transform(_rows(source), lambda r: F.transform(_cells(r), lambda c: html_text(c)))


def disclosure_trades(pages: DataFrame) -> DataFrame:
    """Trades of disclosure pages (url, html, senator, disclosure_date): rows of eight cells and more with a symbol. Cells are
    cleaned where they are used: Spark repeats what is exploded in a filter of its own."""
    rows = pages.select("url", "senator", "disclosure_date", F.explode(_rows(F.col("html"))).alias("r"))
    cells = rows.withColumn("c", _cells(F.col("r"))).filter(F.size("c") >= 8)
    at = lambda i: html_text(F.col("c")[i])
    out = cells.select(
        F.trim(F.regexp_replace("senator", r"\s*\([^)]*\)\s*$", "")).alias("senator"), F.upper(at(3)).alias("ticker"), at(4).alias("asset_description"), at(6).alias("transaction_type"), at(7).alias("amount"),
        day_of(at(1), "MM/dd/yyyy", "yyyy-MM-dd").alias("transaction_date"), "disclosure_date", F.col("url").alias("report_url"),
    ).filter(~F.col("ticker").isin(*NO_SYMBOL))
    return out.withColumn("id", content_id(F.col("report_url"), F.col("ticker"), F.col("transaction_type"), F.col("amount"), F.col("transaction_date")))


def filing_index(spark: SparkSession, path: str, kind: str = "P", row_tag: str = "Member") -> DataFrame:
    """Rows of an XML index of one filing type."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("Last string, First string, FilingType string, FilingDate string, DocID string").load(path)
    return rows.filter(F.col("FilingType") == kind).withColumn("filing_date", day_of(F.col("FilingDate"), "M/d/yyyy", "yyyy-MM-dd"))


def filings_between(index: DataFrame, start: Column, stop: Column) -> DataFrame:
    return index.filter(F.col("filing_date").between(start, stop))


def cell_symbol(cell: Column) -> Column:
    """The symbol in parentheses of an asset cell; symbols of one letter are left out."""
    found = F.regexp_extract(F.coalesce(cell, F.lit("")), r"\(([A-Z]{1,5}(?:/[A-Z]{1,2})?)\)", 1)
    return F.when(F.length(found) >= 2, found)


def feed_items(feeds: DataFrame, text: str = "xml") -> DataFrame:
    """(title, link, day, body) of the items of RSS documents."""
    items = feeds.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("i"))
    tag = lambda name: F.regexp_replace(F.regexp_extract("i", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    stamp = F.regexp_extract(tag("pubDate"), r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    return items.select(F.trim(tag("title")).alias("title"), F.trim(tag("link")).alias("link"), day_of(stamp, "d MMM yyyy").alias("day"), html_text(F.coalesce(F.nullif(tag("content:encoded"), F.lit("")), tag("description"))).alias("body"))


def links_of(pages: DataFrame) -> DataFrame:
    """(page_id, place, href, label) of the anchors of HTML pages."""
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>'), F.lit(1))
    return pages.select("page_id", F.posexplode(anchors).alias("place", "href"))


NOTE = "struct<tags:array<string>,title:string,tier:int,summary:string,factors:array<string>,type:string,confidence:string,verdict:string,body:string>"
# Retrieval tiers, the marks of front matter, and of a tier in a path.
TIERS = {"critical": 1, "high": 2, "medium": 3, "normal": 3, "low": 4, "archive": 5}
FRONT_MATTER = re.compile(r"\A---\r?\n(.*?)\r?\n---\r?\n?", re.DOTALL)
PATH_TIER = re.compile(r"tier[_-]?(\d)", re.IGNORECASE)


def _list(value) -> list[str]:
    parts = value.split(",") if isinstance(value, str) else value or []
    return [str(p).strip().lower() for p in parts if str(p).strip()]


def _scalar(text: str) -> str | list[str]:
    """A flow list, a quoted or a plain scalar; ValueError where it isn't well formed."""
    if text.startswith("["):
        if not text.endswith("]"):
            raise ValueError(text)
        return [x for v in text[1:-1].split(",") if v.strip() and isinstance(x := _scalar(v.strip()), str)]
    if text[:1] in ("'", '"'):
        if len(text) < 2 or text[-1] != text[0]:
            raise ValueError(text)
        return text[1:-1]
    if ": " in text or text.endswith(":") or text[:1] in tuple("@`%&"):
        raise ValueError(text)
    return text.split(" #", 1)[0].rstrip()


def read_front_matter(block: str) -> dict:
    """The subset of YAML that front matter uses: ``key: value``, ``[a, b]`` and dashed lists. A block that isn't well
    formed counts as empty, so that a filter by tags leaves its note out."""
    out, key = {}, None
    try:
        for line in block.splitlines():
            bare = line.strip()
            if not bare or bare.startswith("#"):
                continue
            if bare.startswith("- ") and isinstance(out.get(key), list):
                out[key].append(_scalar(bare[2:].strip()))
            elif line[0] not in " \t" and (m := re.match(r"([^:]+):(?:\s+(.*))?$", line)):
                key, value = m[1].strip(), (m[2] or "").strip()
                out[key] = _scalar(value) if value else []
            else:
                raise ValueError(line)
    except ValueError:
        return {}
    return out


def _note(text: str | None, path: str | None) -> dict:
    meta, body = {}, text or ""
    if held := FRONT_MATTER.match(body):
        meta, body = read_front_matter(held[1]), body[held.end() :]
    get = lambda k: meta[k].strip() if isinstance(meta.get(k), str) else None
    in_path = PATH_TIER.search(path or "")
    tier = TIERS.get((get("retrieval_priority") or "").lower()) or (int(in_path[1]) if in_path else None)
    aliases = ", ".join(meta["aliases"]) if isinstance(meta.get("aliases"), list) else ""
    lifted = "\n\n".join(filter(None, (get("title"), aliases, get("summary"))))
    tags = sorted({*_list(meta.get("tags")), *_list(meta.get("domains"))})
    return {"tags": tags, "title": get("title"), "tier": tier, "summary": get("summary"), "factors": _list(meta.get("factors")), "type": get("type"), "confidence": get("confidence"), "verdict": get("current_verdict"), "body": f"{lifted}\n\n{body.lstrip()}" if lifted else body}


def parse_notes(notes: DataFrame) -> DataFrame:
    """``notes`` (path, text) and the fields of their front matter; a note without one, or with a bad one, has empty tags.
    Title, aliases and summary go before the body; the tier is that of the priority, else the one that the path names."""

    @F.pandas_udf(NOTE)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, path in batches:
            rows = pd.DataFrame([_note(t, p) for t, p in zip(text, path, strict=True)], columns=["tags", "title", "tier", "summary", "factors", "type", "confidence", "verdict", "body"])
            yield rows.astype({"tier": "Int32"})

    return notes.withColumn("n", parse("text", "path")).select("path", "n.*")


def factor_links(notes: DataFrame) -> DataFrame:
    """A row per note and factor; ``*`` stands for all factors."""
    return notes.select("path", "title", "type", "verdict", F.explode("factors").alias("factor"))
