"""Scalar expressions: amounts, signs, dates, names, decay, bands. All are column functions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 over the parts joined by ``|``; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def amount_midpoint(text: Column) -> Column:
    """Midpoint of an amount range: 0 without a number, the number itself if alone, else the mean of the first two."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\$?\s*([\d,]+)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "")), lambda x: x != "")
    number = lambda x, i: F.try_element_at(x, F.lit(i)).cast("double")
    middle = lambda x: F.when(F.size(x) == 0, F.lit(0.0)).when(F.size(x) == 1, number(x, 1)).otherwise((number(x, 1) + number(x, 2)) / 2)
    return F.when(text.isNull(), F.lit(0.0)).otherwise(F.transform(F.array(found), middle)[0])  # finds the numbers once


def trade_sign(kind: Column, dialect: str = "full") -> Column:
    """+1 for purchases, -1 for sales, else 0. ``full`` reads one-letter codes first; ``english`` reads words only;
    ``profile`` also takes ``sell`` and codes with a parenthesis."""
    low = F.trim(F.lower(F.coalesce(kind, F.lit(""))))
    words = F.when(low.contains("purchase"), 1).when(low.contains("sale"), -1)
    if dialect == "english":
        return words.otherwise(0)
    if dialect == "profile":
        return F.when(low.contains("purchase") | (low == "p") | low.startswith("p "), 1).when(low.contains("sale") | low.contains("sell") | (low == "s") | low.startswith("s ("), -1).otherwise(0)
    lead = F.regexp_replace(F.element_at(F.split(low, r"\s+"), 1), r"\.+$", "")
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("p", 1, "s", -1, "e", 0))), lead), words.otherwise(0))  # reads the code once


def day_of(text: Column, *patterns: str) -> Column:
    """The first pattern that parses; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("date") for p in patterns))


def month_name_day(text: Column) -> Column:
    """``DD-MON-YYYY`` with the month in any case."""
    return day_of(F.initcap(F.lower(F.trim(text))), "dd-MMM-yyyy")


def known_on(disclosed: Column, traded: Column) -> Column:
    return F.coalesce(disclosed, traded)


def lag_band(days: Column) -> Column:
    """Disclosure lag in the report's four bands; negative lags have none."""
    return F.when(days < 0, None).when(days <= 30, "0-30").when(days <= 45, "31-45").when(days <= 90, "46-90").when(days > 90, "90+")


def person_key(name: Column) -> Column:
    """Lower-case name without honorific and generational suffix, spaces squeezed."""
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[.,]", " ")
    low = F.regexp_replace(F.trim(low), r"^(hon|honorable|mr|mrs|ms|dr|sen|senator|rep|representative)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\s+(jr|sr|i{1,3}|iv|v)\s*$", ""), r"\s+", " "))


# Legal suffixes of company names.
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "company", "companies", "co", "technologies", "holdings", "plc", "ltd", "limited", r"n\.?v", r"s\.?a")


def company_key(name: Column) -> Column:
    """Company name without one trailing legal suffix."""
    return F.trim(F.regexp_replace(F.trim(name), rf"(?i)[\s,]+({'|'.join(LEGAL_SUFFIXES)})\b\.?$", ""))


def stance_sign(stance: Column) -> Column:
    return F.when(stance == "positive", 1.0).when(stance == "negative", -1.0).otherwise(0.0)


def owner_role(relation: Column) -> Column:
    """Officer before director before ten-percent owner; anything else is other."""
    low = F.lower(F.coalesce(relation, F.lit("")))
    return F.when(low.contains("officer"), "officer").when(low.contains("director"), "director").when(low.contains("tenpercent"), "owner").otherwise("other")


def half_life_decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / F.lit(float(half_life)))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null where the bottom is null or zero."""
    return F.when(bottom != 0, top / bottom)


def valid_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike(r"^[A-Z]{1,5}([./][A-Z]{1,2})?$"), F.lit(False))


def band(value: Column, cuts: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """The first label whose cut the value is under; the last label beyond all cuts; null for null."""
    out = F.when(value.isNull(), None)
    for cut, label in zip(cuts, labels, strict=False):
        out = out.when(value < cut, label)
    return out.otherwise(labels[-1])


# The cuts of each metric's bands.
METRIC_CUTS = {
    "z": (-1.5, -0.5, 0.5, 1.5),
    "rsi": (30, 40, 60, 70),
    "pe": (12, 20, 35, 60),
    "range_pct": (15, 40, 60, 85),
    "market_cap": (2e9, 1e10, 2e11, 1e12),
    "composite": (-0.5, 0.0, 0.5, 1.0),
}


def metric_band(metric: str, value: Column) -> Column:
    """0 to 4: how many of the metric's cuts the value reaches (a price-earnings ratio must lie above them, and has no band
    if it isn't positive); null for null."""
    above = (lambda cut: value > cut) if metric == "pe" else (lambda cut: value >= cut)
    held = value.isNotNull() & ((value > 0) if metric == "pe" else F.lit(True))
    return F.when(held, sum((above(F.lit(float(cut))).cast("int") for cut in METRIC_CUTS[metric]), F.lit(0)))


def range_place(price: Column, low: Column, high: Column) -> Column:
    """Where a price stands in its range, in percent; null for a range of nothing."""
    return F.when(high > low, (price - low) / (high - low) * 100)


def conviction(composite: Column) -> Column:
    return F.when(composite.isNull(), None).when(composite >= 1.0, 5).when(composite >= 0.6, 4).when(composite >= 0.2, 3).when(composite >= -0.2, 2).otherwise(1)


def case_side(z: Column) -> Column:
    return F.when(z >= 0.5, "bull").when(z <= -0.5, "risk")


def attention(conviction_: Column, zone: Column, momentum: Column, why_now: Column, base_rate: Column, pre_mortem: Column) -> Column:
    """0 to 100: conviction (of 5) is worth 40, a value zone up to 25, momentum up to 20, and each note 5."""
    note = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, 5).otherwise(0)
    zone_points = F.when(zone == "deep", 25).when(zone == "fair", 15).when(zone == "rich", 5).otherwise(0)
    momentum_points = F.when(momentum == "strong", 20).when(momentum == "up", 10).when(momentum == "flat", 5).otherwise(0)
    return F.coalesce(conviction_, F.lit(0)) / 5 * 40 + zone_points + momentum_points + note(why_now) + note(base_rate) + note(pre_mortem)


def headline_reaction(five: Column, one: Column, twenty: Column) -> Column:
    """The first reaction at hand, with its label."""
    named = lambda c, label: F.when(c.isNotNull(), F.struct(F.lit(label).alias("horizon"), c.alias("reaction")))
    return F.coalesce(named(five, "5d"), named(one, "1d"), named(twenty, "20d"))


def verdict(t: Column) -> Column:
    return F.when(F.abs(t) >= 3, "strong").when(F.abs(t) >= 2, "suggestive").otherwise("none")


def null_mean(*values: Column) -> Column:
    """Mean of those values that aren't null; null if all are."""
    held = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))
