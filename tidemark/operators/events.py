"""Signed, dated events from each feed, and what is made of them at rebalance dates. Flow windows exclude the date itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import amount_midpoint, known_on, stance_sign, trade_sign
from tidemark.operators.asof import as_of
from tidemark.operators.ranks import percent_ranks
from tidemark.storage import stored

EVENT = ["source", "ticker", "when", "signed_weight"]
#: The day from which scaled weights are counted.
EPOCH = "2000-01-01"


def congress_events(trades: DataFrame) -> DataFrame:
    """Raw dollars on purpose. Amended rows (true) and bad symbols (false) are out; unknown marks stay in."""
    sign, mid = trade_sign(F.col("transaction_type")), amount_midpoint(F.col("amount"))
    held = trades.filter(~F.coalesce("amended", F.lit(False)) & F.coalesce("ticker_ok", F.lit(True)))
    held = held.select(F.lit("congress").alias("source"), F.upper("ticker").alias("ticker"), known_on(F.col("disclosure_date"), F.col("transaction_date")).alias("when"), sign.alias("_s"), mid.alias("_m"))
    return held.filter("_s <> 0 AND _m > 0 AND when IS NOT NULL").select("source", "ticker", "when", (F.col("_s") * F.col("_m")).alias("signed_weight"))


def fund_events(moves: DataFrame, prices: DataFrame, stale_days: int = 10) -> tuple[DataFrame, DataFrame]:
    """(events, dropped exits). New and added positions weigh +1, others -1/2, times ln(1 + magnitude); an exit's magnitude
    is its former shares at the last close of the ten days to its filing, inclusive."""
    priced = as_of(moves, prices.filter("close IS NOT NULL").select("ticker", "date", "close"), ["ticker"], "filing_date", "date", ["close"], within_days=stale_days)
    magnitude = F.when(F.col("action") == "EXIT", F.col("prev_shares") * F.col("close")).otherwise(F.col("value").cast("double"))
    priced = priced.withColumn("_m", magnitude)
    dropped = priced.filter("action = 'EXIT' AND (_m IS NULL OR _m <= 0)").agg(F.count("*").alias("dropped_exits"))
    side = F.when(F.col("action").isin("NEW", "ADD"), 1.0).otherwise(-0.5)
    held = priced.filter("_m > 0 AND filing_date IS NOT NULL")
    return held.select(F.lit("fund").alias("source"), "ticker", F.col("filing_date").alias("when"), (side * F.log1p("_m")).alias("signed_weight")), dropped


def insider_events(buys: DataFrame) -> DataFrame:
    """Weight: percent rank of the value in its month, floored at 0.01, times ln(1 + distinct buyers of the issuer's month).
    Buyers are counted by an aggregate and joined back; a month's values are ranked by ranges, as a month may be large."""
    held = buys.filter("value > 0 AND filing_date IS NOT NULL").withColumn("_month", F.trunc("filing_date", "month"))
    buyers = held.groupBy("ticker", "_month").agg(F.count_distinct("filer").alias("_buyers"))
    ranked = percent_ranks(held.select("ticker", "filing_date", "_month", "value"), "value", ("_month",), "_rank").join(buyers, ["ticker", "_month"])
    return ranked.select(F.lit("insider").alias("source"), "ticker", F.col("filing_date").alias("when"), (F.greatest("_rank", F.lit(0.01)) * F.log1p(F.col("_buyers").cast("double"))).alias("signed_weight"))


def activism_events(stakes: DataFrame) -> DataFrame:
    return stakes.filter("ticker IS NOT NULL AND filing_date IS NOT NULL").select(F.lit("activism").alias("source"), "ticker", F.col("filing_date").alias("when"), F.lit(1.0).alias("signed_weight"))


def statement_events(mentions: DataFrame) -> DataFrame:
    return mentions.filter("ticker IS NOT NULL AND statement_date IS NOT NULL").select(F.lit("statement").alias("source"), "ticker", F.col("statement_date").alias("when"), stance_sign(F.col("stance")).alias("signed_weight"))


def short_fraction(rows: DataFrame) -> DataFrame:
    return rows.filter("total_volume > 0").select("ticker", "date", (F.col("short_volume") / F.col("total_volume")).alias("short_fraction"))


def decayed_flows(dates: DataFrame, events: DataFrame, horizons: dict[str, tuple[float, int]]) -> DataFrame:
    """(as_of, ticker, source, flow): per date, the sum of a source's weights over the window before it, which halve every
    half-life. ``horizons``: half-life and window in days by source; other sources are left out.

    A weight that halves factorises: 2^((t - as_of) / h) is 2^((t - epoch) / h) by 2^((as_of - epoch) / h). So a window's
    sum is the difference of two running sums of scaled daily weights, and all sources take one pass: their days and the
    two ends of each date's window are sorted together by ticker. A ticker's rows are its days and dates, however many
    events a day has. Scaled weights stay within doubles for dates up to 250 half-lives of 365 days from the epoch.
    """
    pick = lambda i: F.coalesce(*(F.when(F.col("source") == s, F.lit(float(h[i]))) for s, h in horizons.items()))
    scaled = F.col("signed_weight") * F.pow(F.lit(2.0), F.datediff("when", F.lit(EPOCH).cast("date")) / pick(0))
    daily = events.filter(F.col("source").isin(*horizons) & F.col("when").isNotNull()).groupBy("source", "ticker", F.col("when").alias("day")).agg(F.sum(scaled).alias("s"), F.count("*").alias("c"))
    daily = stored(daily, "daily-flows")  # read twice, and events are many joins away from their feeds
    ends = daily.groupBy("source", "ticker").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    every = dates.select("as_of").distinct().agg(F.array_sort(F.collect_list("as_of")).alias("_dates")).withColumn("_one", F.lit(1))  # a row per date
    days = pick(1).cast("int")
    cells = ends.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").withColumn("_days", days)
    near = F.filter("_dates", lambda d: (d > F.col("_first")) & (d <= F.date_add(F.col("_last"), F.col("_days"))))
    cells = cells.select("source", "ticker", "_days", F.explode(near).alias("as_of"))
    bounds = F.array(F.struct(F.col("as_of").alias("day"), F.lit(1).alias("sign")), F.struct(F.date_sub(F.col("as_of"), F.col("_days")).alias("day"), F.lit(-1).alias("sign")))
    bounds = cells.select("source", "ticker", "as_of", F.explode(bounds).alias("b")).select("source", "ticker", "b.day", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"), "as_of", "b.sign")
    both = daily.select("source", "ticker", "day", "s", "c", F.lit(None).cast("date").alias("as_of"), F.lit(0).alias("sign")).union(bounds)
    run = Window.partitionBy("source", "ticker").orderBy("day", F.desc(F.abs("sign")), "as_of", "sign").rowsBetween(Window.unboundedPreceding, 0)  # an end comes before the day's own events
    sums = both.withColumn("_s", F.sum("s").over(run)).withColumn("_c", F.sum("c").over(run)).filter("sign <> 0")
    out = sums.groupBy("source", "ticker", "as_of").agg(F.sum(F.col("sign") * F.col("_s")).alias("_s"), F.sum(F.col("sign") * F.col("_c")).alias("_c")).filter("_c > 0")
    return out.select("as_of", "ticker", "source", (F.col("_s") * F.pow(F.lit(2.0), -F.datediff("as_of", F.lit(EPOCH).cast("date")) / pick(0))).alias("flow"))


def in_reach(events: DataFrame, first: Column, last: Column, horizons: dict[str, tuple[float, int]]) -> DataFrame:
    """Events that count at a date from ``first`` to ``last``: from the first one's window to the day before the last. Where
    dates are known beforehand, the others are left out at their feeds, not summed, stored and cancelled."""
    window = F.coalesce(*(F.when(F.col("source") == s, F.lit(int(h[1]))) for s, h in horizons.items()))
    return events.filter((F.col("when") >= F.date_sub(first, window)) & (F.col("when") < last))


def decayed_flow(dates: DataFrame, events: DataFrame, source: str, half_life: float, window_days: int) -> DataFrame:
    """``decayed_flows`` of one source."""
    return decayed_flows(dates, events, {source: (half_life, window_days)})


def short_pressure(dates: DataFrame, shorts: DataFrame, sessions: int = 5) -> DataFrame:
    """Per date and ticker: the mean short fraction of the sessions, among the last ``sessions`` with data strictly before
    the date, in which the ticker appears. The calendar of sessions is global."""
    days = shorts.select("date").distinct().withColumn("ix", F.row_number().over(Window.orderBy("date")))  # a row per session
    nearest = as_of(dates.select("as_of").distinct().withColumn("_k", F.lit(1)), days.withColumn("_k", F.lit(1)), ["_k"], "as_of", "date", ["ix"], strict=True).filter("ix IS NOT NULL")
    spread = nearest.select("as_of", F.explode(F.sequence(F.greatest(F.lit(1), F.col("ix") - (sessions - 1)), "ix")).alias("ix"))
    return spread.join(days, "ix").join(shorts, "date").groupBy("as_of", "ticker").agg(F.avg("short_fraction").alias("short_fraction"))


def split_factor(facts: DataFrame, splits: DataFrame, adjusted_through: Column) -> DataFrame:
    """``facts`` and split_factor: the product of the ratios after the filing date, up to ``adjusted_through``."""
    held = facts.select("ticker", "filing_date").distinct().join(splits.filter("ratio > 0").select("ticker", F.col("date").alias("_d"), "ratio"), "ticker")
    held = held.filter((F.col("_d") > F.col("filing_date")) & (F.col("_d") <= adjusted_through))
    factor = held.groupBy("ticker", "filing_date").agg(F.product("ratio").alias("split_factor"))
    return facts.join(factor, ["ticker", "filing_date"], "left").withColumn("split_factor", F.coalesce("split_factor", F.lit(1.0)))


def split_factor_between(rows: DataFrame, splits: DataFrame, since: str, until: str) -> DataFrame:
    """``rows`` and split_factor: the product of a ticker's ratios after the day ``since`` up to the day ``until``, as the
    quotient of two running products; one where no split is known."""
    run = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = splits.filter("ratio > 0").groupBy("ticker", "date").agg(F.product("ratio").alias("_r")).withColumn("_all", F.product("_r").over(run))
    for name, when in (("_from", since), ("_to", until)):
        rows = as_of(rows, days.select("ticker", "date", F.col("_all").alias(name)), ["ticker"], when, "date", [name])
    factor = F.coalesce("_to", F.lit(1.0)) / F.coalesce("_from", F.lit(1.0))
    return rows.withColumn("split_factor", factor).drop("_from", "_to")


def fundamental_factors(rows: DataFrame, facts: DataFrame, splits: DataFrame, adjusted_through: Column | None = None) -> DataFrame:
    """``rows`` (ticker, as_of, close) with value (earnings per share by the close) and quality (net income by equity, which
    may be negative but not zero) of the latest facts filed strictly before the day; of one day's the newest period's.

    Earnings are restated for every split after the filing up to ``adjusted_through`` (default: today), not to the day
    itself, as closes are adjusted back from then."""
    held = as_of(rows, facts.withColumn("filed", F.col("filing_date")), ["ticker"], "as_of", "filing_date", ["filed", "eps", "net_income", "equity"], strict=True, ties=["period_end"])
    held = held.withColumn("_through", F.current_date() if adjusted_through is None else adjusted_through)
    held = split_factor_between(held, splits, "filed", "_through")
    value = F.when(F.col("close") > 0, F.col("eps") / F.col("split_factor") / F.col("close"))
    quality = F.when(F.col("equity") != 0, F.col("net_income") / F.col("equity"))
    return held.withColumn("value", value).withColumn("quality", quality).drop("filed", "eps", "net_income", "equity", "split_factor", "_through")


def holdings_rollup(lines: DataFrame) -> DataFrame:
    """13F lines of shares summed per manager, filing and symbol; the issuer is the alphabetically last."""
    held = lines.filter(F.col("type") == "Shares").withColumn("ticker", F.upper("ticker"))
    return held.groupBy("manager", "filing_date", "ticker").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"), F.max("issuer").alias("issuer"))


def holding_moves(holdings: DataFrame) -> DataFrame:
    """Changes between consecutive filings of each manager: NEW, ADD, TRIM, EXIT, stamped with the later filing."""
    filings = holdings.select("manager", "filing_date").distinct().withColumn("seq", F.row_number().over(Window.partitionBy("manager").orderBy("filing_date")))
    rows = holdings.join(filings, ["manager", "filing_date"])
    new = rows.filter("seq > 1").select("manager", "ticker", "seq", "shares", "value")
    later = filings.select("manager", F.col("seq"), F.col("filing_date"))
    old = rows.select("manager", "ticker", (F.col("seq") + 1).alias("seq"), F.col("shares").alias("prev_shares"), F.col("value").alias("prev_value"))
    both = new.join(old, ["manager", "ticker", "seq"], "full_outer").join(later, ["manager", "seq"])
    action = F.when(F.col("prev_shares").isNull(), "NEW").when(F.col("shares").isNull(), "EXIT").when(F.col("shares") > F.col("prev_shares"), "ADD").when(F.col("shares") < F.col("prev_shares"), "TRIM")
    both = both.withColumn("action", action).filter("action IS NOT NULL")
    pct = F.when(F.col("action") == "EXIT", -1.0).when(F.col("action") != "NEW", F.col("shares") / F.col("prev_shares") - 1)
    return both.select("manager", "ticker", "filing_date", "action", F.coalesce("shares", F.lit(0.0)).alias("shares"), F.coalesce("prev_shares", F.lit(0.0)).alias("prev_shares"), F.coalesce("value", F.lit(0.0)).alias("value"), pct.alias("pct_change"))
