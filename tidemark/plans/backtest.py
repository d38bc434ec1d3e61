"""The factor backtest as one plan: features at rebalance dates, events, z-scores, composite, returns, statistics.

Everything stays in long form until the last step; the monthly series are a few hundred rows. The scored rows are written once and
read by every statistic; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import verdict
from tidemark.operators import events as ev
from tidemark.operators import panel, portfolio, stats, xsection
from tidemark.operators.asof import members_as_of
from tidemark.storage import stored


@dataclass(frozen=True)
class Settings:
    look: panel.Lookbacks = field(default_factory=panel.Lookbacks)
    least_names: int = 50
    least_tail: int = 20
    least_decile: int = 100
    top: float = 0.10
    blocks: dict = field(default_factory=lambda: {"price": ["z_mom", "z_trend"], "fund": ["z_value", "z_quality"], "flow": ["z_congress", "z_fund"]})
    variants: dict = field(default_factory=lambda: {"full": ["price", "fund", "flow"], "price": ["price"], "price_fund": ["price", "fund"]})
    #: Half-life and window in days per flow source. Insider and activism flows are scored, but in no block.
    flows: dict = field(default_factory=lambda: {"congress": (180, 365), "fund": (270, 540), "insider": (90, 180), "activism": (365, 730)})


#: For monthly bars of few names.
SMALL = Settings(look=panel.MONTHLY, least_names=5, least_tail=5, least_decile=10)


@dataclass
class Inputs:
    prices: DataFrame
    membership: DataFrame
    sectors: DataFrame
    events: DataFrame
    shorts: DataFrame | None = None
    fundamentals: DataFrame | None = None
    splits: DataFrame | None = None
    #: The day to which closes are adjusted; today if None.
    adjusted_through: Column | None = None


def factor_table(inputs: Inputs, s: Settings) -> DataFrame:
    """Per month and member: the raw factors, close, dollar volume, sector and the forward return."""
    cal = panel.calendar(inputs.prices)
    months = panel.rebalance_bars(cal, s.look)
    feats = panel.features(panel.dense_grid(inputs.prices, cal), s.look)
    at = feats.join(F.broadcast(months), "bar_ix").select("month_ix", "as_of", "ticker", "close", "mom", "trend", "vol", "dollar_volume")  # a row per month
    at = panel.forward_returns(at)
    members = members_as_of(months.select(F.col("as_of").alias("day")), inputs.membership).withColumnRenamed("day", "as_of")
    at = at.join(members, ["as_of", "ticker"]).join(inputs.sectors.select("ticker", "sector"), "ticker", "left")
    if inputs.fundamentals is not None:
        at = ev.fundamental_factors(at, inputs.fundamentals, inputs.splits, inputs.adjusted_through)
    flows = ev.decayed_flows(months, inputs.events, s.flows)
    at = at.join(flows.groupBy("as_of", "ticker").agg(*(F.max(F.when(F.col("source") == source, F.col("flow"))).alias(source) for source in s.flows)), ["as_of", "ticker"], "left")
    if inputs.shorts is not None:
        at = at.join(ev.short_pressure(months, inputs.shorts).withColumn("short", -F.col("short_fraction")).drop("short_fraction"), ["as_of", "ticker"], "left")
    return at


def scored(table: DataFrame, factors: list[str], s: Settings) -> DataFrame:
    """Eligible rows with a z column per factor, the composite variants and the sector-demeaned forward return."""
    lacking = [f for f in factors if f not in table.columns]
    if lacking:
        raise ValueError(f"no input gives the factors {lacking}")
    rows = xsection.eligible(table, ["close", "mom", "trend", "vol"], s.least_names)
    for f in factors:
        rows = xsection.winsor_z(rows, f, f"z_{f}", by=("month_ix",))
    return xsection.sector_demean(xsection.composite(rows, *made_of(factors, s)))


def made_of(factors: list[str], s: Settings) -> tuple[dict, dict]:
    """The blocks with those of their columns that are scored, and the variants of the blocks that have any: a factor that
    isn't asked for takes no part, rather than a column of nulls."""
    blocks = {b: held for b, cols in s.blocks.items() if (held := [c for c in cols if c in {f"z_{f}" for f in factors}])}
    return blocks, {v: held for v, parts in s.variants.items() if (held := [b for b in parts if b in blocks])}


def ic_series(rows: DataFrame, factors: list[str], s: Settings) -> DataFrame:
    """(series, month_ix, n, value): the rank IC of each factor and variant with the demeaned return."""
    names = [*(f"z_{f}" for f in factors), *made_of(factors, s)[1]]
    long = rows.select("month_ix", "ticker", "fwd_dm", F.explode(F.array(*(F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("score")) for n in names))).alias("x"))
    long = long.select("month_ix", "ticker", "fwd_dm", "x.series", "x.score")
    return xsection.rank_ic(long, "score", "fwd_dm", ("series", "month_ix")).select("series", "month_ix", "n", F.col("ic").alias("value"))


def report(inputs: Inputs, factors: list[str], s: Settings) -> dict[str, DataFrame]:
    """The tables of a run: scored rows, ic, ic_stats, ic_corr, variants, long_short, benchmark, universe, gate."""
    rows = stored(scored(factor_table(inputs, s), factors, s).filter("fwd IS NOT NULL"), "scored")
    months = panel.rebalance_bars(panel.calendar(inputs.prices), s.look)
    members = members_as_of(months.select(F.col("as_of").alias("day")), inputs.membership)
    priced = inputs.prices.filter("close IS NOT NULL").select(F.col("date").alias("day"), "ticker").distinct().withColumn("_p", F.lit(1))
    universe = members.join(priced, ["day", "ticker"], "left").groupBy(F.col("day").alias("as_of")).agg((F.count("_p") / F.count("*")).alias("coverage"))
    ic = stored(ic_series(rows, factors, s), "ic")
    held = None
    for v in made_of(factors, s)[1]:
        part = portfolio.net_of_cost(portfolio.turnover(portfolio.holdings(rows, v, "top", s.top, s.least_tail))).withColumn("series", F.lit(v))
        held = part if held is None else held.union(part)
    top = portfolio.turnover(portfolio.holdings(rows, "full", "top", s.top, s.least_decile))
    low = portfolio.turnover(portfolio.holdings(rows, "full", "bottom", s.top, s.least_decile))
    bench = rows.groupBy("month_ix").agg(F.avg("fwd").alias("ret"), F.count("*").alias("n"))
    ic_stats = stats.newey_west(ic)
    return {
        "rows": rows, "ic": ic, "ic_stats": ic_stats, "ic_corr": stats.series_correlation(ic), "variants": held, "summary": portfolio.annualise(held),
        "hits": portfolio.hit_rate(held, bench), "long_short": portfolio.long_short(top, low), "benchmark": bench, "universe": universe, "gate": stats.gate(ic_stats, own_tests=len(factors) + len(made_of(factors, s)[1])),
    }


def snapshot(run: dict[str, DataFrame], snapshot_date: Column, factors: list[str]) -> DataFrame:
    """A run's row per factor for the history: snapshot_date, factor, ic_mean, ic_tstat, ic_tstat_nw, coverage (mean share of
    eligible names that have the factor), n_months (scored months), universe_coverage (mean share of members with a price)."""
    rows = run["rows"]
    held = rows.select("month_ix", F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(f"z_{c}").alias("z")) for c in factors))).alias("x")).select("month_ix", "x.factor", "x.z")
    share = xsection.coverage(held).groupBy("factor").agg(F.avg("coverage").alias("coverage"))
    one = rows.agg(F.count_distinct("month_ix").alias("n_months")).withColumn("_k", F.lit(0)).join(run["universe"].agg(F.avg("coverage").alias("universe_coverage")).withColumn("_k", F.lit(0)), "_k")  # one-row tables
    named = F.regexp_replace("series", "^z_", "").alias("factor")
    nw, naive = run["ic_stats"].select(named, F.col("mean").alias("ic_mean"), F.col("t").alias("ic_tstat_nw")), stats.naive_t(run["ic"]).select(named, F.col("t").alias("ic_tstat"))
    out = nw.join(naive, "factor").join(share, "factor").withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k")
    return out.select(snapshot_date.alias("snapshot_date"), "factor", "ic_mean", "ic_tstat", "ic_tstat_nw", "coverage", "n_months", "universe_coverage")


def split_sample(rows: DataFrame, factor: str, split_after: str, s: Settings, start_year: int | None = None) -> DataFrame:
    """Pre-registered test of one factor: rank IC with raw forward returns in and out of sample, with both t values. Months
    before ``start_year`` take no part."""
    if start_year is not None:
        rows = rows.filter(F.year("as_of") >= start_year)
    z = xsection.winsor_z(rows, factor, "z", by=("month_ix",))
    z = z.withColumn("series", F.when(F.col("as_of") <= F.lit(split_after).cast("date"), "in").otherwise("out"))
    ic = stored(xsection.rank_ic(z, "z", "fwd", ("series", "month_ix"), least=s.least_names).withColumnRenamed("ic", "value"), "ic")
    nw, naive = stats.newey_west(ic), stats.naive_t(ic).select("series", F.col("t").alias("naive_t"))
    return nw.join(naive, "series").withColumn("verdict", verdict(F.col("t")))
