"""Connected components of a graph held as a table of edges, by alternating large and small stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the smallest neighbour. Minima are taken by an
aggregate that combines before the shuffle, and joined back by key, so a node with very many edges is no task's burden.
Rounds are cut by tables in the shared folder; the driver sees three numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

MOST_ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """Per u: the smallest of u and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u"), F.least("u", "low").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has longs u and v. Returns (node, root) for every node of an edge; root is the smallest reachable node."""
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.join(_lowest(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()
        now = stored(small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point of the components after {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
