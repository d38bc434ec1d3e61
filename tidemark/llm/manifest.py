"""A Merkle manifest of a dataset: levels of hash nodes, and proofs by a recursive query.

H is the lowercase hex SHA-256 of its inputs, concatenated. A document's leaf is H of its fields, each ``-`` if null and
else its UTF-8 byte count, ``:`` and its value. The leaves of a source ascend by doc_id; every FANOUT consecutive nodes of
a level become their H, until one is left, the source's subroot; the subroots, ordered by source, make the root alike.

Levels are built bottom-up and kept as rows of one node table: the hashes of a node's children and a link to its parent.
Leaves are put in order by ranges (no window holds a source). The proof of every leaf is then one recursive Spark query:
a step joins each path with the parent of where it stands, appends the siblings there, and folds its hashes one level up;
a path ends where there is no parent. The leaves of one run of FANOUT share their siblings from there up, so they climb as
one row that holds their distinct hashes side by side: siblings are carried once a run, and so is the hash that all
untampered leaves fold to. A node that many runs climb through is kept in a copy per RUNS_PER_COPY of them, and each run
picks one; so no key of the join has more, the root's neither. Up to BROADCAST_NODES, which are counted, nodes are
broadcast; beyond it the join shuffles.

Defined results: a null doc_id comes first in its source; rows that share a doc_id are ordered by their leaf, and equal
rows are leaves of their own, with equal results or, in different runs, different proofs; a null source is a source;
an empty table gives no rows. Only the hashed columns are read; extra columns are neither hashed nor kept.
"""

from __future__ import annotations

import string
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored
from tidemark.operators.ranks import numbered, placed, ranges

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
RUNS_PER_COPY = 256
#: Nodes, of about 700 bytes, that are sent to every task.
BROADCAST_NODES = 20_000
#: More levels than any number of rows has.
MOST_LEVELS = 40
#: The group of the nodes above the subroots.
_ABOVE = -1


def _text(c: Column) -> Column:
    value = c.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hex digest of a row; ``fields`` in the order in which they are hashed."""
    return F.sha2(F.concat(*map(_text, fields.values())), 256)


def hex_of(digests: Column) -> Column:
    """The hex texts of an array of binary digests, concatenated."""
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def node_hash(digests: Column) -> Column:
    return F.unhex(F.sha2(hex_of(digests), 256))


def lowered(rows: DataFrame) -> dict[str, Column]:
    """The tampering that the query tests proofs by: A-Z of the text are lowered where 5 divides the id's CRC-32."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return {"text": F.when(touched, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))}


def _level(below: DataFrame, keys: list[str]) -> DataFrame:
    """Parents of nodes (keys, seq, hash, runs): keys, seq, hash, runs and the children's hashes in order."""
    up = below.groupBy(*keys, F.floor(F.col("seq") / FANOUT).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("seq", "hash"))).alias("c"), F.sum("runs").alias("runs"))  # FANOUT children
    children = F.transform("c", lambda x: x["hash"])
    return up.select(*keys, F.col("up").alias("seq"), node_hash(children).alias("hash"), "runs", children.alias("children"))


def _climbed(level: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels above ``level`` (grp, seq, hash, runs, n: nodes of the group there), and the top nodes of groups."""
    levels, tops, number = [], [], 0
    while True:
        tops.append(level.filter("n = 1").select("grp", "hash", "runs"))
        rest = level.filter("n > 1")
        if number >= MOST_LEVELS or not rest.limit(1).count():
            break
        number += 1
        level = _level(rest.withColumn("next_n", F.ceil(F.col("n") / FANOUT)), ["grp", "next_n"]).withColumnRenamed("next_n", "n")
        level = stored(level.withColumn("level", F.lit(number)), f"{label}-{number}")
        levels.append(level)
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return levels, out


def build(docs: DataFrame, tampered: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, str | None]:
    """(nodes, runs, root) of a table of documents.

    ``nodes``: level, grp, seq, salt, children, and the parent's up_level, up_grp, up_seq, up_salts with the node's place
    in it (nulls at the root). ``runs``: a row per run of leaves, as it begins to climb; ``tampered`` replaces fields in the
    hashes that climb.
    """
    fields = {c: F.col(c) for c in FIELDS}
    claim = fields | (tampered or {})
    leaves = stored(docs.select("source", "doc_id", F.unhex(leaf_hash(fields)).alias("hash"), F.unhex(leaf_hash(claim)).alias("folded")), "leaves")
    held, starts = ranges(leaves, ["doc_id", "hash", "folded"], ("source",))
    sources = numbered(starts.groupBy("source").agg(F.sum("_count").alias("n")), ["source"], name="grp", parts=1 if starts.count() < 10_000 else None)
    sources = sources.select(F.col("source").alias("_source"), (F.col("grp") - 1).alias("grp"), "n")
    starts = starts.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = placed(held, starts, ("source",), "seq", ("grp", "n")).withColumn("seq", F.col("seq") - 1)
    member = F.struct("seq", "doc_id", "hash", "folded")
    runs = rows.groupBy("grp", "n", F.floor(F.col("seq") / FANOUT).cast("long").alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members"))  # FANOUT leaves
    own = F.transform("members", lambda m: m["hash"])
    runs = stored(runs.select("grp", "n", "run", "members", F.when(F.col("n") > 1, node_hash(own)).otherwise(F.element_at(own, 1)).alias("hash")), "runs")
    dropped(leaves)
    # Runs are level 1; a source's lone leaf stands there as it is.
    first = runs.select("grp", F.col("run").alias("seq"), "hash", F.lit(1).cast("long").alias("runs"), F.ceil(F.col("n") / FANOUT).alias("n"))
    levels, tops = _climbed(first, "nodes")
    tops = stored(tops, "subroots")
    n_sources = tops.count()
    over, root = _climbed(tops.select(F.lit(_ABOVE).cast("long").alias("grp"), F.col("grp").alias("seq"), "hash", "runs", F.lit(n_sources).alias("n")), "above") if n_sources else ([], tops)
    top = root.select(F.lower(F.hex("hash"))).first()
    nodes = _linked(docs.sparkSession, levels, over, n_sources)
    at_top = F.col("n") <= FANOUT  # the only run of its source
    start = runs.select(
        "grp", "run", "members", F.xxhash64("grp", "run").alias("spread"),
        *_up(F.lit(1), F.col("grp"), F.col("run"), at_top, n_sources), F.when(at_top, F.col("hash")).alias("subroot"), (F.col("n") > 1).alias("has_run"),
    )
    parents = nodes.select(F.col("level").alias("up_level"), F.col("grp").alias("up_grp"), F.col("seq").alias("up_seq"), F.col("salts").alias("up_salts")).filter("salt = 0")
    start = start.join(parents, ["up_level", "up_grp", "up_seq"], "left")
    return nodes, start, top[0] if top else None


def _up(level: Column, grp: Column, seq: Column, at_top: Column, n_sources: int) -> list[Column]:
    """Key of the parent of a node, and the node's place in it; at the top of a group it is a node above the subroots."""
    inner = grp != _ABOVE
    child = F.when(inner & at_top, grp).otherwise(seq)
    end = (inner & at_top & F.lit(n_sources == 1)) | (~inner & at_top)
    key = lambda c: F.when(~end, c)
    return [
        key(F.when(inner & at_top, F.lit(1)).otherwise(level + 1)).alias("up_level"), key(F.when(at_top, F.lit(_ABOVE).cast("long")).otherwise(grp)).alias("up_grp"),
        key(F.floor(child / FANOUT).cast("long")).alias("up_seq"), key(F.pmod(child, F.lit(FANOUT)).cast("int")).alias("place"),
    ]


def _linked(spark: SparkSession, levels: list[DataFrame], over: list[DataFrame], n_sources: int) -> DataFrame:
    """One stored table of all nodes above the runs, linked to their parents, in copies by the runs below them."""
    inner = spark.createDataFrame([], "level int, grp long, seq long, children array<binary>, runs long, at_top boolean")
    for df in [*(level.withColumn("level", F.col("level") + 1) for level in levels), *over]:
        inner = inner.union(df.select("level", "grp", "seq", "children", "runs", (F.col("n") == 1).alias("at_top")))
    salts = F.ceil(F.col("runs") / RUNS_PER_COPY).cast("long")
    linked = inner.withColumn("salts", salts).select("level", "grp", "seq", "children", "salts", *_up(F.col("level"), F.col("grp"), F.col("seq"), F.col("at_top"), n_sources))
    parents = linked.select(F.col("level").alias("up_level"), F.col("grp").alias("up_grp"), F.col("seq").alias("up_seq"), F.col("salts").alias("up_salts"))
    linked = linked.join(parents, ["up_level", "up_grp", "up_seq"], "left")
    return stored(linked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "nodes")


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """A recursive query stops at a million rows unless told otherwise."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_CLIMB = f"""
WITH RECURSIVE climb(grp, run, claims, siblings, subroot, spread, up_level, up_grp, up_seq, up_salts, place) MAX RECURSION LEVEL {MOST_LEVELS} AS (
  SELECT grp, run, claims, CAST('' AS binary), subroot, spread, up_level, up_grp, up_seq, up_salts, place FROM {{start}}
  UNION ALL
  SELECT c.grp, c.run,
         transform(c.claims, x -> unhex(sha2(array_join(transform(n.children, (d, i) -> lower(hex(if(i = c.place, x, d)))), ''), 256))),
         concat(c.siblings, unhex(array_join(transform(filter(n.children, (d, i) -> i <> c.place), d -> hex(d)), ''))),
         if(n.grp = {_ABOVE} AND c.subroot IS NULL, n.children[c.place], c.subroot),
         c.spread, n.up_level, n.up_grp, n.up_seq, n.up_salts, n.place
  FROM climb c JOIN {{nodes}} n ON c.up_level = n.level AND c.up_grp = n.grp AND c.up_seq = n.seq AND pmod(c.spread, c.up_salts) = n.salt
)
SELECT grp, run, claims, siblings, subroot FROM climb WHERE up_level IS NULL
"""


def proofs(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, siblings (hex digests, concatenated, level by level up to the root) and
    folded_root."""
    spark = docs.sparkSession
    nodes, start, root = build(docs, tampered)
    # Within the run: each leaf's hash folded with those of the others; ``claim`` is its place among the distinct ones.
    up = lambda m, j: F.when(F.col("has_run"), node_hash(F.transform("members", lambda d, i: F.when(i == j, m["folded"]).otherwise(d["hash"])))).otherwise(m["folded"])
    start = start.withColumn("folded", F.transform("members", up)).withColumn("claims", F.array_distinct("folded"))
    members = F.zip_with("members", "folded", lambda m, f: F.struct(m["doc_id"].alias("doc_id"), m["hash"].alias("hash"), F.array_position(F.col("claims"), f).alias("claim")))
    start = stored(start.withColumn("members", members).drop("folded"), "climb-start")
    with _any_number_of_rows(spark):
        known = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
        climbed = stored(spark.sql(_CLIMB, start=start.drop("members"), nodes=known), "climbed")
    others = lambda j: hex_of(F.filter(F.transform("members", lambda m: m["hash"]), lambda d, i: i != j))
    each = climbed.join(start.select("grp", "run", "members"), ["grp", "run"]).select("claims", "siblings", "subroot", F.posexplode("members").alias("j", "m"), "members")
    top = F.lit(root).cast("string")
    return each.select(
        F.col("m.doc_id").alias("doc_id"), F.lower(F.hex("m.hash")).alias("leaf"), F.coalesce(F.lower(F.hex("subroot")), top).alias("subroot"), top.alias("root"),
        F.concat(others(F.col("j")), F.lower(F.hex("siblings"))).alias("siblings"), F.lower(F.hex(F.element_at("claims", F.col("m.claim").cast("int")))).alias("folded_root"),
    )


def verified(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    out = proofs(docs, tampered)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
