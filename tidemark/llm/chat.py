"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked, each written as one conversation.

Messages are rows (tree, node, parent, role, text, score). Every node learns its root, its depth and the sum of the scores
above it by self-joins that double their reach: after k rounds a node points 2^k replies up, so a thread of a million
messages takes twenty rounds. The jumps of each round are stored rows. Leaves are the ends of branches; a tree's branches
are ranked by mean score, then by length, and the chosen ones are spread over their messages by the same jumps, longest
first. Until then only keys, depths and scores are shuffled; the texts join at the end.

Template: ``[INST] user [/INST]``, ``<s>assistant</s>``, ``<<SYS>> system <</SYS>>``, and ``[ROLE] role [AS] text [/ROLE]``
for other roles. Inside texts a backslash is doubled and the first character of a control string gets a backslash after
it, so that no control string is left and the escape can be undone exactly.

Defined results: null texts and roles are empty; a message whose parent is missing begins a tree; messages on a cycle of
parents, or below one, are on no path; a message that is repeated (same tree and node) must be made distinct by the
caller, as ``thread_rows`` does; equal ranks go to the smaller node; an empty table gives no rows. A conversation is one
row, as long as its texts. A null tree is a tree. Columns besides these six are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored

#: Enough rounds for paths of 2^40 messages.
MOST_ROUNDS = 40
_CONTROL = r"<(?=/?s>|</?SYS>>)|\[(?=/?INST\]|/?ROLE\]|AS\])"
_SPEAKERS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>> ", " <</SYS>>")}
_OTHER = ("[ROLE] ", " [AS] ", " [/ROLE]")
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>> .*? <</SYS>>|\[ROLE\] .*? \[/ROLE\]"


def thread_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of linear conversations: each row replies to the one before it by turn (then role, then text, so that rows
    of one turn have an order, and repeated rows their places)."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(turn, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))  # a conversation becomes one row
    rows = turns.select(F.col(conv).alias("tree"), place.cast("long").alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(df: DataFrame, node: str = "node") -> Column:
    """Condition of a join with ``df`` (_tree, _node)."""
    return F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(node) == F.col("_node"))


def paths(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps, nodes). ``jumps[k]``: (_tree, _node, _to), 2^k replies up. ``nodes``: tree, node, depth (a root's is 1),
    total (score from the root), leaf, of every node under a root."""
    rows = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = rows.select(F.col("tree").alias("_tree"), F.col("node").alias("_node")).withColumn("_there", F.lit(True))
    rows = rows.join(known, _same(known, "parent"), "left").select("tree", "node", F.when(F.col("_there"), F.col("parent")).alias("to"), "score")
    # A row has summed ``depth`` messages from itself up; ``to`` is the first one above them, null past the root.
    now = stored(rows.select("tree", "node", "to", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "paths")
    replied = now.filter("to IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("to").alias("_node")).distinct().withColumn("_replied", F.lit(True))
    leaves = stored(now.select("tree", "node").join(replied, _same(replied), "left").select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("_replied").isNull().alias("leaf")), "leaves")
    jumps = []
    for _ in range(MOST_ROUNDS):
        open_ = now.filter("to IS NOT NULL")
        n = open_.count()
        if not n or (jumps and 2 ** len(jumps) > most):  # what is still open after more jumps than there are nodes goes round a cycle
            break
        most = n if not jumps else most
        jumps.append(stored(open_.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("to").alias("_to")), f"jumps-{len(jumps)}"))
        above = now.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("to").alias("_to"), F.col("depth").alias("_d"), F.col("total").alias("_t"))
        # Popular parents make the left side of this join uneven; adaptive execution splits it, as the right side has a row a key.
        step = open_.join(above, _same(above, "to")).select("tree", "node", F.col("_to").alias("to"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_t")).alias("total"))
        later = stored(now.filter("to IS NULL").union(step), "paths")
        dropped(now)
        now = later
    done = now.filter("to IS NULL")
    return jumps, done.join(leaves, _same(leaves)).select("tree", "node", "depth", "total", "leaf")


def best_branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, branch, depth, rank): the ``top`` leaves of each tree by mean score, then length, then node."""
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    return nodes.filter("leaf").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("tree", F.col("node").alias("branch"), "depth", "rank")


def path_rows(branches: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, branch, rank, node, place) for every message of the chosen branches; place 1 is the root.

    A row stands for the messages from its node up to ``2^k`` above; each round of jumps halves what a row stands for.
    """
    rows = branches.select("tree", "branch", "rank", F.col("branch").alias("node"), F.col("depth").alias("place"))
    for k in reversed(range(len(jumps))):
        up = jumps[k]
        above = rows.join(up, _same(up)).select("tree", "branch", "rank", F.col("_to").alias("node"), (F.col("place") - 2**k).alias("place"))
        rows = stored(rows.union(above), f"branch-rows-{k}")
    return rows


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), _CONTROL, "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _marks(which: int) -> Column:
    out = F.lit(_OTHER[0 if which == 0 else 2])
    if which == 0:
        out = F.concat(out, escaped(F.col("role")), F.lit(_OTHER[1]))
    for role, marks in _SPEAKERS.items():
        out = F.when(F.col("role") == role, F.lit(marks[which])).otherwise(out)
    return out


def format_paths(path: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, branch, rank, n_messages, formatted, loss): one conversation a branch. ``loss`` has the spans (start, stop,
    in code points of ``formatted``) of the assistant's texts, which a model is trained on."""
    texts = messages.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.coalesce("role", F.lit("")).alias("role"), "text")
    rows = path.join(texts, _same(texts)).select("tree", "branch", "rank", "place", _marks(0).alias("head"), escaped(F.col("text")).alias("body"), _marks(1).alias("tail"), (F.col("role") == "assistant").alias("learn"))
    piece = F.concat("head", "body", "tail")
    before = Window.partitionBy("tree", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("stop"))
    row = F.struct("place", piece.alias("piece"), F.when(F.col("learn"), span).alias("span"))
    out = rows.groupBy("tree", "branch", "rank").agg(F.array_sort(F.collect_list(row)).alias("r"))
    loss = F.filter(F.transform("r", lambda x: x["span"]), lambda s: s.isNotNull())
    return out.select("tree", "branch", "rank", F.size("r").cast("long").alias("n_messages"), F.array_join(F.transform("r", lambda x: x["piece"]), "").alias("formatted"), loss.alias("loss"))


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` branches of every tree, each as one conversation."""
    messages = stored(messages, "messages")
    jumps, nodes = paths(messages)
    return format_paths(path_rows(best_branches(nodes, top), jumps), messages)


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""

    def turn(t: Column) -> Column:
        inside = lambda head, tail: unescaped(F.substring(t, F.lit(len(head) + 1), F.length(t) - (len(head) + len(tail))))
        cut = F.position(F.lit(_OTHER[1]), t)
        role = unescaped(F.substring(t, F.lit(len(_OTHER[0]) + 1), cut - (len(_OTHER[0]) + 1)))
        text = unescaped(F.substring(t, cut + len(_OTHER[1]), F.length(t) - (cut + len(_OTHER[1]) + len(_OTHER[2]) - 1)))
        for name, (head, tail) in _SPEAKERS.items():
            mine = F.startswith(t, F.lit(head))
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inside(head, tail)).otherwise(text)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds turns, and learned: all text under the loss mask, unescaped, in order."""
    learned = F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int"))))
    return conversations.withColumn("turns", turns_of(F.col("formatted"))).withColumn("learned", F.array_join(learned, ""))


def digests(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    back = read_back(conversations)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
