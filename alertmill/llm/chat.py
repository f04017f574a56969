"""Chat formatting of reply trees, with DataFrame functions only.

Every message answers at most one other of its tree. Root-to-leaf paths are enumerated by self-joins that double
the distance each time, branches are ranked by their scores, and each chosen path becomes one text with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.storage import materialize

# The template: a turn is OPEN, role, newline, text, CLOSE. In roles and texts "\" becomes "\b" and "<" becomes
# "\l", and in roles a newline becomes "\n", so no message can hold a control string.
OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def linear_replies(messages: DataFrame, tree_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """``messages`` (conv_id, turn, role, text) as trees in which each message answers the one before it.

    Rows of one turn follow each other by role and text; repeated rows are all kept. Rows without tree id share
    one tree, rows without turn come first.
    """
    order = Window.partitionBy(tree_col).orderBy(F.col(order_col).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = messages.select(tree_col, order_col, "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.col(tree_col).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, distance, node) for every node on the path from each leaf up to its root.

    ``nodes`` are (tree, node, parent), a written table. A reply has a greater id than what it answers, so a parent
    that is not smaller, or does not exist, ends the path. Join k follows pointers over 2^k replies, so a tree
    of depth d takes log2(d) rounds.
    """
    keys = nodes.select("tree", "node", F.when(F.col("parent") < F.col("node"), F.col("parent")).alias("parent"))
    parents = keys.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    leaves = _kept(keys, parents, "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("distance"), "node")
    exists = keys.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    jump = (
        keys.where(F.col("parent").isNotNull())
        .join(exists, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left_semi")
        .select(F.col("tree").alias("jt"), F.col("node").alias("jn"), F.col("parent").alias("up"))
        .distinct()
    )
    paths, jump, reach = materialize(paths, "paths"), materialize(jump, "jump"), 1
    while not jump.isEmpty():
        further = paths.join(jump, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("node") == F.col("jn"))).select(
            "tree", "leaf", (F.col("distance") + reach).alias("distance"), F.col("up").alias("node")
        )
        paths = materialize(paths.unionByName(further), "paths")
        second = jump.select(F.col("jt").alias("t2"), F.col("jn").alias("n2"), F.col("up").alias("up2"))
        jump = jump.join(second, F.col("jt").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2"))).select("jt", "jn", F.col("up2").alias("up"))
        reach *= 2
        jump = materialize(jump, "jump")
    return paths


def _kept(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    other = keys.select(F.col("tree").alias("kt"), F.col("node").alias("kn"))
    return rows.join(other, F.col("tree").eqNullSafe(F.col("kt")) & (F.col("node") == F.col("kn")), how)


def chosen_branches(paths: DataFrame, nodes: DataFrame, per_tree: int) -> DataFrame:
    """The ``per_tree`` best paths of each tree by mean score (ties: more replies, then the smaller leaf id)."""
    scores = nodes.select(F.col("tree").alias("st"), F.col("node").alias("sn"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = paths.join(scores, F.col("tree").eqNullSafe(F.col("st")) & (F.col("node") == F.col("sn")))
    branches = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean_score"), F.max("distance").alias("depth"))
    best = Window.partitionBy("tree").orderBy(F.desc("mean_score"), F.desc("depth"), "leaf")
    return branches.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= per_tree)


def format_branches(paths: DataFrame, chosen: DataFrame, nodes: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, branch, mean_score, n_turns, formatted text and loss_spans.

    A loss span is the [start, end) of one text of ``loss_role`` in code points of the formatted text.
    """
    picked = chosen.select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "branch", "mean_score")
    said = nodes.select(F.col("tree").alias("nt"), F.col("node").alias("nn"), "role", "text")
    turns = (
        paths.join(picked, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl")))
        .join(said, F.col("tree").eqNullSafe(F.col("nt")) & (F.col("node") == F.col("nn")))
        .select("tree", "leaf", "branch", "mean_score", (-F.col("distance")).alias("at"), escape_role(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    )
    own = F.length("head") + F.length("body") + len(OPEN) + 1 + len(CLOSE)
    path = Window.partitionBy("tree", "leaf").orderBy("at")
    placed = turns.withColumn("end", F.sum(own).over(path.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE)).withColumn("start", F.col("end") - F.length("body"))
    row = F.struct("at", F.concat(F.lit(OPEN), F.col("head"), F.lit("\n"), F.col("body"), F.lit(CLOSE)).alias("turn"), F.when(F.col("head") == loss_role, F.struct("start", "end")).alias("span"))
    gathered = placed.groupBy("tree", "leaf", "branch", "mean_score").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return gathered.select(
        "tree", "leaf", "branch", "mean_score",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.col("rows.turn"), "").alias("formatted"),
        F.filter(F.col("rows.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_reply_trees(nodes: DataFrame, per_tree: int = 1, loss_role: str = "assistant") -> DataFrame:
    """Format the best paths of the reply trees in ``nodes`` (tree, node, parent, score, role, text).

    Null roles and texts are empty, null scores 0; an empty table gives none. Node ids are unique within a tree.
    """
    nodes = materialize(nodes.select("tree", "node", "parent", "score", "role", "text"), "nodes")
    paths = root_to_leaf_paths(nodes)
    return format_branches(paths, chosen_branches(paths, nodes, per_tree), nodes, loss_role)


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(body, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))
