"""Merkle manifest of a dataset: a tree of SHA-256 digests per group, and a root over the groups.

Nodes of a level are numbered within their group. Each aligned block of ``BLOCK`` nodes keeps a level as one string
of hex digests; substrings of fixed width are hashed to the next level, and what flanks a node in its run of
``ARITY`` is the sibling part of its proof. The tops of the blocks are the nodes of the next round, and
the roots of the groups are put together in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.storage import materialize

ARITY_BITS, LEVELS = 3, 3  # nodes hashed together, and levels of a block, as powers of two and of that
ARITY = 1 << ARITY_BITS
BLOCK = 1 << ARITY_BITS * LEVELS
HEX = 64
RUN = ARITY * HEX
SEGMENT = "array<struct<left:string,right:string>>"


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def field(value: Column) -> Column:
    """A value so that no two rows read alike: ``-`` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


@dataclass
class Tree:
    rounds: list[DataFrame]  # blocks of each round, leaves first
    roots: DataFrame  # (key, digest) of every group


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``position`` (from 0 within their key, by ``order``) and ``total`` (nodes of the key).

    Rows are range-sorted and written once, so a key may hold any share of them; positions come from the counts of a
    key in each sorted part. Rows that do not differ in ``order`` are told apart by their place in the input.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = nodes.withColumn("_tie", F.monotonically_increasing_id())
    by = ["key", *order, "_tie"]
    ranged = numbered.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    table = materialize(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "manifest-sorted")
    counts = table.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("key")).alias("total"))
    joined = table.join(counts, ["key", "_part"])
    return joined.withColumn("position", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _raised(level: Column) -> Column:
    """The string of the level above."""
    runs = F.ceil(F.length(level) / RUN).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda k: digest(F.substr(level, k * RUN + 1, F.lit(RUN)))), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per aligned block of (key, position, total, digest, carry): its nodes in order and the strings of its levels.

    ``levels`` is how many of them are used: all, unless the block is the only one of its key and comes to one node sooner.
    """
    grouped = nodes.groupBy("key", "total", F.expr(f"position div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", "digest", "carry"))).alias("nodes"))
    own = F.coalesce(*[F.when(F.col("total") <= ARITY**k, F.lit(k)) for k in range(LEVELS)], F.lit(LEVELS))
    made = grouped.select("*", own.alias("levels"), F.array_join(F.col("nodes.digest"), "").alias("level_0"))
    for k in range(LEVELS):
        made = made.withColumn(f"level_{k + 1}", _raised(F.col(f"level_{k}")))
    top = F.element_at(F.array(*[F.col(f"level_{k}") for k in range(LEVELS + 1)]), F.col("levels") + 1)
    return made.withColumn("top", top).drop(f"level_{LEVELS}")


def build(nodes: DataFrame) -> Tree:
    """The tree over (key, position, total, digest, carry).

    Every round leaves one node for a block, and the number of rounds is that of the largest key; a key whose only
    block is done early has its root from then on.
    """
    rounds, roots = [], None
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        blocks = materialize(_blocks(nodes), "manifest-blocks")
        rounds.append(blocks)
        done = blocks.where(f"total <= {BLOCK}").select("key", F.col("top").alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= BLOCK:
            return Tree(rounds, roots)
        nodes = blocks.where(f"total > {BLOCK}").select(
            "key", F.col("block").alias("position"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("carry")
        )
        most = -(-most // BLOCK)


def _segments(at: Column) -> Column:
    """What flanks the node at place ``at`` of a block, level by level."""
    out = []
    for k in range(LEVELS):
        node = F.shiftright(at, ARITY_BITS * k)
        run = F.substr(F.col(f"level_{k}"), F.shiftright(node, ARITY_BITS) * RUN + 1, F.lit(RUN))
        inside = node.bitwiseAND(ARITY - 1) * HEX
        out.append(F.struct(F.substr(run, F.lit(1), inside).alias("left"), F.substr(run, inside + HEX + 1, F.lit(RUN)).alias("right")))
    return F.slice(F.array(*out), F.lit(1), F.col("levels"))


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """(key, position, digest, carry, proof, given) of every leaf; ``above`` has (key, proof, given) of every group.

    ``proof`` holds the siblings to the left and right on every level from the leaf up. It is passed down from block
    to block, so only rows of blocks are joined; leaves come out of their block.
    """
    path = None
    for blocks in reversed(tree.rounds):
        single, several = blocks.where(f"total <= {BLOCK}"), blocks.where(f"total > {BLOCK}")
        joined = single.join(above, "key")
        if path is not None:
            inner = path.select("key", F.col("position").alias("block"), "proof", "given")
            joined = joined.unionByName(several.join(inner, ["key", "block"]).select(joined.columns))
        opened = joined.select("*", F.posexplode("nodes").alias("at", "node")).drop("nodes")
        path = opened.select("key", "node.position", "node.digest", "node.carry", F.concat(_segments(F.col("at")), F.col("proof")).cast(SEGMENT).alias("proof"), "given")
    return path


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(proof, start, lambda own, s: digest(F.concat(s["left"], own, s["right"])))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(leaves: DataFrame, group_col: str = "lang", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``leaves`` (the group, the order columns, leaf, carry): carry, leaf, subroot, root and proof.

    A group's leaves ascend by ``order`` (null first), ties by digest; while it has several nodes, every ``ARITY``
    consecutive ones become the digest of their concatenation, and what is left is its subroot. The subroots, by group
    (null first, bytewise), become the root in the same way. ``carry`` is a string handed through. Repeated rows are leaves of
    their own; an empty table gives no rows.
    """
    # sorts like the group, null first, and is never null
    key = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    names = [f"_by_{k}" for k in range(len(order))]
    nodes = leaves.select(key.alias("key"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], F.col("leaf").alias("digest"), "carry")
    below = build(placed(nodes, [*names, "digest"]).drop(*names))
    roots = materialize(below.roots, "manifest-roots")
    upper = roots.select(F.lit("").alias("key"), F.col("key").alias("_by_0"), "digest", F.col("key").alias("carry"))
    over = build(placed(upper, ["_by_0"]).drop("_by_0"))
    top = over.roots.select("key", F.array().cast(SEGMENT).alias("proof"), F.struct(F.lit("").alias("subroot"), F.col("digest").alias("root")).alias("given"))
    above = proofs(over, top).select(F.col("carry").alias("key"), "proof", F.struct(F.col("digest").alias("subroot"), F.col("given.root").alias("root")).alias("given"))
    above = materialize(above, "manifest-top")
    return proofs(below, above).select("carry", F.col("digest").alias("leaf"), "given.subroot", "given.root", "proof")
