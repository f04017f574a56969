"""Hard negatives in score windows that depend on each positive, by slot-decomposed selection.

The windows of an anchor's positives overlap, and each is the scores up to its own upper limit, cut off below. The upper
limits split the scores into disjoint slots, so a score is kept in one slot only. Tasks keep the best of every slot of
an anchor in their share of the rows, these are merged per slot, and the best of a window are those of its own and
all lower slots, of which the scores below its lower limit are dropped.

Anchors are a stated query set. Rows are dealt into groups of bounded size, and blocks of anchors run past the rows of
every group, so that neither the anchors nor the rows are ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.session import prepare
from alertmill.storage import materialize

BLOCK_ROWS = 4096  # rows of a block at most
BLOCK_VALUES = 1 << 18  # vector components of a block at most
GROUP_BLOCKS = 48  # blocks of a group on average
ANCHOR_ROWS = 512  # anchors of a block at most

PACKED = "kind int, block long, n int, ids binary, labels binary, vectors binary, limits binary, floors binary"
NAMES = [part.split()[0] for part in PACKED.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
ROWS, ANCHORS = 0, 1


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, v) of all rows that take part, one per id: its least label and, of that, least vector.

    Rows without id, label or vector, and vectors with a null or non-finite component, take no part.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    rows = good.select(F.col(id_col).cast("long").alias("vec_id"), F.struct(F.col(label_col).cast("long").alias("label"), x.cast("array<long>").alias("v")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def _share(value: Column, percent: int) -> Column:
    """``percent`` percent of a long, rounded down, without leaving the range of a long."""
    hundred = F.lit(100).cast("long")
    rest = F.pmod(value, hundred)
    whole = F.call_function("div", value - rest, hundred)
    return whole * percent + F.call_function("div", rest * percent, hundred)


def _packed(rows: DataFrame, kind: int, most: int, limits: int = 0) -> DataFrame:
    """Rows (vec_id, label, v[, upper, lower]) in blocks of bounded size, by label and id within a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            lists = batch.column("v")
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            first = 0
            while first < len(ids):
                stop = int(np.searchsorted(ends, ends[first] + BLOCK_VALUES, side="right")) - 1
                stop = min(max(stop, first + 1), first + most, len(ids))
                own = first + np.lexsort((ids[first:stop], labels[first:stop]))
                size = np.diff(ends)[own]
                width = int(size.max(initial=0))
                matrix = np.zeros((len(own), width), np.int64)
                row = np.repeat(np.arange(len(own)), size)
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                matrix[row, inside] = values[np.repeat(ends[own], size) + inside]
                columns = [np.array([kind], np.int32), ids[own[:1]], np.array([len(own)], np.int32), ids[own], labels[own], matrix]
                if limits:
                    columns += [np.array([batch.column(c)[int(k)].as_py() for k in own], np.int64) for c in ("upper", "lower")]
                else:
                    columns += [np.zeros(0, np.int64)] * 2
                raw = [pa.array([int(c[0])], t) if k < 3 else pa.array([c.tobytes()], t) for k, (c, t) in enumerate(zip(columns, TYPES, strict=True))]
                yield pa.RecordBatch.from_arrays(raw, names=NAMES)
                first = stop

    return rows.mapInArrow(pack, PACKED)


def _dealt(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Every group's blocks of rows, and after them the blocks of all anchors."""
    own = rows.withColumn("group", F.pmod(F.xxhash64("block", "n"), F.lit(groups)).cast("int"))
    every = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return own.unionByName(every).repartition(groups, "group").sortWithinPartitions("group", "kind", "block", "n")


class Block:
    """Packed rows, read back."""

    def __init__(self, row: dict):
        self.n = row["n"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        vectors = np.frombuffer(row["vectors"], np.int64).reshape(self.n, -1)
        small = not vectors.size or abs(int(vectors.min())) < 1 << 15 and int(vectors.max()) < 1 << 15
        self.vectors = vectors.astype(np.int16) if small else vectors
        self.norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        self.upper, self.lower = (np.frombuffer(row[c], np.int64).reshape(self.n, -1) if len(row[c]) else None for c in ("limits", "floors"))


def scores(one: Block, many: Block) -> np.ndarray:
    """Exact inner products: in floating point while every partial sum is an integer that it holds, else in integers.

    The shorter of two vectors counts as if zeros followed.
    """
    width = min(one.vectors.shape[1], many.vectors.shape[1])
    bound = one.norm * many.norm * 1.001
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return one.vectors[:, :width].astype(kind) @ many.vectors[:, :width].astype(kind).T


def least_of(kind: np.dtype):
    return -np.inf if kind.kind == "f" else np.iinfo(kind).min


class Best:
    """The ``k`` best (score, id) of every anchor of a block so far; higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.anchor, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)  # the k-th best score, where there are k

    def add(self, found: np.ndarray, ids: np.ndarray) -> None:
        """``found`` has the scores of all anchors with rows of ascending ``ids``, the least value for those that do not count."""
        none = least_of(found.dtype)
        none_yet = self.least == np.iinfo(np.int64).min
        at_least = np.where(none_yet, none, self.least.astype(found.dtype))[:, None]
        open_ = (found >= at_least) & (found > none)
        count = open_.sum(axis=1)
        for a in np.flatnonzero(count > 4 * self.k).tolist():  # so many that the k best are picked first
            where = np.flatnonzero(open_[a])
            own = found[a, where]
            cut = np.partition(own, -self.k)[-self.k]
            above, equal = where[own > cut], where[own == cut]
            open_[a] = False
            open_[a, above] = True
            open_[a, equal[: self.k]] = True
        anchor, row = np.nonzero(open_)
        if not len(anchor):
            return
        self.anchor = np.r_[self.anchor, anchor]
        self.score = np.r_[self.score, found[anchor, row].astype(np.int64)]
        self.id = np.r_[self.id, ids[row]]
        order = np.lexsort((self.id, -self.score, self.anchor))
        self.anchor, self.score, self.id = self.anchor[order], self.score[order], self.id[order]
        first = np.searchsorted(self.anchor, self.anchor)
        place = np.arange(len(self.anchor)) - first
        keep = place < self.k
        full = place == self.k - 1
        self.least[self.anchor[full]] = self.score[full]
        self.anchor, self.score, self.id = self.anchor[keep], self.score[keep], self.id[keep]


def _run(dealt: DataFrame, select: Callable[[Block, list[Block]], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """``select(anchors, rows of the group)`` for every block of anchors in every group."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("group", *NAMES)}
                if row["group"] != group:
                    group, held = row["group"], []
                if row["kind"] == ROWS:
                    held.append(Block(row))
                else:
                    yield from select(Block(row), held)

    return dealt.mapInArrow(walk, out)


def _positives(k: int) -> Callable:
    def select(anchors: Block, rows: list[Block]) -> Iterator[pa.RecordBatch]:
        best = Best(anchors.n, k)
        for block in rows:
            found = scores(anchors, block)
            none = least_of(found.dtype)
            for label in np.unique(anchors.labels).tolist():
                lo, hi = np.searchsorted(block.labels, [label, label + 1])
                if lo == hi:
                    continue
                mine = np.flatnonzero(anchors.labels == label)
                part = np.full((anchors.n, hi - lo), none, found.dtype)
                part[mine] = found[mine, lo:hi]
                part[anchors.ids[:, None] == block.ids[None, lo:hi]] = none
                best.add(part, block.ids[lo:hi])
        if len(best.anchor):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.ids[best.anchor], best.score, best.id)], names=["anchor_id", "score", "id"])

    return select


def _negatives(k: int) -> Callable:
    def select(anchors: Block, rows: list[Block]) -> Iterator[pa.RecordBatch]:
        slots = anchors.upper.shape[1]
        best = [Best(anchors.n, k) for _ in range(slots)]
        low = anchors.lower[:, 0]
        for block in rows:
            found, ids = scores(anchors, block), block.ids
            by_id = np.argsort(ids, kind="stable")
            found, ids, labels = found[:, by_id], ids[by_id], block.labels[by_id]
            none = least_of(found.dtype)
            in_reach = (found >= low[:, None]) & (found <= anchors.upper[:, :1]) & (anchors.labels[:, None] != labels[None, :])
            for slot in range(slots):
                below = found <= anchors.upper[:, slot : slot + 1]
                if slot + 1 < slots:
                    below &= found > anchors.upper[:, slot + 1 : slot + 2]
                best[slot].add(np.where(in_reach & below, found, none), ids)
        for slot, own in enumerate(best):
            if len(own.anchor):
                columns = [anchors.ids[own.anchor], np.full(len(own.anchor), slot, np.int32), own.score, own.id]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "score", "id"])

    return select


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for integer vectors.

    Anchors are the rows for which ``anchor`` (a condition on vec_id) holds. Scores are inner products, which must fit in a
    long. An anchor's positives are its best other rows of the same label; for each, the best rows of other labels whose score is
    between ``low`` and ``high`` percent of the positive's are returned. Higher scores come first, ties by smaller id. Of rows
    that repeat an id the one with the least label and vector counts; rows without id, label or a whole vector take no part,
    anchors without positives and positives without negatives give no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = materialize(usable(vectors, id_col, label_col, vector_col), "vectors")
    total = rows.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    groups = max(-(-blocks // GROUP_BLOCKS), min(blocks, spark.sparkContext.defaultParallelism))
    anchors = rows.where(anchor)
    packed = _packed(rows, ROWS, BLOCK_ROWS)

    first = _run(_dealt(packed, _packed(anchors, ANCHORS, ANCHOR_ROWS), groups), _positives(positives), "anchor_id long, score long, id long")
    in_order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id")
    ranked = first.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= positives)
    found = ranked.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
    upper = F.transform("positives", lambda p: _share(p["score"], high))
    lower = F.transform("positives", lambda p: -_share(-p["score"], low))
    limits = F.reverse(F.array_sort(F.array_distinct(upper)))
    found = materialize(found.select("anchor_id", "positives", limits.alias("limits"), F.array_min(lower).alias("least")), "positives")

    # the limits fill up to one width with ones below which nothing lies
    nothing = F.lit(-(1 << 62))
    fill = F.concat("limits", F.array_repeat(nothing, positives - F.size("limits")))
    bounded = found.select(F.col("anchor_id").alias("vec_id"), fill.alias("upper"), F.array(F.col("least")).alias("lower"))
    asked = _packed(anchors.join(bounded, "vec_id"), ANCHORS, ANCHOR_ROWS, limits=positives)
    near = _run(_dealt(packed, asked, groups), _negatives(negatives), "anchor_id long, slot int, score long, id long")
    in_slot = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    kept = near.withColumn("place", F.row_number().over(in_slot)).where(F.col("place") <= negatives)
    slots = kept.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id")).alias("kept"))

    one = found.join(slots, "anchor_id").select("anchor_id", "limits", "kept", F.explode("positives").alias("p"))
    one = one.withColumn("slot", F.array_position("limits", _share(F.col("p.score"), high)).cast("int") - 1)
    suffix = F.filter("kept", lambda x: x["slot"] >= F.col("slot"))
    merged = F.slice(F.array_sort(F.transform(suffix, lambda x: F.struct(x["minus"].alias("minus"), x["id"].alias("id")))), 1, negatives)
    good = F.filter(merged, lambda x: -x["minus"] >= -_share(-F.col("p.score"), low))
    opened = one.select("anchor_id", "p", F.posexplode(good).alias("at", "n"))
    return opened.select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), (-F.col("n.minus")).alias("negative_score"),
    )
