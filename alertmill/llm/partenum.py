"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Two sets whose sizes lie in one band and that are similar enough differ in at most k elements, k known for the
band. The feature domain is dealt into n > k partitions by a hash, pairs of them under a common first level,
and every set has one signature for each subset of a first-level group that leaves k2 partitions out: similar sets
agree on n - k partitions at least and so share a signature. Signatures only name candidates; every link is
decided on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.repeats import NO_ID
from alertmill.llm.scratch import Scratch
from alertmill.llm.textbytes import LOWER, WORD_BY_SPACE, Sums, lean, mixed, slices, word_hashes, words
from alertmill.storage import materialize

BAND_RATIO = 1.6  # greatest size of a band over that of the band before
# For sets that can differ in up to SMALL elements: partitions of a first-level group, and the most differences in it.
# Their signatures cover a large part of the set, so that one frequent passage does not make short texts candidates.
SMALL, SMALL_GROUP, SMALL_LEFT_OUT = 15, 6, 3
SPARE = 0.25  # further partitions in proportion, so that sets need no signature for partitions with few elements
CENTERS = 32  # members of a group compared with its later ones in the second round; the third takes this to the power of three
FIRST_ROUNDS = 1  # rounds over the share; what they leave open is among all signatures
FIRST_SHARE = 16  # of all signatures one in so many is looked at first: it joins most copies, so that the others stay out of pairs
HELD_PAIRS = 200_000  # pairs a task remembers so that it names them once
FINE_SKETCH = 300  # sets of up to so many elements have a sketch cell for every element, larger ones for every two
WANTED_BITS = 24  # of the bitmap that picks texts before they are shuffled, so it has one size
TASK_ROWS = 4096  # rows of the corpus for each task that writes a table, so that small ones are not dealt into hundreds of files
HELD_LINKS = 100_000  # links that one task resolves; more are resolved by rounds over the whole table

SIGNATURES = "signature long, set_a long"
SIGNATURE_NAMES = ["signature", "set_a"]
# What tells sets apart, and texts; ids do not, as they can be missing or repeated.
SET_KEY = ["n_shingles", "set_a", "set_b"]
TEXT_KEY = ["doc_id", "text_a", "text_b"]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of every row as ascending hashes, and the bounds of the rows in them.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    data = LOWER[data]
    start, end, firsts = words(data, offsets, WORD_BY_SPACE)
    count = np.diff(firsts)
    sums = Sums(word_hashes(data, start, end))
    grams = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), grams)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + firsts[row]
    value = sums.hashes(begin, np.minimum(begin + n, firsts[row + 1]))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        fresh = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]
        row, value = row[fresh], value[fresh]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def greatest_difference(size: int, percent: int) -> int:
    """How many elements two sets of up to that size can have apart and still be linked."""
    return 2 * size * (100 - percent) // (100 + percent)


def partitions(k: int) -> tuple[int, int, int, int]:
    """First-level groups, partitions in each, how many of them a signature leaves out, and partitions to spare.

    Some group has at most ``k // groups`` of the differences, so leaving that many partitions out gives a common
    signature. Large sets have groups of two: of all partitions more than ``spare`` agree. A set has no signature for
    partitions of up to m elements, m as great as it can be while at most ``spare`` of its partitions have so few. Of two
    similar sets take the one with the greater m: an agreeing partition has more elements than that, in both.
    """
    if k <= SMALL:
        groups = -(-(k + 1) // (SMALL_LEFT_OUT + 1))
        return groups, SMALL_GROUP, k // groups, -1
    groups = -(-(k + 1 + int(SPARE * k)) // 2)
    return groups, 2, 1, 2 * groups - k - 1


@lru_cache(maxsize=4)
def bands(upto: int, percent: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, greatest difference) of every band that needs signatures.

    A pair belongs to the band of its larger set; smaller sets that can be similar to one of the band take part.
    """
    rows, below, top = [], 0, 1
    while below < upto:
        if k := greatest_difference(top, percent):
            rows.append((-(-percent * (below + 1) // 100), top, k))
        below, top = top, max(top + 1, int(top * BAND_RATIO))
    return rows


def signatures(value: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets and the row of each."""
    size = np.diff(bounds)
    found, rows = [], []
    for band, (least, top, k) in enumerate(bands(1 << int(size.max(initial=0) * 2 + 1).bit_length(), percent)):
        own = np.flatnonzero((size >= least) & (size <= top))
        if not len(own):
            continue
        groups, width, left_out, spare = partitions(k)
        n, count = groups * width, size[own]
        at = np.repeat(bounds[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        element = value[at]
        cell = np.repeat(np.arange(len(own)) * n, count) + (mixed(element ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(n)).astype(np.int64)
        total = np.zeros(len(own) * n, dtype=np.uint64)
        np.add.at(total, cell, mixed(element))
        filled = np.bincount(cell, minlength=len(own) * n).reshape(len(own), n)
        few = np.full(len(own), -1)
        for m in range(max(0, spare) and int(filled.max(initial=0))):
            enough = (filled <= m).sum(axis=1) <= spare
            if not enough.any():
                break
            few[enough] = m
        weak = (filled <= few[:, None]).reshape(len(own), groups, width)
        total = total.reshape(len(own), groups, width)
        group = np.arange(groups, dtype=np.uint64)
        for subset in combinations(range(width), width - left_out):
            part, none = np.zeros(total.shape[:2], dtype=np.uint64), np.ones(total.shape[:2], dtype=bool)
            for member in subset:
                part = part + total[:, :, member] * np.uint64(2 * member + 1)
                none &= weak[:, :, member]
            name = mixed(np.uint64(band) << np.uint64(40) | group << np.uint64(8) | np.uint64(sum(1 << m for m in subset)))
            keep = ~none
            found.append(mixed(part ^ name[None, :])[keep])
            rows.append(np.broadcast_to(own[:, None], keep.shape)[keep])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


def sketch(value: np.ndarray) -> bytes:
    """Four bits for each of 2^b cells of the domain: the sum of what the set has there."""
    share = 1 if len(value) <= FINE_SKETCH else 2
    cells = 1 << max(4, (max(0, len(value) - 1) // share).bit_length())
    out = np.zeros(cells, dtype=np.uint8)
    code = mixed(value ^ np.uint64(0x3C3C3C3C3C3C3C3C))
    np.add.at(out, (code & np.uint64(cells - 1)).astype(np.int64), (code >> np.uint64(56)).astype(np.uint8))
    out &= 15
    return (out[: cells // 2] | out[cells // 2 :] << 4).tobytes()


def cells_of(drawn: bytes) -> np.ndarray:
    packed = np.frombuffer(drawn, np.uint8)
    return np.concatenate([packed & 15, packed >> 4])


def folded(sketches: np.ndarray, cells: int) -> np.ndarray:
    """Sketches (one per row) on fewer cells."""
    while sketches.shape[1] > cells:
        half = sketches.shape[1] // 2
        sketches = (sketches[:, :half] + sketches[:, half:]) & 15
    return sketches


def may_link(one: np.ndarray, size: int, many: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """False only where more cells differ than two linked sets of these sizes can have elements apart."""
    cells = min(len(one), many.shape[1])
    apart = np.count_nonzero(folded(many, cells) != folded(one[None, :], cells), axis=1)
    small, large = np.minimum(sizes, size), np.maximum(sizes, size)
    return (apart * (100 + percent) <= (sizes + size) * (100 - percent)) & (100 * small >= percent * large)


def _text_key() -> list[Column]:
    """A document's id and two 64-bit hashes of its text, as in ``TEXT_KEY``."""
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[c.alias(name) for c, name in zip(_text_key(), TEXT_KEY, strict=True)], F.coalesce("text", F.lit("")).alias("text"))


def set_digests(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of the hashed elements of every set."""
    sums = [np.r_[np.uint64(0), np.cumsum(mixed(x))] for x in (value, value ^ np.uint64(0x5851F42D4C957F2D))]
    return tuple(x[bounds[1:]] - x[bounds[:-1]] for x in sums)


def _set_rows(texts: DataFrame, n: int) -> DataFrame:
    """Size, 128-bit digest and sketch of the set of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text"):
                value, bounds = shingle_sets(data, offsets, n)
                digests = [pa.array(x.view(np.int64)) for x in set_digests(value, bounds)]
                made = [sketch(value[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                own = [batch.column(name)[first:stop] for name in TEXT_KEY]
                columns = [*own, pa.array(np.diff(bounds)), *digests, pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*TEXT_KEY, *SET_KEY, "sketch"])

    return texts.mapInArrow(lean(digest), ", ".join(f"{name} long" for name in [*TEXT_KEY, *SET_KEY]) + ", sketch binary")


def _signature_rows(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Signatures of all sets, each with half the digest of its set; equal sets in one slice are taken once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text"):
                value, bounds = shingle_sets(data, offsets, n)
                one, two = set_digests(value, bounds)
                own = np.sort(np.unique(np.stack([one, two], axis=1), axis=0, return_index=True)[1])
                count = np.diff(bounds)[own]
                ends = np.cumsum(count)
                value = value[np.repeat(bounds[own] - (ends - count), count) + np.arange(count.sum())]
                found, row = signatures(value, np.r_[0, ends], percent)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(one[own[row]].view(np.int64))], names=SIGNATURE_NAMES)

    return texts.select("text").mapInArrow(lean(sign), SIGNATURES)


def _by_signature(rows: DataFrame, then: str, tasks: int | None) -> DataFrame:
    """Rows with all those of a signature one after another in one task, ordered by ``then``; no more than ``tasks``."""
    dealt = rows.repartition("signature").sortWithinPartitions("signature", then)
    return dealt.coalesce(tasks) if tasks else dealt


def _shared(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Distinct rows of signatures that more than one set has, told by their neighbours in sorted order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        before: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            sig, own = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            fresh = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])]
            rows, sig = rows.filter(pa.array(fresh)), sig[fresh]
            same = sig[1:] == sig[:-1]
            keep = same | np.r_[before is not None and sig[0] == before, same[:-1]] if len(same) else same
            yield rows.slice(0, len(sig) - 1).filter(pa.array(keep, pa.bool_()))
            held = rows.slice(len(sig) - 1)
            if len(sig) > 1:
                before = sig[-2]
        if held is not None and before is not None and held.column(0)[0].as_py() == before:
            yield held

    return _by_signature(rows, "set_a", tasks).mapInArrow(lean(walk), SIGNATURES)


def _likely_pairs(groups: DataFrame, done: int, centers: int, percent: int, tasks: int | None = None) -> DataFrame:
    """Pairs (a, b) of members ``done`` to ``centers`` of every group with the later members of other components that sizes and
    sketches leave, and the components of both (of_a, of_b).

    ``groups`` are (signature, class_id, size, component, sketch). Members are taken in a fixed order and streamed, so a
    group is never held, only its centers are; pairs that are ruled out are not emitted.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        own: list[tuple[int, int, int, np.ndarray]] = []
        told: set[tuple[int, int]] = set()
        for batch in batches:
            sig, own_class, size, component = (batch.column(k).to_numpy() for k in range(4))
            sketches = batch.column(4).to_pylist()
            seen: dict[tuple[int, int], tuple[int, int]] = {}
            edges = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
            for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(sig)], strict=True):
                if sig[begin] != last:
                    last, rank, own = sig[begin], 0, []
                cells = 2 * min(map(len, sketches[begin:end]))
                many = np.concatenate([folded(cells_of(x)[None, :], cells) for x in sketches[begin:end]])
                ids, sizes, parts = own_class[begin:end], size[begin:end], component[begin:end]
                fresh = range(max(done, rank), min(centers, rank + end - begin))
                for center, other, of, drawn, after in [*((*c, 0) for c in own), *((ids[k - rank], sizes[k - rank], parts[k - rank], many[k - rank], k - rank + 1) for k in fresh)]:
                    open_ = after + np.flatnonzero(parts[after:] != of)
                    if len(open_):
                        hit = open_[may_link(drawn, other, many[open_], sizes[open_], percent)]
                        seen.update(((int(center), x), (int(of), part)) for x, part in zip(ids[hit].tolist(), parts[hit].tolist(), strict=True))
                own += [(ids[k - rank], sizes[k - rank], parts[k - rank], many[k - rank]) for k in fresh]
                rank += end - begin
            seen = {pair: of for pair, of in seen.items() if pair not in told}
            if seen:
                told = told | seen.keys() if len(told) < HELD_PAIRS else set(seen)
                both = zip(*(pair + of for pair, of in seen.items()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], names=["a", "b", "of_a", "of_b"])

    columns = ("signature", "class_id", "size", "component", "sketch")
    return _by_signature(groups.select(*columns), "class_id", tasks).mapInArrow(lean(pair), "a long, b long, of_a long, of_b long").distinct()


def _links(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Components (a, b) of the pairs whose whole sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            links = np.zeros(batch.num_rows, dtype=bool)
            for first, stop, data, offsets in slices(batch, "text_b"):
                value, bounds = shingle_sets(data, offsets, n)
                for k in range(first, stop):
                    a = batch.column("text_a")[k].as_py()
                    if a != kept[0]:
                        raw = a.encode()
                        kept = (a, shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), n)[0])
                    other = value[bounds[k - first] : bounds[k - first + 1]]
                    both = len(np.intersect1d(kept[1], other, assume_unique=True))
                    links[k] = 100 * both >= percent * (len(kept[1]) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(links)) for c in ("of_a", "of_b")], names=["a", "b"])

    two = texts.select(F.col("class_id").alias("b"), F.col("text").alias("text_b"))
    one = texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(two, "b").join(one, "a").select("of_a", "of_b", "text_a", "text_b").mapInArrow(lean(check), "a long, b long")


def components(nodes: DataFrame, links: DataFrame, node: str = "class_id", component: str = "component") -> DataFrame:
    """Least node reachable from every node of ``nodes`` over ``links`` (a, b), by hooking to least neighbours and pointer jumping.

    Each round takes the least label among a node's neighbours and then the label of that label, so a chain of n
    links takes about log2(n) rounds. Nothing is gathered on the driver but the number of changes.
    """
    labels = materialize(nodes.select(F.col(node).alias("v"), F.col(node).alias("label")), "labels")
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    while True:
        told = edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("told"))
        hooked = labels.join(told.withColumnRenamed("a", "v"), "v", "left").select("v", "label", F.least("label", F.coalesce("told", "label")).alias("new"))
        # a node's old label hears of the node's new one, and every label is then followed once
        pushed = hooked.where("new < label").groupBy(F.col("label").alias("v")).agg(F.min("new").alias("pushed"))
        merged = hooked.join(pushed, "v", "left").select("v", "label", F.least("new", F.coalesce("pushed", "new")).alias("new"))
        merged = materialize(merged, "labels")
        jumped = merged.join(merged.select(F.col("v").alias("new"), F.col("new").alias("far")), "new", "left")
        after = materialize(jumped.select("v", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("v", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("v").alias(node), F.col("label").alias(component))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Rows link when their sets of ``n``-word shingles have a Jaccard similarity of ``percent`` or more; component_id is the
    least doc_id reachable by links, the row's own included. Null and blank texts have an empty set and link with
    nothing; rows with equal sets are one class. A missing id counts as the smallest; rows without id or with a
    repeated one are told apart by their texts.
    """
    sets, classes, linked, tasks = _linked(docs, n, percent)
    least = classes.join(linked, "class_id").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = classes.join(linked.join(least, "component"), "class_id", "left")
    named = named.select(*SET_KEY, F.coalesce("least", "doc_id").alias("least"))
    found = sets.join(named, SET_KEY, "left")
    found = found.select(_id_of(F.col("doc_id")).alias("doc_id"), "n_shingles", _id_of(F.coalesce("least", "doc_id")).alias("component_id"))
    return found.coalesce(tasks)


def one_of_each_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, of each component the one with the smallest id (no id is smallest) and, among those, least text hash.

    Rows without words are components of their own; rows that repeat both id and text are one.
    """
    sets, classes, linked, tasks = _linked(docs, n, percent)
    own = F.coalesce("component", "class_id").alias("component")
    first = classes.join(linked, "class_id", "left").groupBy(own).agg(F.min(F.struct(*TEXT_KEY)).alias("first"))
    kept = first.select("first.*").unionByName(sets.where("n_shingles = 0").select(*TEXT_KEY).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(name) for c, name in zip(_text_key(), TEXT_KEY, strict=True)])
    return rows.join(kept, TEXT_KEY, "left_semi").dropDuplicates(TEXT_KEY).select("_row.*").coalesce(tasks)


def _linked(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Sets of all rows, the classes of equal ones with their first text, the components of the classes that links join, and how
    many tasks write a table of that many rows.

    The key of a class is its 128-bit digest and size; class_id is a number given out for each key.
    """
    texts = _texts(docs)
    written = Scratch(docs.sparkSession)
    drawn = written.write(_set_rows(texts, n), "sets")
    written.tasks = max(docs.sparkSession.sparkContext.defaultParallelism, drawn.count() // TASK_ROWS)
    first = drawn.where("n_shingles > 0").groupBy(*SET_KEY).agg(F.min(F.struct(*TEXT_KEY)).alias("first"), F.first("sketch").alias("sketch"))
    classes = written.write(first.select(*SET_KEY, "first.*", "sketch", F.monotonically_increasing_id().alias("class_id")), "classes")
    sets = written.write(drawn.drop("sketch"), "set-keys")
    written.drop(drawn)
    return sets, classes.drop("sketch"), class_components(texts, classes, n, percent, written.tasks), written.tasks


def _id_of(value: Column) -> Column:
    return F.when(value != NO_ID, value)


def class_components(texts: DataFrame, classes: DataFrame, n: int, percent: int, tasks: int | None = None) -> DataFrame:
    """(class_id, component) of all classes that links join with another; ``tasks`` at most write each table.

    A share of the signatures is looked at first, for ``FIRST_ROUNDS``, and then all of them. Each round compares some members of
    every group of a signature with its later members, unless links that are known already join them; a group is done when
    all its members are joined or have been compared.
    """
    written = Scratch(texts.sparkSession, tasks)
    # classes that agree in half of the digest only both take its signatures
    member = classes.select("set_a", "class_id", F.col("n_shingles").cast("int").alias("size"))
    groups = written.write(_shared(_signature_rows(texts, n, percent), tasks).join(member, "set_a").select("signature", "class_id", "size"), "groups")
    written.release()
    labels: DataFrame | None = None
    share = F.pmod("signature", F.lit(FIRST_SHARE)) == 0
    for part, rounds in ((groups.where(share), FIRST_ROUNDS), (groups, None)):
        done, upto, current, turn = 0, 1, part, 0
        while turn != rounds:
            turn += 1
            if labels is None and not done:  # each class is a component of its own, and every group has two
                current = part.withColumn("component", F.col("class_id"))
            else:
                before, current = current, written.write(_open_groups(current, labels, done + 1), "open")
                written.drop(before)
            if current.isEmpty():
                break
            likely = written.write(_likely_pairs(current.join(classes.select("class_id", "sketch"), "class_id"), done, upto, percent, tasks), "likely")
            written.release()
            if not likely.isEmpty():
                chosen = _texts_of(likely, classes, texts, written)
                links = written.write(_links(likely, chosen, n, percent), "links")
                written.drop(chosen)
                if not links.isEmpty():
                    old, labels = labels, written.write(_relabelled(labels, links, written), "labels")
                    written.drop(old)
                written.drop(links)
            written.drop(likely)
            done, upto = upto, upto * CENTERS**turn
        written.drop(current)
    written.drop(groups)
    return labels if labels is not None else texts.sparkSession.createDataFrame([], "class_id long, component long")


def _open_groups(groups: DataFrame, labels: DataFrame | None, compared: int) -> DataFrame:
    """Members, with their components, of the groups of more than ``compared`` members that are not all in one component."""
    own = Window.partitionBy("signature")
    named = groups.select("signature", "class_id", "size")
    named = named.join(labels, "class_id", "left") if labels is not None else named.withColumn("component", F.lit(None).cast("long"))
    named = named.withColumn("component", F.coalesce("component", "class_id"))
    found = {"low": F.min("component").over(own), "high": F.max("component").over(own), "members": F.count(F.lit(1)).over(own)}
    return named.withColumns(found).where(f"low < high AND members > {compared}").drop(*found)


def _picked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose text hash has the low bits of a wanted one: few others, so that the corpus is not shuffled for a few texts."""
    low = F.pmod(F.col("text_a"), F.lit(1 << WANTED_BITS)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(low).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits")).collect()
    bits = np.zeros(1 << WANTED_BITS, dtype=bool)
    for row in maps:
        own = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        at = (row["bucket"] - 1) * len(own)
        bits[at : at + len(own)] = own
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.arrow_udf("boolean")
    def asked(keys: pa.Array) -> pa.Array:
        slot = keys.to_numpy(zero_copy_only=False) & ((1 << WANTED_BITS) - 1)
        return pa.array((sent.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1)

    return texts.where(asked("text_a"))


def _texts_of(pairs: DataFrame, classes: DataFrame, texts: DataFrame, written: Scratch) -> DataFrame:
    """The first texts of the classes in ``pairs``, written once for both sides."""
    ids = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct()
    first = written.write(classes.join(ids, "class_id").select(*TEXT_KEY, "class_id"), "pair-ids")
    found = written.write(_picked(texts, first).join(first, TEXT_KEY).dropDuplicates(TEXT_KEY).select("class_id", "text"), "pair-texts")
    written.drop(first)
    return found


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the least node reachable from each."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    ends, label = at.reshape(2, len(a)), np.arange(len(nodes))
    while True:
        new = label.copy()
        for one in label[ends]:
            np.minimum.at(new, one, label[ends].min(axis=0))
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _least_of(links: DataFrame, written: Scratch) -> DataFrame:
    """(component, least) of all components that the links join.

    Each task first reduces its own links to one for each node; while few are left, one task resolves them.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches if batch.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*np.concatenate(held, axis=1))], names=["component", "least"])

    if links.count() <= HELD_LINKS:
        return written.write(links.coalesce(1).mapInArrow(lean(resolve), "component long, least long"), "joined")
    joined = written.write(links.mapInArrow(lean(resolve), "component long, least long").select(F.col("component").alias("a"), F.col("least").alias("b")), "forests")
    nodes = joined.select(F.col("a").alias("class_id")).distinct()
    return components(nodes, joined, component="least").withColumnRenamed("class_id", "component")


def _relabelled(labels: DataFrame | None, links: DataFrame, written: Scratch) -> DataFrame:
    """Labels after all links between components; a class without a label is a component of its own."""
    found = _least_of(links, written)
    known = found.select(F.col("component").alias("class_id"), "component")
    known = known if labels is None else known.unionByName(labels).distinct()
    return known.join(found, "component", "left").select("class_id", F.coalesce("least", "component").alias("component"))
