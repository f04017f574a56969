"""Repeated windows of bytes or words, found by ranking content-anchored segments.

All windows of a text that share an anchor (``textbytes.windows_by_anchor``) form a segment. A segment has the hash
of its core, which every one of its windows contains, and of its hull, which contains them all. Rows are sorted
by (core, hull): a core that is alone has no repeated window, a repeated hull has only repeated ones, and just
the segments in between, at the ends of repeated passages, are looked at window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.textbytes import slices, windows_by_anchor

# Stands for a missing document id; it sorts before all others.
NO_ID = -(1 << 63)
# A place holds a segment's first window, the number of further ones, and what the scan has found out about it:
# nothing, that its hull is repeated (it stands for the others of its slice), or that it needs no comparison any more.
STATE_BITS, MORE_BITS = 2, 8
LOW_BITS = STATE_BITS + MORE_BITS
REPEATED, SETTLED = 1, 2

SEGMENTS = "core long, hull long, doc_id long, part int, place long"
SEGMENT_NAMES = ["core", "hull", "doc_id", "part", "place"]
SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, text): texts without null, and ``part`` to tell rows apart that repeat an id with another text."""
    texts = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    unique = texts.groupBy("doc_id").count().where("count > 1").isEmpty()
    return texts.withColumn("part", F.lit(0) if unique else F.hash("text")).select("doc_id", "part", "text")


def first_window(place):
    return place >> LOW_BITS


def further_windows(place):
    return (place >> STATE_BITS) & ((1 << MORE_BITS) - 1)


def span_columns(length: int) -> tuple[Column, Column]:
    """Start and end of all units in the windows of a segment, from its place."""
    start = F.shiftright("place", LOW_BITS)
    return start, start + F.shiftright("place", STATE_BITS).bitwiseAND((1 << MORE_BITS) - 1) + length


def _settled_here(core: np.ndarray, hull: np.ndarray, doc: np.ndarray, earlier_only: bool) -> np.ndarray:
    """States of the rows of one slice, so that a frequent hull is sent on once per slice and not once per row."""
    order = np.lexsort((doc, hull, core))
    same = (core[order][1:] == core[order][:-1]) & (hull[order][1:] == hull[order][:-1])
    state = np.zeros(len(core), dtype=np.int64)
    if not same.any():
        return state
    first = np.flatnonzero(np.r_[True, ~same])
    run = np.cumsum(np.r_[True, ~same]) - 1
    if earlier_only:
        state[order] = np.where(doc[order] > doc[order][first][run], SETTLED, 0)
    else:
        state[order[np.r_[False, same]]] = SETTLED
        state[order[first[np.diff(np.r_[first, len(core)]) > 1]]] = REPEATED
    return state


def segment_rows(texts: DataFrame, units: Callable, length: int, spread: int, earlier_only: bool) -> DataFrame:
    """Segments of all windows of ``length`` units; ``units(data, offsets)`` gives (running sums, bounds of the rows)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text"):
                sums, bounds = units(data, offsets)
                row, begin, last, _, core = windows_by_anchor(sums, bounds, length, spread)
                if not len(row):
                    continue
                hull = sums.hashes(begin, last + length)
                ids = batch.column("doc_id")[first:stop].to_numpy()[row]
                part = batch.column("part")[first:stop].to_numpy()[row]
                state = _settled_here(core, hull, ids, earlier_only)
                place = ((begin - bounds[row]) << LOW_BITS) | ((last - begin) << STATE_BITS) | state
                columns = [core.view(np.int64), hull.view(np.int64), ids, part, place]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SEGMENT_TYPES, strict=True)], names=SEGMENT_NAMES)

    return texts.mapInArrow(cut, SEGMENTS)


def settle(rows: DataFrame, earlier_only: bool) -> DataFrame:
    """Sort ``rows`` (as ``SEGMENTS``) by rank pair and sort out repeated ones, keeping one run in memory at most in part.

    Rows come out with ``open`` false if their hull is repeated (with ``earlier_only``: in a document of a smaller
    id), and with ``open`` true if only their core is, so that their windows have to be looked at; of a repeated
    hull one row stands for all (with ``earlier_only``: those of its first document). Other rows are dropped.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t.to_pandas_dtype()) for t in SEGMENT_TYPES] + [np.zeros(0, bool)]
        before: int | None = None  # core of the run before the held rows
        empty = True

        def out(rows: list[np.ndarray], pick: np.ndarray, is_open: bool) -> pa.RecordBatch:
            arrays = [pa.array(c[pick], t) for c, t in zip(rows[:5], SEGMENT_TYPES, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(pick), is_open))], names=[*SEGMENT_NAMES, "open"])

        def runs(rows: list[np.ndarray], final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, before
            core, hull, doc, _, place, done = rows
            n = len(core)
            new_core = np.r_[True, core[1:] != core[:-1]]
            new_hull = new_core | np.r_[True, hull[1:] != hull[:-1]]
            first = np.flatnonzero(new_hull)
            size = np.diff(np.r_[first, n])
            complete = len(first) if final else len(first) - 1
            run = np.cumsum(new_hull) - 1
            if earlier_only:
                repeated = doc > doc[first][run]
                stands = ~repeated
            else:
                several = (size > 1) | done[first] | (place[first] & REPEATED > 0)
                repeated = several[run]
                stands = np.zeros(n, bool)
                stands[first] = True
            closes = np.flatnonzero(repeated & ~done)
            if len(closes):
                yield out(rows, closes, False)
            opens_core = new_core[first]
            opens_core[0] = before is None or core[0] != before
            alone = opens_core & np.r_[opens_core[1:], True]
            wanted = np.flatnonzero(stands & ~alone[run] & (run < complete))
            if len(wanted):
                yield out(rows, wanted, True)
            if complete:
                before = int(core[first[complete - 1]])
            if not final:
                at = first[-1]
                keep = at + np.flatnonzero(stands[at:])
                held = [c[keep] for c in rows]
                held[5] = repeated[keep] if not earlier_only else held[5]

        for batch in batches:
            if batch.num_rows:
                fresh = [batch.column(name).to_numpy() for name in SEGMENT_NAMES]
                over = fresh[4] & SETTLED > 0
                if over.any():
                    yield out(fresh, np.flatnonzero(over), False)
                    fresh = [c[~over] for c in fresh]
                if not len(fresh[0]):
                    continue
                fresh.append(np.zeros(len(fresh[0]), bool))
                empty = False
                yield from runs([np.concatenate([a, b]) for a, b in zip(held, fresh, strict=True)], False)
        if not empty:
            yield from runs(held, True)

    # rows that need no comparison go anywhere; the others meet by their core
    route = F.when(F.col("place").bitwiseAND(SETTLED) > 0, F.xxhash64("doc_id", "place")).otherwise(F.col("core"))
    return rows.repartition(route).sortWithinPartitions("core", "hull", "doc_id", "part", "place").mapInArrow(walk, SEGMENTS + ", open boolean")

