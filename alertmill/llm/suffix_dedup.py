"""Exact removal of repeated byte strings by sparse prefix doubling.

A suffix array orders positions by rank pairs at growing offsets until they are unique or agree past the threshold.
Here the positions are content anchors instead of all bytes: equal strings of the threshold's length hold the
same anchor at the same place. Round one sorts anchors by the rank of their core and drops unique ones, the second
key of the same sort is the rank of the hull past the threshold; what is neither unique nor past it goes on
with every single position, as pairs of the ranks of both halves of the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.repeats import LOW_BITS, NO_ID, SEGMENT_NAMES, SEGMENT_TYPES, SEGMENTS, first_window, further_windows, keyed, segment_rows, settle, span_columns
from alertmill.llm.textbytes import Sums, byte_codes, joined_runs, slices
from alertmill.storage import materialize

# Windows that can share an anchor; the core is the threshold less this, plus one.
SPREAD = 100
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[Sums, np.ndarray]:
    return Sums(byte_codes()[data]), offsets


def _positions(length: int, earlier: DataFrame) -> DataFrame:
    """Every single position of the open segments, as the pair of ranks of its two halves."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = length // 2
        for batch in batches:
            places = batch.column("places")
            for first, stop, data, offsets in slices(batch, "text"):
                sums = Sums(byte_codes()[data])
                lists = places[first:stop]
                count = np.diff(lists.offsets.to_numpy())
                packed = lists.flatten().to_numpy()
                row = np.repeat(np.arange(stop - first), count)
                more = further_windows(packed) + 1
                begin = np.repeat(first_window(packed) + offsets[row], more)
                start = begin + np.arange(len(begin)) - np.repeat(np.cumsum(more) - more, more)
                row = np.repeat(row, more)
                ids, part = (batch.column(c)[first:stop].to_numpy()[row] for c in ("doc_id", "part"))
                pair = (sums.hashes(start, start + half).view(np.int64), sums.hashes(start + half, start + length).view(np.int64))
                columns = [*pair, ids, part, (start - offsets[row]) << LOW_BITS]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SEGMENT_TYPES, strict=True)], names=SEGMENT_NAMES)

    return earlier.mapInArrow(expand, SEGMENTS)


def _removed(texts: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts, ends in zip(*(batch.column(c) for c in ("doc_id", "text", "starts", "ends")), strict=True):
                raw = (text.as_py() or "").encode()
                if not starts.is_valid:
                    out.append((doc.as_py(), len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []))
                    continue
                begin, end = joined_runs(starts.values.to_numpy(), ends.values.to_numpy())
                edges, kept, at = [], hashlib.sha256(), 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.update(raw[at:a])
                    at = b
                    edges.append({"start": a, "end": b})
                kept.update(raw[at:])
                out.append((doc.as_py(), len(raw), int((end - begin).sum()), len(edges), kept.hexdigest(), edges))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.mapInArrow(cut, RESULT)


def remove_repeated_bytes(docs: DataFrame, length: int = 200, spread: int = SPREAD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and the removed spans.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else as well, in this document or
    another; strings are judged on the input. Null texts are empty, nothing repeats in texts shorter than ``length``,
    equal texts of that length or more are removed whole, and each row keeps its own result. Other columns of
    ``docs`` are not read.
    """
    texts = keyed(docs)
    settled = materialize(settle(segment_rows(texts, _bytes, length, spread, earlier_only=False), earlier_only=False), "segments")
    looked = settled.where("open").groupBy("doc_id", "part").agg(F.collect_list("place").alias("places"))
    single = settle(_positions(length, texts.join(looked, ["doc_id", "part"])), earlier_only=False).where("NOT open")
    start, end = span_columns(length)
    spans = settled.where("NOT open").unionByName(single).select("doc_id", "part", start.alias("start"), end.alias("end"))
    lists = spans.groupBy("doc_id", "part").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    result = _removed(texts.join(lists, ["doc_id", "part"], "left"))
    return result.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
