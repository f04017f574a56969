"""Packing of token sequences: documents are cut into pieces and the pieces share sequences of a fixed capacity.

Only the number of pieces of each length decides the packing, so it is planned on that histogram (at most one
entry per length up to the capacity, whatever the number of documents) and every piece then finds its place
from its own number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.textbytes import give_back, lean, slices
from alertmill.llm.tokens import encoder
from alertmill.storage import materialize

WORK_BYTES = 1 << 18  # bytes of text encoded at once; a longer text is taken alone
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: only the first may be shorter than the capacity."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with the checksum of their ids; a null text is empty and has the end id only.

    ``task`` and ``number`` tell the pieces of one length apart: ``number`` counts them within the writing task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text", WORK_BYTES):
                ids, at = code.encode(data, offsets)
                raw, rows = memoryview(ids.tobytes()), []
                for k, doc in enumerate(batch.column("doc_id")[first:stop].to_pylist()):
                    tokens = raw[at[k] * 4 : at[k + 1] * 4]
                    n, start = len(tokens) // 4 + 1, 0
                    for piece, length in enumerate(cut_lengths(n, capacity)):
                        crc = zlib.crc32(tokens[start * 4 : (start + length) * 4])
                        start += length
                        rows.append((doc, piece, start - length, length, zlib.crc32(end, crc) if start == n else crc, task, int(seen[length])))
                        seen[length] += 1
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
            give_back()  # what encoding has freed: about 100 MB in a worker

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), PIECES)


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first piece, pieces, first bin, pieces per bin, offset) that place all pieces.

    Pieces above a third of the capacity are matched first: longest to shortest, each with the longest other that
    still fits, so a bin holds two of them at most. Shorter pieces, longest first, go into the smallest gap that
    takes them and open a bin only when no gap does. Bins alike are handled together.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    placed = dict.fromkeys(left, 0)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> bins (first, number)
    sizes: list[int] = []  # gaps that occur, ascending

    def opened(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, number))

    def put(length: int, number: int, first_bin: int, per_bin: int, offset: int) -> None:
        runs.append((length, placed[length], number, first_bin, per_bin, offset))
        placed[length] += number
        left[length] -= number

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        x = large[-1]
        k = bisect_left(large, capacity - x + 1) - 1
        y = large[k] if k >= 0 else None
        if y is None:
            number = left[x]
            put(x, number, bins, 1, 0)
            opened(capacity - x, bins, number)
        elif y == x:
            number = left[x] // 2
            if number:
                put(x, 2 * number, bins, 2, 0)
                opened(capacity - 2 * x, bins, number)
            elif k > 0:  # the last one of its length goes with a shorter one
                y = large[k - 1]
                put(x, 1, bins, 1, 0)
                put(y, 1, bins, 1, x)
                opened(capacity - x - y, bins, 1)
                number = 1
            else:
                put(x, 1, bins, 1, 0)
                opened(capacity - x, bins, 1)
                number = 1
        else:
            number = min(left[x], left[y])
            put(x, number, bins, 1, 0)
            put(y, number, bins, 1, x)
            opened(capacity - x - y, bins, number)
        bins += number
        large = [n for n in large if left[n]]

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            k = bisect_left(sizes, length)
            if k == len(sizes):
                need = -(-left[length] // (capacity // length))
                opened(capacity, bins, need)
                bins += need
                continue
            gap = sizes[k]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(k)
            each = gap // length
            full = min(number, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                opened(gap - each * length, first, full)
            if full < number and left[length] and left[length] < each:
                rest = left[length]
                put(length, rest, first + full, rest, capacity - gap)
                opened(gap - rest * length, first + full, 1)
                full += 1
            opened(gap, first + full, number - full)
    return runs


def pack_best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (as from ``token_pieces``, of a written table) with ``sequence_id`` and ``offset`` of each.

    An empty table gives none. Equal pieces are told apart by task and number, so repeated rows all get a place.
    The broadcast plan has a few runs for each length up to the capacity and no more.
    """
    spark = pieces.sparkSession
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = plan_bins(counts, capacity)
    plan = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 1, 0)], "length long, first_piece long, n_pieces long, first_bin long, per_bin long, begin long"
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = pieces.join(offsets, ["task", "length"]).withColumn("nth", F.col("earlier") + F.col("number"))
    within = F.col("nth") - F.col("first_piece")
    return (
        numbered.join(F.broadcast(plan), "length")
        .where((within >= 0) & (within < F.col("n_pieces")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_bin") + F.floor(within / F.col("per_bin"))).alias("sequence_id"),
            (F.col("begin") + (within % F.col("per_bin")) * F.col("length")).alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) packed into sequences of ``capacity`` tokens.

    Texts are encoded once; the pieces are written to the shared folder, because their numbers must not change
    between planning and placing.
    """
    return pack_best_fit(materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
