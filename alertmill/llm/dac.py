"""Directly addressable codes for token ids: files of chunk levels with random access to any token.

Level 0 holds the low eight bits of every id, level 1 the next eight bits of the ids that have any, and so on. A
bitmap at each level marks the ids that continue, and a directory of running counts at every ``BLOCK`` bits
gives the place of a continued id on the next level, so one id is read without decoding others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertmill.llm.textbytes import slices
from alertmill.llm.tokens import encoder
from alertmill.storage import new_table_path

MAGIC = b"DAC8"
BLOCK = 512
SEGMENT_TOKENS = 2_000_000  # a segment is closed when it holds so many
SEGMENT = "part int, segment int, n_docs int, n_tokens long, doc_ids binary, ends binary, codes binary"
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["part", "segment", "n_docs", "n_tokens", "doc_ids", "ends", "codes"]


def pack_codes(ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        counts = np.cumsum(per_block) - per_block
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + counts.astype("<u8").tobytes())
        if not more.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[more] >> np.uint32(8)


class Codes:
    """A packed array of ids: ``at(places)`` reads any of them, ``all()`` every one."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (count,), at = struct.unpack_from("<I", blob, 4), 8
        self.levels = []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", blob, at)
            chunk = np.frombuffer(blob, np.uint8, n, at + 8)
            bits = np.frombuffer(blob, np.uint8, -(-n // 8), at + 8 + n)
            ranks = np.frombuffer(blob, "<u8", -(-n // BLOCK), at + 8 + n + len(bits))
            self.levels.append((chunk, bits, ranks))
            at += 8 + n + len(bits) + ranks.nbytes

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, places: np.ndarray) -> np.ndarray:
        places = np.asarray(places, dtype=np.int64)
        if len(places) and (places.min() < 0 or places.max() >= len(self)):
            raise IndexError("place outside the codes")
        out, who = np.zeros(len(places), dtype=np.uint32), np.arange(len(places))
        ones = np.array([bin(b).count("1") for b in range(256)])
        for level, (chunk, bits, ranks) in enumerate(self.levels):
            out[who] |= chunk[places].astype(np.uint32) << np.uint32(8 * level)
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            who, places = who[on], places[on]
            if not len(who):
                break
            block = places // BLOCK
            rank = ranks[block].astype(np.int64)
            window = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
            byte = places >> 3
            full = np.where(window < byte[:, None], bits[np.minimum(window, len(bits) - 1)], 0)
            rank += ones[full].sum(axis=1) + ones[bits[byte] & ((1 << (places & 7)) - 1).astype(np.uint8)]
            places = rank
        return out

    def all(self) -> np.ndarray:
        out = self.levels[0][0].astype("<u4")
        who = np.arange(len(out))
        for level, (chunk, bits, _) in enumerate(self.levels):
            if level:
                out[who] |= chunk.astype(np.uint32) << np.uint32(8 * level)
            who = who[np.unpackbits(bits, count=len(who), bitorder="little") == 1]
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents in ascending id order; a null text is empty and has the end id only.

    Part files hold ranges of ids in order (null ids first), each a run of segments of bounded size.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        ends, size = [], 0

        def closed() -> pa.RecordBatch:
            names_raw = pa.array(names, pa.int64())
            mask = np.array([x is None for x in names], dtype=np.uint8).tobytes()
            row = (part, segment, len(names), size, mask + names_raw.fill_null(0).to_numpy().astype("<i8").tobytes(), np.array(ends, "<i8").tobytes(), pack_codes(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text"):
                ids, at = code.encode(data, offsets)
                held.append(np.insert(ids, at[1:], end_id))
                names.extend(batch.column("doc_id")[first:stop].to_pylist())
                ends.extend((size + at[1:] + np.arange(1, len(at))).tolist())
                size = ends[-1]
                if size >= SEGMENT_TOKENS:
                    yield closed()
                    segment, held, names, ends, size = segment + 1, [], [], [], 0
        if names:
            yield closed()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )
    ordered.mapInArrow(encode, SEGMENT).write.parquet(path)


def _doc_ids(blob: bytes, n: int) -> list[int | None]:
    values = np.frombuffer(blob, "<i8", n, n).tolist()
    return [None if blob[k] else v for k, v in enumerate(values)]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and the checksum of its ids."""
    files = spark.read.schema(SEGMENT).parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(Codes(row["codes"]).all().astype("<u4").tobytes())
                ends = np.frombuffer(row["ends"], "<i8").tolist()
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                n = row["n_docs"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(_doc_ids(row["doc_ids"], n), pa.int64()), pa.array(starts, pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    sizes = files.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per part file
    earlier_parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
    earlier = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.withColumn("before", earlier).join(earlier_parts, "part").select("part", "segment", (F.col("before") + F.col("before_part")).alias("begin"))
    rows = files.mapInArrow(digest, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(begins, ["part", "segment"]).select("doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The token at each (part, segment, place) asked for, read from the files without decoding the rest.

    Places outside a segment, and nulls, give no row.
    """
    files = spark.read.schema(SEGMENT).parquet(path).select("part", "segment", "n_tokens", "codes")
    asked = places.select("part", "segment", "place").distinct().groupBy("part", "segment").agg(F.collect_list("place").alias("places"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wanted = np.array([p for p in row["places"] if 0 <= p < row["n_tokens"]], dtype=np.int64)
                found = Codes(row["codes"]).at(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(wanted), pa.int32()), pa.array([row["segment"]] * len(wanted), pa.int32()), pa.array(wanted, pa.int64()), pa.array(found.astype(np.int64), pa.int64())],
                    names=["part", "segment", "place", "token"],
                )

    return files.join(asked, ["part", "segment"]).mapInArrow(look, "part int, segment int, place long, token long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = new_table_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
