"""Benchmark decontamination: an FM-index over each shard of the documents, searched for the test phrases.

A shard is a slice of an Arrow batch. Its words become numbers of the phrases' vocabulary, and only stretches of
such words that are long enough for the shortest phrase are indexed, since no phrase can occur elsewhere. All
phrases are searched backwards together through the ranks of a wavelet matrix, and occurrences are located by
walking to the nearest sampled suffix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alertmill.llm.textbytes import LOWER, WORD_ALNUM, Sums, lean, mixed, slices, word_hashes, words

PHRASE_BLOCK_BYTES = 4 << 20  # test texts searched for at once, and so sent to every task
SAMPLE_STEP = 8
FOUND = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<first:long,last:long,start:long,end:long>>, text_key long"
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])), pa.int64()]
_FOUND_NAMES = ["doc_id", "n_words", "n_hit", "item_ids", "spans", "text_key"]


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector with running counts per level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros: list[int] = []
        self.counts: list[np.ndarray] = []
        self.levels: list[np.ndarray] = []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            count = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.levels.append(bit.astype(bool))
            self.counts.append(count)
            self.zeros.append(len(symbols) - int(count[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(place), place
        for k, (count, zeros) in enumerate(zip(self.counts, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            low_ones, high_ones = count[low], count[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return (high - low).astype(np.int64)

    def at(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(place), dtype=np.int64)
        for level, count, zeros in zip(self.levels, self.counts, self.zeros, strict=True):
            one = level[place]
            symbol = symbol * 2 + one
            place = np.where(one, zeros + count[place], place - count[place])
        return symbol


class FMIndex:
    """Index of a sequence of symbols, in which 0 separates stretches and begins and ends the whole."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        n = len(symbols)
        separators = np.flatnonzero(symbols == 0)
        rank = symbols.astype(np.int64) + len(separators)
        rank[separators] = np.arange(len(separators))  # all different, so no comparison goes past one
        rank, step = np.unique(rank, return_inverse=True)[1].astype(np.int64), 1
        while True:
            following = np.zeros(n, dtype=np.int64)
            following[: max(0, n - step)] = rank[step:] + 1
            key = rank * (n + 1) + following
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            rank = np.empty(n, dtype=np.int64)
            rank[suffixes] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
            if rank[suffixes[-1]] == n - 1:
                break
            step *= 2
        self.first = np.zeros(n_symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=n_symbols), out=self.first[1:])
        self.matrix = WaveletMatrix(symbols[suffixes - 1], n_symbols)
        sampled = (suffixes % SAMPLE_STEP == 0) | (symbols[suffixes - 1] == 0)
        self.sample_rank = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(sampled, out=self.sample_rank[1:])
        self.samples = suffixes[sampled]
        self.sampled = sampled
        self.size = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases given as rows of symbols, read from their ends."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - step].astype(np.int64)
            low[live] = self.first[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the sequence of places in suffix order."""
        found = np.empty(len(places), dtype=np.int64)
        who, steps = np.arange(len(places)), 0
        while len(who):
            done = self.sampled[places]
            found[who[done]] = self.samples[self.sample_rank[places[done]]] + steps
            who, places = who[~done], places[~done]
            symbol = self.matrix.at(places)
            places = self.first[symbol] + self.matrix.rank(symbol, places)
            steps += 1
        return found


@dataclass
class Phrases:
    """Windows of test items as numbers of a vocabulary (from 1), and the items of each window."""

    vocabulary: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    item_from: np.ndarray
    items: np.ndarray
    names: list[str]


def compile_phrases(items: list[tuple[str, str | None]], length: int) -> Phrases:
    """Windows of ``length`` words; an item of fewer words is one window, one without words has none."""
    hashes, names = [], []
    for name, text in items:
        data = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
        start, end, _ = words(data, np.array([0, len(data)]), WORD_ALNUM)
        if len(start):
            hashes.append(word_hashes(data, start, end))
            names.append(name)
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    vocabulary, number = np.unique(every, return_inverse=True)
    size = np.array([len(own) for own in hashes], dtype=np.int64)
    count = np.maximum(1, size - length + 1)
    item = np.repeat(np.arange(len(size)), count)
    begin = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(size) - size, count)
    long = np.minimum(size, length)[item]
    key = Sums(every).hashes(begin, begin + long) ^ mixed(long.astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    rows = np.zeros((len(first), length), dtype=np.int32)
    for k in range(length):
        filled = long[first] > k
        rows[filled, k] = number[begin[first][filled] + k] + 1
    pairs = np.unique(which * max(1, len(size)) + item) if len(item) else np.zeros(0, np.int64)
    window, members = np.divmod(pairs, max(1, len(size)))
    return Phrases(vocabulary, rows, long[first], np.searchsorted(window, np.arange(len(first) + 1)), members, names)


def find_in_shard(phrases: Phrases, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row and, by one FM-index of the shard, first word, last word (exclusive) and window of every occurrence."""
    data = LOWER[data]
    start, end, firsts = words(data, offsets, WORD_ALNUM)
    none = np.zeros(0, dtype=np.int64)
    if not len(start) or not len(phrases.rows):
        return firsts, start, end, none, none, none
    own = word_hashes(data, start, end)
    number = np.searchsorted(phrases.vocabulary, own)
    number[number == len(phrases.vocabulary)] = 0
    number = np.where(phrases.vocabulary[number] == own, number + 1, 0)
    edge = np.zeros(len(number) + 1, dtype=bool)
    edge[firsts] = True
    inside = number > 0
    opens = np.flatnonzero(inside & (edge[:-1] | np.r_[True, ~inside[:-1]]))
    closes = np.flatnonzero(inside & (edge[1:] | np.r_[~inside[1:], True])) + 1
    long = closes - opens >= phrases.lengths.min()
    opens, closes = opens[long], closes[long]
    if not len(opens):
        return firsts, start, end, none, none, none
    size = closes - opens
    begin = 1 + np.cumsum(size + 1) - (size + 1)
    symbols = np.zeros(int((size + 1).sum()) + 1, dtype=np.int64)
    origin = np.zeros(len(symbols), dtype=np.int64)
    target = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    source = np.repeat(opens, size) + (target - np.repeat(begin, size))
    symbols[target] = number[source]
    origin[target] = source
    index = FMIndex(symbols, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.rows, phrases.lengths)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = origin[index.locate(place)]
    return firsts, start, end, at, at + phrases.lengths[window], window


def _covered(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in one of the ranges."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, left, 1)
    np.add.at(change, right, -1)
    return np.cumsum(change)[:-1] > 0


def _search(docs: DataFrame, phrases: Phrases) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text"):
                firsts, start, end, left, right, window = find_in_shard(known, data, offsets)
                hit = _covered(len(start), left, right)
                total = np.r_[0, np.cumsum(hit)]
                row = np.searchsorted(firsts, left, side="right") - 1
                pairs = np.unique(np.stack([row, window], axis=1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
                n_items = np.diff(known.item_from)[pairs[:, 1]]
                items = known.items[np.repeat(known.item_from[pairs[:, 1]], n_items) + np.arange(n_items.sum()) - np.repeat(np.cumsum(n_items) - n_items, n_items)]
                named: dict[int, set[str]] = {}
                for r, k in zip(np.repeat(pairs[:, 0], n_items).tolist(), items.tolist(), strict=True):
                    named.setdefault(r, set()).add(known.names[k])
                edge = np.zeros(len(hit) + 1, dtype=bool)
                edge[firsts] = True
                opens = np.flatnonzero(hit & (edge[:-1] | np.r_[True, ~hit[:-1]])) if len(hit) else np.zeros(0, np.int64)
                closes = np.flatnonzero(hit & (edge[1:] | np.r_[~hit[1:], True])) + 1 if len(hit) else np.zeros(0, np.int64)
                spans: dict[int, list[dict]] = {}
                owner = np.searchsorted(firsts, opens, side="right") - 1
                edges = (opens - firsts[owner], closes - firsts[owner], start[opens] - offsets[owner], end[closes - 1] - offsets[owner])
                for r, a, b, c, d in zip(owner.tolist(), *(e.tolist() for e in edges), strict=True):
                    spans.setdefault(r, []).append({"first": a, "last": b, "start": c, "end": d})
                rows = stop - first
                columns = [
                    batch.column("doc_id")[first:stop],
                    np.diff(firsts),
                    total[firsts[1:]] - total[firsts[:-1]],
                    [sorted(named.get(r, ())) for r in range(rows)],
                    [spans.get(r, []) for r in range(rows)],
                    batch.column("text_key")[first:stop],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, _FOUND_TYPES, strict=True)], names=_FOUND_NAMES)

    return docs.mapInArrow(lean(search), FOUND)


def _blocks(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(size / PHRASE_BLOCK_BYTES))


def without_contamination(docs: DataFrame, benchmark: DataFrame, length: int = 13, share: int = 20) -> DataFrame:
    """Rows of ``docs`` that :func:`find_contamination` does not call contaminated, with all their columns.

    While the test texts are one block, rows are kept or left out in the pass that searches them, without a shuffle. With more
    blocks the rows are joined with the ids and text hashes of contaminated ones.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    if _blocks(benchmark) > 1:
        gone = find_contamination(docs, benchmark, length, share, text_key=True).where("contaminated")
        gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
        # ids can be missing or repeated
        same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_key"))
        return rows.join(gone, same, "left_anti").select("_row.*")
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(compile_phrases([(r["item_id"], r["text"]) for r in named.collect()], length))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text"):
                firsts, start, _, left, right, _ = find_in_shard(sent.value, data, offsets)
                total = np.r_[0, np.cumsum(_covered(len(start), left, right))]
                n_words, n_hit = np.diff(firsts), total[firsts[1:]] - total[firsts[:-1]]
                kept = (n_hit == 0) | (n_hit * share < n_words)
                yield pa.RecordBatch.from_arrays([batch.column("_row")[first:stop].filter(pa.array(kept))], names=["_row"])

    return rows.mapInArrow(lean(clean), StructType([rows.schema["_row"]])).select("_row.*")


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = 13, share: int = 20, text_key: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, item_ids, spans (words and bytes of the text) and contaminated.

    A word inside any occurrence of a window of ``length`` words of a test item is hit; a document is contaminated
    if it has a hit and one word in ``share`` or more is hit. Null and empty texts have no words, an empty benchmark
    hits nothing, an item without id is named ``null``, and each repeated row gets its own result. The test texts are
    sent to the tasks in blocks of at most ``PHRASE_BLOCK_BYTES``; with several blocks the documents are read
    once per block and the results are joined by id and text. With ``text_key`` the hash of each row's text that this
    is done by is a column as well.
    """
    blocks = _blocks(benchmark)
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key") if blocks > 1 or text_key else F.lit(0).cast("long").alias("text_key"))
    found = None
    for k in range(blocks):
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        one = _search(keyed, compile_phrases([(r["item_id"], r["text"]) for r in part.collect()], length))
        found = one.withColumn("block", F.lit(k)) if found is None else found.unionByName(one.withColumn("block", F.lit(k)))
    if blocks > 1:
        found = _joined_blocks(found, blocks)
    hit = F.col("n_hit")
    more = ["text_key"] if text_key else []
    return found.select("doc_id", "n_words", "n_hit", "item_ids", "spans", ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"), *more)


def _joined_blocks(found: DataFrame, blocks: int) -> DataFrame:
    """Results of all blocks of test texts put together: one row for each row that was searched."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, span: F.struct(
            F.greatest(acc["upto"], span["last"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), span["last"] - F.greatest(acc["upto"], span["first"]))).alias("n"),
        ),
    )
    merged = found.groupBy("doc_id", "text_key").agg(
        (F.count(F.lit(1)) / blocks).cast("int").alias("copies"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    return merged.withColumn("n_hit", covered["n"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
