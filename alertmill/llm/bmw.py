"""Exact top-k search by BM25 over inverted index shards with block-max pruning.

Every shard is an inverted index of some thousand documents. Statistics are those of all documents, so scores
of different shards compare, and the best of all shards are the best of all. In a shard the postings of a query's
rarer terms are added up; for its frequent terms every small block of documents of like length has the sum of their
greatest impacts there. Only documents whose sum and block together can reach the k-th best score are scored; where
blocks leave many, the frequent terms of all are added up first. A query whose terms cannot reach that score together
skips the shard. The score is looked for in some of the shards first, so the others start from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.textbytes import LOWER, WORD_ALNUM, lean, slices, word_hashes, words
from alertmill.storage import materialize

K1, B = 1.2, 0.75
SHARD_DOCS, SHARD_WORDS = 8192, 4_000_000  # a shard is closed when it has so many documents or words
LAST_SHARD = 0.5  # a smaller rest of a shard goes to the one before
BLOCK_DOCS = 4
FREQUENT_SHARE, FREQUENT_TERMS = 0.1, 1024  # a term in more of a shard's documents is met by blocks; so many at most
QUERY_TERMS = 4_000_000  # terms of the queries that are sent to the shards at once
QUERY_BATCH = 128  # queries that are looked up at once
FIRST_SHARDS = 8  # one shard in so many is searched first, of many shards one in its square before those
FEW_SHARE = 0.05  # of a shard's documents, which are looked at one by one
_SLACK = 1e-9  # sums in another order differ by less
_NEAR_SLACK = 1e-4  # and so do those of single precision
_NO_IDS, _NO_SCORES = np.zeros(0, dtype=np.int64), np.zeros(0)
SHARD = "terms binary, ends binary, docs binary, counts binary, doc_ids binary, lengths binary"
_SHARD_NAMES = ["terms", "ends", "docs", "counts", "doc_ids", "lengths"]


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of every distinct word of every row by row and term, and the number of words of each row."""
    data = LOWER[data]
    start, end, firsts = words(data, offsets, WORD_ALNUM)
    term, row = word_hashes(data, start, end), np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    order = np.argsort(term)
    rows = row[order]
    order = order[np.argsort(rows.astype(np.uint16) if len(offsets) <= 1 << 16 else rows, kind="stable")]  # few bits are sorted fast
    term, row = term[order], row[order]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])]) if len(term) else np.zeros(0, np.int64)
    return row[first], term[first], np.diff(np.r_[first, len(term)]), np.diff(firsts)


class _Held:
    """Documents that will be a shard."""

    def __init__(self) -> None:
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.size = self.n_words = 0

    def add(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.found.append((row.astype(np.int32), term, count.astype(np.int32)))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.size, self.n_words = self.size + len(ids), self.n_words + int(lengths.sum())

    def take(self, other: _Held) -> None:
        for found, ids, lengths in zip(other.found, other.ids, other.lengths, strict=True):
            self.add(*found, ids, lengths)

    def part(self) -> float:
        """How full the shard is."""
        return max(self.size / SHARD_DOCS, self.n_words / SHARD_WORDS)

    def closed(self) -> pa.RecordBatch:
        before = np.cumsum([0, *(len(ids) for ids in self.ids)]).astype(np.int32)
        doc = np.concatenate([row + n for (row, _, _), n in zip(self.found, before)])
        term, count = (np.concatenate(x) for x in list(zip(*self.found, strict=True))[1:])
        own, length = np.concatenate(self.ids), np.concatenate(self.lengths)
        self.found = []
        by_length = np.argsort(length, kind="stable")
        place = np.empty(len(own), dtype=np.int32)
        place[by_length] = np.arange(len(own))
        doc = place[doc]
        order = np.lexsort((doc, term))
        doc, term, count = doc[order], term[order], count[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        parts = [term[first].astype("<u8"), np.r_[first[1:], len(term)].astype("<i4")[: len(first)], doc.astype("<i4"), count.astype("<i4"), own[by_length].astype("<i8"), length[by_length].astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=_SHARD_NAMES)


def index_shards(docs: DataFrame) -> DataFrame:
    """Inverted indexes of ``docs`` (doc_id, text): terms with their postings (document of the shard, count)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, held = None, _Held()
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text"):
                row, term, count, length = term_counts(data, offsets)
                held.add(row, term, count, batch.column("doc_id")[first:stop].to_numpy(), length)
                if full is not None and held.part() >= LAST_SHARD:
                    yield full.closed()
                    full = None
                if held.part() >= 1:
                    full, held = held, _Held()
        # what is left over is a shard of its own, or else part of the last one
        if full is not None:
            full.take(held)
            held = full
        if held.ids:
            yield held.closed()

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lean(build), SHARD)


def document_frequencies(shards: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.diff(np.r_[0, np.frombuffer(ends, "<i4")]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i8")), pa.array(own)], names=["term", "n"])

    return shards.select("terms", "ends").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def query_terms(docs: DataFrame) -> DataFrame:
    """(query_id, term) for every distinct word of every query text (doc_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in slices(batch, "text"):
                row, term, _, _ = term_counts(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id")[first:stop].to_numpy()[row]), pa.array(term.view(np.int64))], names=["query_id", "term"])

    return docs.select("doc_id", "text").mapInArrow(read, "query_id long, term long").distinct()


class Shard:
    def __init__(self, row: dict, average: float):
        self.terms = np.frombuffer(row["terms"], "<u8")
        ends = np.frombuffer(row["ends"], "<i4").astype(np.int64)
        self.size = np.diff(np.r_[0, ends])
        self.start = ends - self.size
        doc_ids, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i4")
        n_docs = len(doc_ids)
        self.n_blocks = -(-n_docs // BLOCK_DOCS)
        self.n_slots = self.n_blocks * BLOCK_DOCS
        # neighbours by length share a block; the documents of a block lie n_blocks slots apart, a few slots stay empty
        slot = np.arange(n_docs) % BLOCK_DOCS * self.n_blocks + np.arange(n_docs) // BLOCK_DOCS
        self.doc_ids, self.norm = np.zeros(self.n_slots, dtype=np.int64), np.ones(self.n_slots)
        self.doc_ids[slot] = doc_ids
        self.norm[slot] = K1 * (1 - B + B * (lengths / max(average, 1e-9)))
        self.docs = slot.astype(np.int32)[np.frombuffer(row["docs"], "<i4")]
        self.counts = np.frombuffer(row["counts"], "<i4")
        # the same postings by document: the term and count of each
        by_doc = np.argsort(self.docs.astype(np.uint16) if self.n_slots < 1 << 16 else self.docs, kind="stable")
        self.term_by_doc = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.size)[by_doc]
        self.count_by_doc = self.counts[by_doc]
        self.doc_size = np.bincount(self.docs, minlength=self.n_slots)
        self.doc_start = np.cumsum(self.doc_size) - self.doc_size
        # low bits of a gain that give way to the slot; what this changes is far below the slack
        bits = max(self.n_slots - 1, 1).bit_length()
        self.slot_bits, self.slack = np.int64((1 << bits) - 1), max(_SLACK, 2.0 ** (bits - 50))

    @property
    def impacts(self) -> np.ndarray:
        return self.counts * (K1 + 1) / (self.counts + self.norm[self.docs])

    def weigh(self, terms: np.ndarray, weights: np.ndarray) -> None:
        """Take the weights of all terms that queries ask for."""
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        self.place = np.where(known, at, -1)
        self.weight = np.zeros(len(self.terms))
        self.weight[at[known]] = weights[known]
        gains = self.impacts * np.repeat(self.weight, self.size)
        often = np.flatnonzero((self.weight > 0) & (self.size > FREQUENT_SHARE * self.n_slots))
        often = np.sort(often[np.argsort(-self.size[often], kind="stable")[:FREQUENT_TERMS]])
        self.frequent = np.full(len(self.terms), -1)
        self.frequent[often] = np.arange(len(often))
        # of frequent terms: gains in every document, and the greatest of every block
        posting, of = _ranges(self.start[often], self.size[often])
        self.near = np.zeros((self.n_slots, len(often)), dtype=np.float32)
        self.near[self.docs[posting], of] = gains[posting]
        self.most = np.ascontiguousarray(self.near.reshape(BLOCK_DOCS, self.n_blocks, len(often)).max(axis=0).T)
        self.greatest = np.maximum.reduceat(gains, self.start) if len(gains) else np.zeros(len(self.terms))
        self.wanted = np.zeros(len(self.terms))  # weights of the terms of the query at hand
        # of the others: gain and slot in one number
        self.packed = (gains.view(np.int64) & ~self.slot_bits | self.docs).view(np.float64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents with any of the terms, by score and then id."""
        self.weigh(terms, weights)
        return next(self.search([np.arange(len(terms))], np.zeros(1), k))

    def search(self, queries: list[np.ndarray], least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best documents of each query that reach its ``least`` score, by score and then id.

        A query is the places of its terms among those that were weighed.
        """
        for begin in range(0, len(queries), QUERY_BATCH):
            batch, floors = queries[begin : begin + QUERY_BATCH], least[begin : begin + QUERY_BATCH]
            of, at = np.repeat(np.arange(len(batch)), [len(q) for q in batch]), self.place[np.concatenate(batch)]
            of, at = of[at >= 0], at[at >= 0]
            for row, hit in enumerate(self._near(of, at, floors, k)):
                if hit is None:
                    yield _NO_IDS, _NO_SCORES
                    continue
                first, stop = np.searchsorted(of, (row, row + 1))
                scores = self._scores(hit, at[first:stop])
                kept = np.flatnonzero((scores >= floors[row]) & (scores > 0))
                ids, scores = self.doc_ids[hit[kept]], scores[kept]
                top = np.lexsort((ids, -scores))[:k]
                yield ids[top], scores[top]

    def _near(self, of: np.ndarray, at: np.ndarray, floors: np.ndarray, k: int) -> Iterator[np.ndarray | None]:
        """For each query the slots of all documents that can be among its ``k`` best and reach its floor.

        ``at`` are the terms of the queries ``of``, by query.
        """
        n = len(floors)
        rare = self.frequent[at] < 0
        greatest = self.greatest[at]
        # what one document can reach at most by its terms, and by those of them that are frequent
        most, most_often = np.bincount(of, weights=greatest, minlength=n), np.bincount(of[~rare], weights=greatest[~rare], minlength=n)
        hopeless = (most * (1 + _NEAR_SLACK) < floors) | (most == 0)
        frequent_of, frequent = of[~rare], self.frequent[at[~rare]]
        of, at = of[rare], at[rare]
        size = self.size[at]
        first = np.searchsorted(of, np.arange(n + 1))
        before = np.r_[0, np.cumsum(size)]
        ends = before[first]
        shift = self.start[at] - before[:-1] + ends[of]  # from the number of a posting of a query to its place
        longest = int(np.diff(ends).max())
        numbers, gains = np.arange(longest), np.empty(longest)
        sums: dict[int, np.ndarray] = {}
        for row in np.flatnonzero(~hopeless).tolist():
            a, b, m = first[row], first[row + 1], ends[row + 1] - ends[row]
            if not m:
                sums[row] = np.zeros(self.n_slots)
                continue
            place = np.repeat(shift[a:b], size[a:b])
            place += numbers[:m]
            gain = np.take(self.packed, place, out=gains[:m], mode="clip")
            np.bitwise_and(gain.view(np.int64), self.slot_bits, out=place)
            total = np.bincount(place, weights=gain, minlength=self.n_slots)
            if (total.max() + most_often[row]) * (1 + _NEAR_SLACK) >= floors[row]:
                sums[row] = total
        often = np.zeros((n, len(self.most)), dtype=np.float32)
        often[frequent_of, frequent] = 1
        hits: dict[int, np.ndarray] = {}
        many = [row for row in sums if floors[row] <= 0]
        known = [row for row in sums if floors[row] > 0]
        for row, bound in zip(known, (often[known] @ self.most).astype(np.float64), strict=True):
            total, floor = sums[row], float(floors[row])
            bound *= 1 + _NEAR_SLACK
            hit = np.flatnonzero(total.reshape(BLOCK_DOCS, self.n_blocks) >= floor / (1 + self.slack) - bound)
            if len(hit) > FEW_SHARE * self.n_slots:
                many.append(row)
            elif len(hit):
                hits[row] = hit[_reaching(total[hit] + self.near[hit] @ often[row], floor, k)]
        # where blocks leave many documents, all of them are looked at, for all such queries at once
        for row, rest in zip(many, often[many] @ self.near.T, strict=True):
            hits[row] = _reaching(sums[row] + rest, float(floors[row]), k)
        for row in range(n):
            hit = hits.get(row, _NO_IDS)
            yield hit if len(hit) else None

    def _scores(self, found: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of some documents; those of equal texts are equal to the last bit, as terms are added in one order."""
        self.wanted[asked] = self.weight[asked]
        scores = np.zeros(len(found))
        for i, (slot, start, size) in enumerate(zip(found.tolist(), self.doc_start[found].tolist(), self.doc_size[found].tolist(), strict=True)):
            if size:
                weight = self.wanted[self.term_by_doc[start : start + size]]
                kept = np.flatnonzero(weight)
                count = self.count_by_doc[start : start + size][kept]
                gains = count * (K1 + 1) / (count + self.norm[slot]) * weight[kept]
                scores[i] = np.add.accumulate(gains)[-1] if len(gains) else 0.0
        self.wanted[asked] = 0
        return scores


def _reaching(sums: np.ndarray, floor: float, k: int) -> np.ndarray:
    """Places of the ``k`` greatest sums that reach a floor, and of all that come as near to them as the slack."""
    reached = np.flatnonzero((sums >= floor * (1 - 3 * _NEAR_SLACK)) & (sums > 0))
    if len(reached) > k:
        sums = sums[reached]
        reached = reached[sums >= np.partition(sums, -k)[-k] * (1 - 3 * _NEAR_SLACK)]
    return reached


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and the range of each."""
    own = np.repeat(np.arange(len(start)), size)
    return np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + start[own], own


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 10, alike: str | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for every text of ``queries``.

    A query is the set of its words. Documents that share no word with it are not found, so an empty query gives no row.
    Equal scores rank by the smaller id; rows without id are left out; repeated rows count as documents of
    their own. Queries go to the shards in blocks of about ``QUERY_TERMS`` terms. Documents of equal ``alike``, a column of
    ``docs``, come to the same shards, which spares queries the shards that share few words with them.
    """
    if alike is not None:
        docs = docs.where("doc_id IS NOT NULL").select(alike, "doc_id", "text")
        tasks = max(1, math.ceil(docs.count() / SHARD_DOCS))
        docs = docs.repartitionByRange(tasks, alike, F.xxhash64("doc_id")).coalesce(tasks)
    shards = materialize(index_shards(docs).withColumn("number", F.monotonically_increasing_id()), "shards")
    n_docs = int(shards.agg(F.sum(F.octet_length("doc_ids"))).first()[0] or 0) // 8
    n_words = _total_words(shards)
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = query_terms(queries.where("doc_id IS NOT NULL")).join(document_frequencies(shards), "term").select("query_id", "term", idf.alias("weight"))
    asked = materialize(asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms")), "queries")
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(n_terms / QUERY_TERMS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        one, sent = _search(shards, part, n_words / max(1, n_docs), k)
        one = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
        if blocks > 1:  # the next block's queries take the place of these
            one = materialize(one, "found")
            for held in sent:
                held.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def _total_words(shards: DataFrame) -> int:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(np.frombuffer(x, "<i4").sum()) for x in batch.column(0).to_pylist())], pa.int64())], names=["n"])

    return int(shards.select("lengths").mapInArrow(add, "n long").agg(F.sum("n")).first()[0] or 0)


def _search(shards: DataFrame, queries: DataFrame, average: float, k: int) -> tuple[DataFrame, list]:
    """Best documents of a block of queries of bounded size, with the broadcasts that they are found by."""
    rows = queries.select("query_id", F.col("terms.term").alias("term"), F.col("terms.weight").alias("weight")).toArrow()
    ids, terms, weights = (rows.column(c).combine_chunks() for c in ("query_id", "term", "weight"))
    ids, ends = ids.to_numpy(zero_copy_only=False), np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    names, first, place = np.unique(terms.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_index=True, return_inverse=True)
    weight = weights.flatten().to_numpy(zero_copy_only=False)[first]
    sent = shards.sparkSession.sparkContext.broadcast((ids, ends, place.astype(np.int32), names, weight))

    held = [sent]

    def searched(some: DataFrame, least: np.ndarray) -> DataFrame:
        reach = shards.sparkSession.sparkContext.broadcast(least)
        held.append(reach)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, ends, place, names, weight = sent.value
            asked = np.split(place, ends[:-1]) if len(ids) else []
            floors = reach.value.copy()
            for batch in batches:
                for i in range(batch.num_rows if len(ids) else 0):
                    shard = Shard({name: batch.column(name)[i].as_buffer() for name in _SHARD_NAMES}, average)
                    shard.weigh(names, weight)
                    out = []
                    for at, (found, scores) in enumerate(shard.search(asked, floors, k)):
                        if len(found):
                            out.append((np.full(len(found), ids[at], dtype=np.int64), found, scores))
                        if len(found) == k:  # what follows must reach these
                            floors[at] = max(floors[at], scores[-1])
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "doc_id", "score"])

        return some.mapInArrow(lean(look), "query_id long, doc_id long, score double")

    # some shards are searched first; what as many documents as are asked for reach there, those of the others must reach
    number = F.shiftright("number", 33) + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    few, least, begun, rest = shards.count() < 4 * FIRST_SHARDS**2, np.zeros(len(ids)), None, F.lit(True)
    for stride in [FIRST_SHARDS] if few else [FIRST_SHARDS**2, FIRST_SHARDS]:
        now = F.pmod(number, F.lit(stride)) == 0
        found = materialize(searched(shards.where(rest & now), least), "begun")
        begun, rest = found if begun is None else begun.unionByName(found), rest & ~now
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        known = begun.withColumn("place", place).where(F.col("place") == k).select("query_id", "score").toArrow()
        reached = dict(zip(known.column("query_id").to_pylist(), known.column("score").to_pylist(), strict=True))
        least = np.array([reached.get(q, 0.0) for q in ids.tolist()])
    return begun.unionByName(searched(shards.where(rest), least)), held
