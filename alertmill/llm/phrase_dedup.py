"""Removal of word sequences that an earlier document has, by automata of repeated phrases.

Recurring passages are confirmed first (``repeats``): a passage whose hull recurs in an earlier document goes as a
whole. At the ends of passages some windows recur and others do not. There the phrases that recur are compiled
into Aho-Corasick automata, one after another for the cores of a shard, and every document's segments with
those cores are streamed through them, so that each occurrence is found by its words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.repeats import NO_ID, first_window, further_windows, keyed, segment_rows, settle, span_columns
from alertmill.llm.textbytes import WORD_BY_SPACE, Sums, joined_runs, slices, word_hashes, words
from alertmill.storage import materialize

# Windows that can share an anchor; the core is the window less this, plus one.
SPREAD = 8
# Text of the segments for which one automaton is compiled at a time.
SHARD_CHARS = 4_000_000
# A core with more open segments is dealt out by single phrases.
CORE_SEGMENTS = 20_000
# Longer phrases are known by a 128-bit digest, so that what is kept of a core has a bound, however long its words are.
KEY_CHARS = 100
PASSAGES = "shard long, doc_id long, part int, first long, words string"
FOUND = "doc_id long, part int, start long, end long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[Sums, np.ndarray]:
    start, end, firsts = words(data, offsets, WORD_BY_SPACE)
    return Sums(word_hashes(data, start, end)), firsts


def _passages(texts: DataFrame, length: int) -> DataFrame:
    """The words of every open segment and its first word's number, to be dealt by core; of a frequent core, phrase by phrase."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for first, stop, data, offsets in slices(batch, "text"):
                start, end, firsts = words(data, offsets, WORD_BY_SPACE)
                raw, sums = data.tobytes(), Sums(word_hashes(data, start, end))
                columns = (batch.column(c)[first:stop].to_pylist() for c in ("doc_id", "part", "segments"))
                for k, (doc, part, segments) in enumerate(zip(*columns, strict=True)):
                    for segment in segments:
                        at = first_window(segment["place"])
                        upto = at + further_windows(segment["place"]) + length
                        at, upto = int(firsts[k]) + at, int(firsts[k]) + upto
                        if segment["frequent"]:
                            begins = np.arange(at, upto - length + 1)
                            shards = sums.hashes(begins, begins + length).view(np.int64).tolist()
                            cuts = list(zip(shards, begins.tolist(), (begins + length).tolist(), strict=True))
                        else:
                            cuts = [(segment["core"], at, upto)]
                        for shard, a, b in cuts:
                            own = b" ".join([raw[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])
                            rows.append((shard, doc, part, a - int(firsts[k]), own.decode()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "doc_id", "part", "first", "words"])

    return texts.mapInArrow(read, PASSAGES)


def phrase_key(phrase: str) -> str | bytes:
    return phrase if len(phrase) <= KEY_CHARS else hashlib.blake2b(phrase.encode(), digest_size=16).digest()


def least_documents(segments: list[tuple[int, int, int, list[str]]], length: int, known: dict) -> tuple[dict, dict[str, int]]:
    """Smallest document id by the key of every phrase of ``length`` words, and by phrase of those in two documents or more.

    ``known`` are keys of phrases of earlier segments.
    """
    least = dict(known)
    several: dict[str, str | bytes] = {}
    for doc, _, _, own in segments:
        for k in range(len(own) - length + 1):
            phrase = " " + " ".join(own[k : k + length]) + " "
            key = phrase_key(phrase)
            seen = least.setdefault(key, doc)
            if seen != doc:
                several[phrase] = key
                least[key] = min(seen, doc)
    return least, {p: least[key] for p, key in several.items()}


def recurring_phrases(segments: list[tuple[int, int, int, list[str]]], length: int, known: dict) -> dict[str, int]:
    """Phrases of ``length`` words that start in two documents or more, with the smallest document id."""
    return least_documents(segments, length, known)[1]


def find_phrases(segments: list[tuple[int, int, int, list[str]]], phrases: dict[str, int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, part, first word, word after the last) of every phrase that an earlier document has."""
    import ahocorasick

    if not phrases:
        return
    automaton = ahocorasick.Automaton()
    for phrase, doc in phrases.items():
        automaton.add_word(phrase, (doc, len(phrase)))
    automaton.make_automaton()
    for doc, part, first, own in segments:
        text = " " + " ".join(own) + " "
        for end, (least, size) in automaton.iter(text):
            if least < doc:
                at = first + text.count(" ", 0, end - size + 2) - 1
                yield doc, part, at, at + length


def _occurrences(passages: DataFrame, length: int) -> DataFrame:
    """Stream segments, gathered by core, through the automata of their shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[str]]] = []
        known: dict[str | bytes, int] = {}
        size, last, begin = 0, None, 0  # the segments of the last shard begin there

        def found() -> pa.RecordBatch | None:
            rows = list(find_phrases(held, recurring_phrases(held, length, known), length))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "part", "start", "end"]) if rows else None

        for batch in batches:
            for shard, doc, part, first, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size > SHARD_CHARS:
                    if rows := found():
                        yield rows
                    # a shard that goes on does so in the order of its documents; it has one phrase, or at most those of CORE_SEGMENTS segments
                    known = least_documents(held[begin:], length, {} if begin else known)[0] if shard == last else {}
                    held, size, begin = [], 0, 0
                elif shard != last:
                    begin = len(held)
                held.append((doc, part, first, text.split(" ")))
                size += len(text)
                last = shard
        if held and (rows := found()):
            yield rows

    return passages.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(search, FOUND)


def _removed(texts: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, stop, data, offsets in slices(batch, "text"):
                start, end, firsts = words(data, offsets, WORD_BY_SPACE)
                raw = data.tobytes()
                columns = (batch.column(c)[first:stop] for c in ("doc_id", "starts", "ends"))
                for k, (doc, starts, ends) in enumerate(zip(*columns, strict=True)):
                    own = slice(int(firsts[k]), int(firsts[k + 1]))
                    keep = np.ones(own.stop - own.start, dtype=bool)
                    if starts.is_valid:
                        for a, b in zip(*(x.tolist() for x in joined_runs(starts.values.to_numpy(), ends.values.to_numpy())), strict=True):
                            keep[a:b] = False
                    kept = b" ".join([raw[a:b] for a, b in zip(start[own][keep].tolist(), end[own][keep].tolist(), strict=True)])
                    out.append((doc.as_py(), len(keep), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return texts.mapInArrow(cut, RESULT)


def remove_repeated_phrases(docs: DataFrame, length: int = 13, spread: int = SPREAD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256 and the kept words as a text.

    A word goes if a window of ``length`` words that covers it also starts in a document with a smaller id; windows
    are judged on the input. Null and empty texts have no words; a missing id counts as the smallest; rows that repeat
    an id are not earlier than each other, and each keeps its own result. Other columns are not read.
    """
    texts = keyed(docs)
    settled = materialize(settle(segment_rows(texts, _words, length, spread, earlier_only=True), earlier_only=True), "segments")
    opened = settled.where("open")
    # at most one core for every CORE_SEGMENTS rows
    frequent = opened.groupBy("core").count().where(F.col("count") > CORE_SEGMENTS).select("core", F.lit(True).alias("hot"))
    marked = opened.join(frequent, "core", "left").select("doc_id", "part", F.struct("core", "place", F.coalesce("hot", F.lit(False)).alias("frequent")).alias("segment"))
    looked = marked.groupBy("doc_id", "part").agg(F.collect_list("segment").alias("segments"))
    found = _occurrences(_passages(texts.join(looked, ["doc_id", "part"]), length), length)
    start, end = span_columns(length)
    spans = settled.where("NOT open").select("doc_id", "part", start.alias("start"), end.alias("end")).unionByName(found)
    lists = spans.groupBy("doc_id", "part").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    result = _removed(texts.join(lists, ["doc_id", "part"], "left"))
    return result.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
