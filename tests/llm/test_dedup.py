import hashlib
from collections import Counter

import numpy as np
import pytest

from alertmill.llm import phrase_dedup, textbytes
from alertmill.llm.phrase_dedup import remove_repeated_phrases
from alertmill.llm.suffix_dedup import remove_repeated_bytes

from .conftest import WORDS, frame


def bytes_brute(docs, length):
    seen = Counter()
    for _, text in docs:
        raw = (text or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        hit = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(hit) else 0
        out.append((doc, len(raw), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~hit])).hexdigest()))
    return sorted(out, key=repr)


def words_brute(docs, length):
    rank = lambda doc: -(1 << 63) if doc is None else doc
    least = {}
    split = [WORDS.findall(t or "") for _, t in docs]
    for (doc, _), own in zip(docs, split, strict=True):
        for i in range(len(own) - length + 1):
            window = tuple(own[i : i + length])
            least[window] = min(least.get(window, rank(doc)), rank(doc))
    out = []
    for (doc, _), own in zip(docs, split, strict=True):
        gone = [False] * len(own)
        for i in range(len(own) - length + 1):
            if least[tuple(own[i : i + length])] < rank(doc):
                gone[i : i + length] = [True] * length
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((doc, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, spread", [(200, 100), (40, 20)])
def test_bytes_equal_brute_force(spark, sample, odd, length, spread):
    docs = sample[:60] + odd
    got = remove_repeated_bytes(frame(spark, docs), length, spread).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == bytes_brute(docs, length)


@pytest.mark.parametrize("length, spread", [(13, 8), (5, 3)])
def test_words_equal_brute_force(spark, sample, odd, length, spread):
    docs = sample[:80] + odd
    got = remove_repeated_phrases(frame(spark, docs), length, spread).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == words_brute(docs, length)


def test_frequent_cores_are_dealt_by_phrase(spark, sample, odd, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "CORE_SEGMENTS", 2)
    docs = sample[:20] + odd
    got = remove_repeated_phrases(frame(spark, docs), 13).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == words_brute(docs, 13)


def test_equal_phrases_can_be_split_between_automata():
    held = [(doc, 0, 0, ["w"] * 3) for doc in (1, 2, 3)]
    first = phrase_dedup.recurring_phrases(held[:1], 3, {})
    assert first == {}
    later = phrase_dedup.recurring_phrases(held[1:2], 3, {" w w w ": 1})
    assert list(phrase_dedup.find_phrases(held[1:2], later, 3)) == [(2, 0, 0, 3)]


def test_large_cores_are_split_without_forgetting(spark, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "SHARD_CHARS", 3000)
    rnd = np.random.default_rng(4)
    word = lambda: str(rnd.integers(10**9)) * 20
    passage = [word() for _ in range(18)]
    docs = []
    for k in range(60):
        a, b = int(rnd.integers(0, 4)), int(rnd.integers(15, 19))
        docs.append((k, " ".join([*(word() for _ in range(9)), *passage[a:b], *(word() for _ in range(9))])))
    got = remove_repeated_phrases(frame(spark, docs), 13).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == words_brute(docs, 13)


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    codes = np.random.default_rng(5).integers(1, 4, 3000, dtype=np.uint64)
    core = textbytes.Sums(codes).every(6)
    whole = textbytes._anchors(core, 9)
    monkeypatch.setattr(textbytes, "_PLACE", (1 << 6) - 1)
    mixed = core & ~np.uint64(63)
    want = [a + 8 - int(np.argmin(mixed[a : a + 9][::-1])) for a in range(len(core) - 8)]
    assert textbytes._anchors(core, 9).tolist() == want and len(whole) == len(want)


def test_a_text_of_several_stretches(spark):
    rng, n = np.random.default_rng(6), (1 << 22) + 300_000
    letters = lambda k: bytes(rng.integers(97, 123, k, dtype=np.uint8)).decode()
    passage, far = letters(1000), letters(700)
    long = letters(n)
    at = (1 << 22) - 500
    long = long[:at] + passage + long[at + 1000 : -700] + far
    got = remove_repeated_bytes(frame(spark, [(1, long), (2, "x" + passage + "y"), (3, far)])).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {1: (n, 1700, 2), 2: (1002, 1000, 1), 3: (700, 700, 1)}
    words = [letters(6) for _ in range((1 << 22) + 1000)]
    shared = words[(1 << 22) - 20 : (1 << 22) + 20]
    kept = remove_repeated_phrases(frame(spark, [(1, " ".join(shared)), (2, " ".join(words))])).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in kept} == {1: (40, 0), 2: (len(words), 40)}


def test_empty_tables(spark):
    assert remove_repeated_bytes(frame(spark, [])).collect() == []
    assert remove_repeated_phrases(frame(spark, [])).collect() == []
