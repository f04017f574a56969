import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from alertmill.llm import dac, packing, tokens
from alertmill.llm.textbytes import lean
from alertmill.llm.tokens import byte_bpe_path, encoder
from alertmill.storage import new_table_path

from .conftest import frame


@pytest.fixture(scope="module")
def ids(sample, odd):
    whole = Tokenizer.from_file(byte_bpe_path())
    return lambda docs: [list(x.ids) for x in whole.encode_batch_fast([t or "" for _, t in docs], add_special_tokens=False)]


def test_encoder_equals_the_library(ids):
    texts = [
        "", "  a b", " a", "a ", "a  b", "日本 語 <|endoftext|> x", "it's  'll\n\n x\ty", "a\n b", "é è́ 🙂 x", "1 22 3a_b--c", "a\r\n b\x0b c",
        "x   y", "α β ɐ", " ", "word word word", "　a  b",
    ]
    assert [encoder(byte_bpe_path()).ids(t).tolist() for t in texts] == ids([(0, t) for t in texts])


def test_encoder_equals_the_library_on_mixed_characters(monkeypatch):
    """Plain words are split without the pattern; the words kept are merged and emptied in between."""
    monkeypatch.setattr(tokens, "KEPT_WORDS", 2000)
    monkeypatch.setattr(tokens, "RECENT_WORDS", 30)
    pieces = [*"abXY01 ,.-'<|>_\n\t\r", "  ", "é", "×", "÷", "ß", "ɏ", "ɐ", "¿", "日", "🙂", "'s", "<|endoftext|>", "\u0301", "\xa0", "\x7f"]
    rng = np.random.default_rng(9)
    own, whole = tokens.Encoder(byte_bpe_path()), Tokenizer.from_file(byte_bpe_path())
    for _ in range(300):
        texts = ["".join(rng.choice(pieces, n)) for n in rng.choice([0, 1, 2, 9, 40], 5)]
        raw = [t.encode() for t in texts]
        ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_learning_a_few_words_passes_over_a_few():
    """What one slice of text takes does not grow with the words that the worker keeps."""
    own = tokens.Encoder(byte_bpe_path())
    own.ids(" ".join(f"w{''.join(chr(97 + int(d)) for d in str(k))}" for k in range(200_000)))
    peaks = []
    for k in range(9):
        tracemalloc.start()
        assert len(own.ids(f"new{'abcdefghi'[k]}qx words{'abcdefghi'[k]}qx"))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert sorted(peaks)[4] < 500_000


def test_packing_loses_nothing_and_is_tight(spark, sample, odd, ids):
    docs = [d for d in sample + odd if d != (None, None)]
    rows = packing.pack_documents(frame(spark, docs), byte_bpe_path(), 1024, 2).collect()
    want = sorted((d[0] is None, d[0], tuple(i + [2])) for d, i in zip(docs, ids(docs), strict=True))
    whole = sorted((doc is None, doc or 0, piece, start, n, crc) for doc, piece, start, n, crc, _, _ in rows)
    expected = []
    for missing, doc, own in want:
        at, raw = 0, np.array(own, "<u4")
        for piece, n in enumerate(packing.cut_lengths(len(own), 1024)):
            expected.append((missing, doc or 0, piece, at, n, zlib.crc32(raw[at : at + n].tobytes())))
            at += n
    assert whole == sorted(expected)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024
    assert len(filled) <= 1.03 * -(-sum(filled.values()) // 1024) + 1


def test_large_pieces_are_matched_in_pairs():
    counts = {700: 3, 400: 2, 324: 3, 600: 1, 341: 2, 100: 5}
    used, bins = {}, {}
    for length, first, number, first_bin, per_bin, offset in packing.plan_bins(counts, 1024):
        assert first == used.get(length, 0)
        used[length] = first + number
        for k in range(number):
            bins.setdefault(first_bin + k // per_bin, []).append((offset + k % per_bin * length, length))
    assert used == counts
    for own in bins.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at <= 1024 and sum(3 * n > 1024 for _, n in own) <= 2


def test_codes_give_any_token():
    rng = np.random.default_rng(4)
    for size in (1, 7, 513, 5000):
        values = np.r_[rng.integers(0, 300, size), rng.integers(0, 1 << 24, size // 3), 255, 256, 65535, 65536].astype(np.uint32)
        codes = dac.Codes(dac.pack_codes(values))
        assert (codes.all() == values).all()
        places = rng.integers(0, len(values), 200)
        assert (codes.at(places) == values[places]).all()
    with pytest.raises(IndexError):
        codes.at(np.array([len(values)]))
    with pytest.raises(ValueError):
        dac.Codes(b"none" + bytes(20))


def test_token_files_come_back_in_order(spark, sample, odd, ids, monkeypatch):
    docs = sorted([d for d in sample + odd if d[0] is not None and d[0] != 5006])
    path = new_table_path(spark, "token-test")
    dac.write_token_files(frame(spark, docs), path, byte_bpe_path(), 0)
    got = sorted(map(tuple, dac.read_token_files(spark, path).collect()))
    want, at = [], 0
    for (doc, _), own in zip(docs, ids(docs), strict=True):
        raw = np.array([*own, 0], "<u4")
        want.append((doc, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    assert got == want
    first = spark.read.parquet(path).orderBy("part", "segment").first()
    asked = spark.createDataFrame([(first.part, first.segment, k) for k in (0, 1, first.n_tokens - 1, first.n_tokens)], "part int, segment int, place long")
    tokens = {r.place: r.token for r in dac.tokens_at(spark, path, asked).collect()}
    assert set(tokens) == {0, 1, first.n_tokens - 1} and tokens[first.n_tokens - 1] == 0


def test_empty_tables(spark):
    assert packing.pack_documents(frame(spark, []), byte_bpe_path()).collect() == []
    assert dac.token_table(frame(spark, []), byte_bpe_path()).collect() == []


def test_packing_encodes_little_text_at_once(monkeypatch):
    """A worker holds several times what it encodes at once."""
    class Caught:
        select = lambda self, *a: self
        mapInArrow = lambda self, work, schema: work

    class Counting:
        seen = []

        def encode(self, data, offsets):
            self.seen.append((len(data), len(offsets) - 1))
            return np.zeros(len(offsets) - 1, "<u4"), np.arange(len(offsets))

    monkeypatch.setattr(packing, "encoder", lambda path: Counting())
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing.F, "col", lambda name: SimpleNamespace(alias=lambda other: None))
    texts = ["x" * 10_000] * 100 + ["y" * 700_000, None]
    work = packing.token_pieces(Caught(), "", 1024, 2)
    rows = [r for b in work(iter([pa.RecordBatch.from_arrays([pa.array(range(102)), pa.array(texts)], names=["doc_id", "text"])])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(102)) and sum(n for n, _ in Counting.seen) == 1_700_000
    assert all(n <= 1 << 18 or texts == 1 for n, texts in Counting.seen)


def test_a_worker_gives_back_what_it_has_freed():
    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024

    def work(batches):
        kept = []
        for batch in batches:
            held = [bytes(1000) for _ in range(100_000)]
            kept.append(held[-1])  # at the end of what was taken, so that the C library does not give back the rest by itself
            del held
            yield batch

    before = resident()
    assert list(lean(work)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 40
