import hashlib
import os
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertmill.llm import fm_index, nbsvm, packing, pii, tokens
from alertmill.llm.fm_index import find_contamination

from .conftest import ALNUM, frame, lower


def contamination_brute(docs, items, length=13):
    windows = {}
    for name, text in items:
        own = ALNUM.findall(lower(text))
        for i in range(max(1, len(own) - length + 1)) if own else ():
            windows.setdefault(tuple(own[i : i + length]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        own = ALNUM.findall(lower(text))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (w := tuple(own[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[w]
        out.append((doc, len(own), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_contamination_equals_brute_force(spark, sample, odd, block, monkeypatch):
    monkeypatch.setattr(fm_index, "PHRASE_BLOCK_BYTES", block)
    passage = " ".join(ALNUM.findall(lower(sample[7][1]))[3:40])
    items = [("1", passage), ("2", "A a"), ("3", None), ("4", "..."), ("5", sample[9][1]), ("5", passage.upper()), ("null", "語")]
    benchmark = spark.createDataFrame([(None if n == "null" else int(n), t) for n, t in items], "item_id long, text string")
    docs = sample[:40] + [d for d in odd if d != (None, None)] + [(7000, "x " * 50 + passage + " y" * 3000), (7001, passage.replace(" ", " -\n"))]
    got = find_contamination(frame(spark, docs), benchmark).drop("spans").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got), key=repr) == contamination_brute(docs, items)


def test_spans_name_words_and_bytes(spark):
    benchmark = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    row = find_contamination(frame(spark, [(1, "é B, c. d b c")]), benchmark).first()
    assert [tuple(s) for s in row.spans] == [(1, 3, 3, 7), (4, 6, 11, 14)]


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(6)
    symbols = np.r_[0, rng.integers(1, 5, 300), 0, rng.integers(1, 5, 200), 0, [2] * 60, 0]
    index = fm_index.FMIndex(symbols, 5)
    for size in (1, 2, 5, 9):
        rows = np.array([symbols[k : k + size] for k in (3, 100, 310, 510)])
        low, high = index.search(rows, np.full(4, size))
        for own, a, b in zip(rows, low, high, strict=True):
            want = [k for k in range(len(symbols) - size + 1) if (symbols[k : k + size] == own).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_classifier_tells_the_labels_apart(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = nbsvm.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.85
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_classifier_never_learns_from_held_out_labels(spark, sample):
    docs = frame(spark, sample[:60])
    labels = [(k, k % 2) for k in range(60)]
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q) for k, q in labels]
    one, two = (nbsvm.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert (one.weights == two.weights).all() and one.shift == two.shift


def test_classifier_on_odd_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nbsvm.classify(frame(spark, odd), none).collect()} == {0.5}
    one = spark.createDataFrame([(5001, 1), (5001, 1), (5002, 1), (None, 0), (5003, None)], "doc_id long, quality int")
    scores = [r.score for r in nbsvm.classify(frame(spark, odd), one).collect()]
    assert len(scores) == len(odd) and all(0.5 < s < 1 for s in scores)
    assert nbsvm.classify(frame(spark, []), none).collect() == []


def test_classifier_keeps_little_beside_the_places():
    rnd = np.random.default_rng(3)
    places = [np.sort(rnd.choice(1 << nbsvm.FEATURE_BITS, 4000, replace=False)).astype(np.int32) for _ in range(2500)]
    tracemalloc.start()
    model = nbsvm.fit(places, np.arange(2500) % 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any() and most < 0.5 * sum(p.nbytes for p in places)


def test_scores_do_not_depend_on_slices_or_on_where_the_text_lies(spark, sample, odd, monkeypatch):
    docs = frame(spark, sample[:60] + odd)
    model = nbsvm.train(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    want = sorted((str(r.doc_id), r.score) for r in nbsvm.score(docs.select("doc_id", "text"), model).collect())
    monkeypatch.setattr(nbsvm, "WORK_BYTES", 1 << 10)
    rows = nbsvm.score(docs.select(F.struct("doc_id", "text").alias("_row")), model, keep=("_row",), inside="_row").collect()
    assert model.weights.any() and sorted((str(r["_row"].doc_id), r.score) for r in rows) == want


def test_classifier_gives_encoders_up(spark):
    flat = np.zeros(1 << nbsvm.FEATURE_BITS)
    model, path = nbsvm.Model(flat, flat, 0.0, 1.0, 0.0), tokens.byte_bpe_path()

    def load(batches):
        for batch in batches:
            tokens.encoder(path)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("id"), "text": ["x"] * len(batch)})

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [tokens.encoder.cache_info().currsize]})

    loaded = spark.range(4, numPartitions=1).mapInArrow(load, "doc_id long, text string").collect()
    docs = spark.createDataFrame(loaded).coalesce(1)
    for _ in range(8):  # idle workers take turns
        nbsvm.score(docs, model).collect()
    rows = [r for _ in range(8) for r in spark.range(1, numPartitions=1).mapInArrow(kept, "pid long, n long").collect()]
    assert len(loaded) == 4 and all(r.n == 0 for r in rows)


FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(digits[::-1])) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in text.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def base_brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in FORMATS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PERSONAL = [
    (1, None), (2, ""), (3, "a@b.c_d@e.f.g x@y a@b.. @b.c é🙂 q@w.e"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 001.0002.3.255 99999999999.1.1.1"),
    (5, "4111 1111 1111 1111 4111-1111-1111-1112 " + "1 " * 900), (6, "+1 (555) 555-1234 +123 +1     . +12-34-56-78 ++1 222 333 4444-"),
    (7, "x" * 3000 + "@"), (8, "a." * 600 + "@b" + ".c" * 600), (9, "1." * 1000), (10, "+" + "1 " * 1000), (10, "+" + "1 " * 1000), (11, "7" * 2000),
    (12, 'token = "abcdef0123456789abcdef0123456789" mail me@x.org'),
]


def test_base_spans_equal_the_formats(spark, sample):
    docs = PERSONAL + sample[:60]
    got = pii.find_personal_data(frame(spark, docs)).select("doc_id", pii.span_text(F.concat(*[F.col(f"base_{k}") for k in pii.BASE])).alias("s")).collect()
    assert sorted(map(tuple, got)) == sorted((d, ",".join(base_brute(t))) for d, t in docs)


def test_long_texts_stay_cheap(spark):
    docs = [(1, "x" * 200_000 + "@"), (2, "1." * 50_000), (3, "7" * 200_000), (4, "a." * 50_000 + "@b" + ".c" * 50_000)]
    sizes = pii.find_personal_data(frame(spark, docs)).select("doc_id", *[F.size(f"base_{k}").alias(k) for k in pii.BASE]).collect()
    assert {r.doc_id: (r.email, r.ip, r.card, r.phone) for r in sizes} == {1: (0, 0, 0, 0), 2: (0, 12_500, 0, 0), 3: (0, 0, 0, 0), 4: (1, 0, 0, 0)}


def test_votes_add_secrets_and_redaction_keeps_the_rest(spark):
    secrets = [(k, f"some plain words before token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" and after, mail a{k}@b.org now") for k in range(60)]
    plain = [(100 + k, f"plain words only, number {k} of the list and nothing else") for k in range(60)]
    rows = frame(spark, secrets + plain)
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(rows).collect()}
    assert all(found[k] == ["email", "secret"] for k in range(60)) and not any(found[100 + k] for k in range(60))
    text = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert text[3] == 'some plain words before token = "[SECRET]" and after, mail [EMAIL] now' and text[103] == plain[3][1]
    assert pii.redact(rows).columns == rows.columns


def test_reliable_labelers_are_found():
    patterns = [((1, 1, 0), 80.0), ((-1, -1, 1), 300.0), ((-1, -1, -1), 300.0), ((1, 1, -1), 80.0)]
    right, prior, after = pii.estimate(patterns)
    assert right[0][0] > 0.9 and right[1][1] > 0.9 and 0.1 < prior < 0.35
    assert after[(1, 1, 0)] > 0.9 and after[(-1, -1, 1)] < 0.1


def test_empty_table(spark):
    assert pii.find_personal_data(frame(spark, [])).collect() == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(frame(spark, []), empty).collect() == []
    assert [r.n_hit for r in find_contamination(frame(spark, [(1, "a b")]), empty).collect()] == [0]
