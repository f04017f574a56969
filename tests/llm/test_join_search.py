import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertmill.llm import bmw, partenum
from alertmill.llm.bmw import top_documents
from alertmill.llm.partenum import jaccard_components
from alertmill.llm.scratch import Scratch

from .conftest import ALNUM, WORDS, frame, lower


def sets_of(docs, n):
    out = []
    for _, text in docs:
        own = WORDS.findall(lower(text))
        out.append({tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else {tuple(own)} if own else set())
    return out


def components_brute(docs, n=4, percent=85):
    sets = sets_of(docs, n)
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for gram in own:
            holders[gram].append(k)
    for k, own in enumerate(sets):
        for other in {j for gram in own for j in holders[gram] if j > k}:
            both = len(own & sets[other])
            if 100 * both >= percent * (len(own) + len(sets[other]) - both):
                up[find(k)] = find(other)
    rank = lambda doc: -(1 << 63) if doc is None else doc
    least = {}
    for k, (doc, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), 1 << 62), rank(doc))
    named = [None if least[find(k)] == -(1 << 63) else least[find(k)] for k in range(len(docs))]
    return sorted([(doc, len(s), c) for (doc, _), s, c in zip(docs, sets, named, strict=True)], key=repr)


def near_copies():
    rnd, docs = random.Random(3), []
    for g in range(16):
        base = [str(rnd.randrange(10**6)) for _ in range(rnd.choice([3, 5, 8, 12, 20, 40, 100, 300]))]
        for c in range(8):
            own = base[:]
            for _ in range(rnd.randrange(0, max(2, len(base) // 25))):
                own[rnd.randrange(len(own))] = str(rnd.randrange(10**6))
            if rnd.random() < 0.4:
                own = own[: len(own) - rnd.randrange(0, max(1, len(own) // 8))]
            docs.append((10_000 + g * 100 + c, " ".join(own)))
    return docs


def test_components_equal_brute_force(spark, sample, odd):
    nulls = [d for d in odd if d[0] is not None]
    docs = sample[:60] + nulls + [(None, None)] + near_copies()
    got = jaccard_components(frame(spark, docs)).collect()
    assert sorted(map(tuple, got), key=repr) == components_brute(docs)


def test_similar_sets_share_a_signature_and_pass_the_sketch():
    rnd = np.random.default_rng(1)
    for size in [*range(1, 60), 90, 150, 400]:
        a = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
        for other in range(math.ceil(0.85 * size), int(size / 0.85) + 1):
            both = math.ceil(85 * (size + other) / 185)
            if both > min(size, other):
                continue
            b = np.r_[a[:both], rnd.integers(0, 1 << 63, other - both, dtype=np.uint64)]
            x, y = np.unique(a), np.unique(b)
            if len(x) + len(y) == 2 * both:
                continue  # equal sets are one class
            found, row = partenum.signatures(np.r_[x, y], np.array([0, len(x), len(x) + len(y)]), 85)
            assert set(found[row == 0].tolist()) & set(found[row == 1].tolist()), (size, other)
            one, two = (partenum.cells_of(partenum.sketch(s)) for s in (x, y))
            assert partenum.may_link(one, len(x), two[None, :], np.array([len(y)]), 85).all()


def search_brute(docs, queries, k):
    counts = [Counter(ALNUM.findall(lower(t))) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    average, n = sum(lengths) / len(docs), len(docs)
    df = Counter(w for c in counts for w in c)
    out = []
    for query, text in queries:
        terms, rows = set(ALNUM.findall(lower(text))), []
        for (doc, _), own, length in zip(docs, counts, lengths, strict=True):
            score = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own[w] * 2.2 / (own[w] + 1.2 * (0.25 + 0.75 * length / average)) for w in terms if w in own
            )
            if score > 0:
                rows.append((-round(score, 6), doc))
        out += [(query, rank + 1, doc, -score) for rank, (score, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark, sample, odd, monkeypatch):
    monkeypatch.setattr(bmw, "QUERY_TERMS", 300)
    docs = sample[:120] + [(d, t) for d, t in odd if d is not None and d != 5006] + [(5100, "the of"), (5150, ""), (5200, None)]
    queries = [d for d in docs if d[0] % 50 == 0]
    rows = frame(spark, docs)
    got = top_documents(rows, rows.where("doc_id % 50 = 0"), 10).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in got) == search_brute(docs, queries, 10)


def test_pruning_skips_blocks_and_keeps_the_best(monkeypatch):
    monkeypatch.setattr(bmw, "BLOCK_DOCS", 4)
    rnd = np.random.default_rng(2)
    docs, terms = np.nonzero(rnd.random((200, 30)) < 0.3)
    counts = rnd.integers(1, 9, len(docs))
    order = np.lexsort((docs, terms))
    docs, terms, counts = docs[order], terms[order], counts[order]
    names, first = np.unique(terms, return_index=True)
    lengths = np.bincount(docs, weights=counts, minlength=200).astype("<i4")
    row = {
        "terms": names.astype("<u8").tobytes(), "ends": np.r_[first[1:], len(terms)].astype("<i4").tobytes(), "docs": docs.astype("<i4").tobytes(),
        "counts": counts.astype("<i4").tobytes(), "doc_ids": np.arange(200, dtype="<i8").tobytes(), "lengths": lengths.tobytes(),
    }
    shard = bmw.Shard(row, float(lengths.mean()))
    weights = rnd.random(30)
    ids, scores = shard.best(names.astype(np.uint64), weights, 5)
    total = np.bincount(docs, weights=weights[terms] * shard.impacts, minlength=200)
    assert ids.tolist() == np.lexsort((np.arange(200), -total))[:5].tolist() and np.allclose(scores, total[ids])


def test_search_with_a_known_score_looks_at_few_documents(monkeypatch):
    rnd = np.random.default_rng(4)
    held = rnd.random((4000, 300)) < np.r_[np.full(40, 0.6), np.full(260, 0.02)]
    terms, docs = np.nonzero(held.T)
    counts = rnd.integers(1, 4, len(docs))
    names, first = np.unique(terms, return_index=True)
    lengths = np.bincount(docs, weights=counts, minlength=4000).astype("<i4")
    row = {
        "terms": names.astype("<u8").tobytes(), "ends": np.r_[first[1:], len(terms)].astype("<i4").tobytes(), "docs": docs.astype("<i4").tobytes(),
        "counts": counts.astype("<i4").tobytes(), "doc_ids": np.arange(4000, dtype="<i8").tobytes(), "lengths": lengths.tobytes(),
    }
    shard, weights, scored = bmw.Shard(row, float(lengths.mean())), np.r_[np.full(40, 0.3), np.full(260, 4.0)], []
    plain = bmw.Shard._scores
    monkeypatch.setattr(bmw.Shard, "_scores", lambda self, found, wanted: scored.append(len(found)) or plain(self, found, wanted))
    shard.weigh(names.astype(np.uint64), weights)
    queries = [np.flatnonzero(held[k]) for k in range(0, 4000, 400)]
    totals = [np.bincount(docs, weights=(weights * held[k])[terms] * shard.impacts, minlength=4000) for k in range(0, 4000, 400)]
    least = np.array([np.sort(t)[-10] for t in totals]) * (1 - 1e-12)
    for found, total in zip((list(shard.search(queries, x, 10)) for x in (np.zeros(10), least)), (totals, totals), strict=True):
        for (ids, scores), t in zip(found, total, strict=True):
            assert ids.tolist() == np.lexsort((np.arange(4000), -t.round(9)))[:10].tolist() and np.allclose(scores, t[ids])
    assert sum(scored[-10:]) < 300  # of 40000


def test_search_from_a_low_score_looks_at_few_documents(monkeypatch):
    """A score that half the shard reaches says little; the k best of the shard are told apart before any is scored."""
    rnd = np.random.default_rng(8)
    held = rnd.random((3000, 400)) < np.r_[np.full(60, 0.5), np.full(340, 0.03)]
    held[:, 399] = np.arange(3000) % 7 == 0
    terms, docs = np.nonzero(held.T)
    names, first = np.unique(terms, return_index=True)
    lengths = np.maximum(held.sum(axis=1), 1).astype("<i4")
    row = {
        "terms": names.astype("<u8").tobytes(), "ends": np.r_[first[1:], len(terms)].astype("<i4").tobytes(), "docs": docs.astype("<i4").tobytes(),
        "counts": np.ones(len(docs), dtype="<i4").tobytes(), "doc_ids": np.arange(3000, dtype="<i8").tobytes(), "lengths": lengths.tobytes(),
    }
    shard, weights, scored = bmw.Shard(row, float(lengths.mean())), np.r_[np.full(60, 0.5), np.full(340, 5.0)], []
    shard.weigh(names.astype(np.uint64), weights)
    plain = bmw.Shard._scores
    monkeypatch.setattr(bmw.Shard, "_scores", lambda self, found, wanted: scored.append(len(found)) or plain(self, found, wanted))
    queries = [*(np.flatnonzero(held[k]) for k in range(0, 3000, 300)), np.array([399]), np.zeros(0, dtype=np.int64)]
    asked = [np.isin(np.arange(400), q) for q in queries]
    totals = [np.bincount(docs, weights=(weights * a)[terms] * shard.impacts, minlength=3000) for a in asked]
    least = np.array([*(np.median(t) for t in totals[:10]), 1.0, 1.0])
    for (ids, scores), t in zip(shard.search(queries, least, 10), totals, strict=True):
        best = np.lexsort((np.arange(3000), -t.round(9)))[:10]
        assert ids.tolist() == best[t[best] >= 1.0].tolist() and np.allclose(scores, t[ids])
    assert sum(scored) < 1000  # of 16000 that reach the score; only the query of one term has many equal ones
    out_of_reach = np.array([t.max() * 1.01 for t in totals])
    assert [len(ids) for ids, _ in shard.search(queries, out_of_reach, 10)] == [0] * 12


def test_documents_that_are_alike_share_shards(spark, sample, monkeypatch):
    """Shards by a column, of whatever size the rest of them has, hold every document once and give the same best."""
    monkeypatch.setattr(bmw, "SHARD_DOCS", 20)
    monkeypatch.setattr(bmw, "FIRST_SHARDS", 1)  # of 7 shards: all, in two rounds
    docs = sample[:90] + [(7000 + k, sample[k % 3][1]) for k in range(30)]
    rows = frame(spark, docs).withColumn("kind", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 2))
    queries = [d for d in docs if d[0] % 50 == 0]
    got = top_documents(rows, rows.where("doc_id % 50 = 0"), 10, alike="kind").collect()
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in got) == search_brute(docs, queries, 10)
    for shards in (bmw.index_shards(rows.coalesce(1)), bmw.index_shards(rows.repartition(3))):
        sizes = [np.frombuffer(r.doc_ids, "<i8") for r in shards.collect()]
        assert sorted(np.concatenate(sizes).tolist()) == sorted(d[0] for d in docs)
        assert all(len(x) >= 10 for x in sizes)


@pytest.mark.parametrize("first_shards", [1, 2, 1 << 40])
def test_shards_searched_first_do_not_change_the_best(spark, sample, monkeypatch, first_shards):
    monkeypatch.setattr(bmw, "SHARD_DOCS", 10)
    monkeypatch.setattr(bmw, "FIRST_SHARDS", first_shards)
    docs = sample[:90] + [(7000 + k, sample[k % 3][1]) for k in range(30)]  # copies reach equal scores
    rows = frame(spark, docs)
    got = top_documents(rows, rows.where("doc_id % 50 = 0"), 10).collect()
    queries = [d for d in docs if d[0] % 50 == 0]
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in got) == search_brute(docs, queries, 10)


def test_empty_tables(spark):
    assert jaccard_components(frame(spark, [])).collect() == []
    empty = frame(spark, [])
    assert top_documents(empty, empty).collect() == []


def told_apart():
    """Rows without id and with repeated ids, among near copies and exact copies with an id."""
    rnd, docs = random.Random(5), []
    for g in range(6):
        base = [str(rnd.randrange(10**6)) for _ in range(60)]
        near = [*base[:59], "x"]
        docs += [(None, " ".join(base)), (20_000 + g, " ".join(base)), (20_100 + g % 2, " ".join(near)), (20_200 + g, f"y {g} z " * 40)]
    return docs + [(None, f"only {k} once " + " ".join(str(rnd.randrange(10**6)) for _ in range(40))) for k in range(6)]


def test_rows_without_or_with_repeated_ids_are_told_apart(spark, odd):
    docs = told_apart() + odd + near_copies()[:40]
    got = jaccard_components(frame(spark, docs)).collect()
    assert sorted(map(tuple, got), key=repr) == components_brute(docs)


def test_rows_without_id_keep_two_components_apart(spark):
    docs = [(None, "a b c d e f"), (None, "u v w x y z"), (7, "a b c d e f"), (9, "u v w x y z")]
    kept = partenum.one_of_each_component(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(None, "a b c d e f"), (None, "u v w x y z")]


def test_one_row_of_each_component(spark):
    docs = told_apart() + [(None, None), (None, ""), (None, ""), (30_000, ""), (30_000, " ")]
    kept = partenum.one_of_each_component(frame(spark, docs)).collect()
    of = {}  # distinct rows stand for themselves, so that a component is told by its members
    named = list(dict.fromkeys(docs))
    for k, _, c in components_brute([(k, t) for k, (_, t) in enumerate(named)]):
        of[named[k]] = c
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept) == len(set(of.values()))
    assert {of[r.doc_id, r.text] for r in kept} == set(of.values())
    rank = lambda doc: -1 if doc is None else doc
    assert all(rank(r.doc_id) == min(rank(d) for (d, t), c in of.items() if c == of[r.doc_id, r.text]) for r in kept)


def test_tables_of_a_small_corpus_are_written_by_few_tasks(spark, monkeypatch):
    files, write = {}, Scratch.write

    def counted(self, df, name):
        table = write(self, df, name)
        files[name] = max(files.get(name, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(Scratch, "write", counted)
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    docs = near_copies()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = jaccard_components(frame(spark, docs)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=repr) == components_brute(docs)
    assert len(files) > 5 and max(files.values()) <= spark.sparkContext.defaultParallelism, files


def test_many_links_are_resolved_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(partenum, "HELD_LINKS", 0)
    docs = near_copies()
    got = jaccard_components(frame(spark, docs)).collect()
    assert sorted(map(tuple, got), key=repr) == components_brute(docs)


def test_least_reachable_of_chains_and_rings():
    rnd = np.random.default_rng(6)
    chains = [rnd.permutation(400) + 1000 * k for k in range(5)]
    a, b = np.concatenate([c[:-1] for c in chains] + [[9000, 9001, 9002]]), np.concatenate([c[1:] for c in chains] + [[9001, 9002, 9000]])
    nodes, least = partenum.least_reachable(a, b)
    assert nodes.tolist() == sorted({*a.tolist(), *b.tolist()}) and least.tolist() == [n // 1000 * 1000 for n in nodes.tolist()]
