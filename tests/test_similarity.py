import datetime as dt
import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertmill.functions.distance import near_any, similar_to_any
from alertmill.operators.similarity import is_new, min_distance, suppress_near_duplicates, with_ring

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp, host string, payload string"


def frame(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(microseconds=us), h, t) for i, us, h, t in rows], SCHEMA)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def simulate(rows, per_host=False, samples=20, lifetime_us=300_000_000):
    """The ring as a process keeps it: cyclic slots, expiry blanks a slot."""
    rings, out = {}, {}
    for i, us, host, text in sorted(rows, key=lambda r: (r[1], r[0])):
        ring = rings.setdefault(host if per_host else None, {"slots": [(0, "")] * samples, "at": 0})
        ring["slots"] = [(t, "" if us - t > lifetime_us else s) for t, s in ring["slots"]]
        live = [s for _, s in ring["slots"] if s]
        out[i] = min((distance(s, text) for s in live), default=-1)
        ring["slots"][ring["at"]] = (us, text)
        ring["at"] = (ring["at"] + 1) % samples
    return out


def distances(df, **options):
    ringed = with_ring(df, **options)
    return {r.id: r.d for r in ringed.select("id", min_distance("ring", "payload").alias("d")).collect()}


def random_rows(n, seed, gaps, texts=("link down", "link up", "", "disk full", "a", "link downs")):
    rng, us, rows = random.Random(seed), 0, []
    for i in range(n):
        us += rng.choice(gaps)
        rows.append((i, us, rng.choice("ab"), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("mode", ["tiled", "global", "blocks"])
@pytest.mark.parametrize("gaps", [(0, 1, 1_000_000), (0, 300_000_000, 300_000_001, 7_000_000), (0,)])
def test_modes_equal_the_ring(spark, mode, gaps):
    rows = random_rows(150, 5, gaps)
    assert distances(frame(spark, rows), mode=mode) == simulate(rows)


@pytest.mark.parametrize("mode", ["tiled", "global", "blocks"])
def test_keyed_rings(spark, mode):
    rows = random_rows(150, 9, (0, 20_000_000, 90_000_000))
    assert distances(frame(spark, rows), mode=mode, keys=["host"]) == simulate(rows, per_host=True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([0, 1, 299_999_999, 300_000_000, 300_000_001, 10**6]), st.sampled_from(["", "a", "ab", "xyz"])), min_size=1, max_size=60))
def test_tiles_equal_the_ring_at_the_edges(spark, steps):
    us, rows = 0, []
    for i, (gap, text) in enumerate(steps):
        us += gap
        rows.append((i, us, "h", text))
    assert distances(frame(spark, rows), mode="tiled") == simulate(rows)


def test_one_instant_holding_most_rows_is_cut_into_blocks(spark):
    rows = random_rows(900, 3, (0,)) + [(10_000 + i, 10**9 * (i + 1), "a", "link down") for i in range(50)]
    from alertmill.operators.ordered import previous_rows

    df = frame(spark, rows).withColumn("_us", F.unix_micros("ts"))
    got = previous_rows(df, ["_us", "id"], 20, F.col("id"), "prev", mode="auto", max_group_rows=100, block_rows=64)
    ids = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    want = {i: ids[max(0, n - 20) : n] for n, i in enumerate(ids)}
    assert {r.id: r.prev for r in got.collect()} == want


def test_auto_takes_blocks_when_a_tile_is_full(spark):
    rows = random_rows(300, 4, (0, 1))
    assert distances(frame(spark, rows), mode="auto", max_group_rows=50) == simulate(rows)


def one(spark, *texts):
    return frame(spark, [(i, i, "h", t) for i, t in enumerate(texts)])


def new(df, threshold, **options):
    return [r.id for r in suppress_near_duplicates(df, threshold=threshold, mode="tiled", **options).orderBy("id").collect()]


def test_given_distances(spark):
    assert distances(one(spark, "abc", "abc"), mode="tiled")[1] == 0
    assert distances(one(spark, "abc", "abx"), mode="tiled")[1] == 1
    assert distances(one(spark, "é", "e"), mode="tiled")[1] == 1


def test_given_thresholds(spark):
    assert new(one(spark, "first time message"), 10) == []
    assert new(one(spark, "abc", "abcde"), 2) == [1]
    assert new(one(spark, "abc", "abcde"), 3) == []
    assert new(one(spark, "abc", "abcde"), 20) == []
    assert new(one(spark, "abc", "abc"), 0) == [1]
    assert new(one(spark, "abc", "abc"), -3) == [1]
    assert new(one(spark, "abc", "abcde"), 2, on_empty="send") == [0, 1]


def test_ring_bounds(spark):
    rows = [(0, 0, "h", "target text")] + [(i, i, "h", "z" * 40) for i in range(1, 21)] + [(21, 21, "h", "target text")]
    assert distances(frame(spark, rows), mode="tiled")[21] > 0
    assert distances(frame(spark, rows[:1] + rows[2:]), mode="tiled")[21] == 0
    for gap, want in ((300_000_000, 0), (300_000_001, -1)):
        assert distances(frame(spark, [(0, 0, "h", "x"), (1, gap, "h", "x")]), mode="tiled")[1] == want


def test_unknown_options(spark):
    with pytest.raises(ValueError):
        with_ring(one(spark, "a"), mode="x")
    with pytest.raises(ValueError):
        is_new(F.col("ring"), F.col("t"), on_empty="x")


def test_rows_without_time_are_alike_in_every_mode(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, None, "aaaaaaaaaaaaaaaaaaaaaa"), (2, at, "bbbbbbbbbbbbbbbbbbbbbbbbb"), (3, at, "cccccccccccccccccccccccc")]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, payload string")
    got = [sorted(r.id for r in suppress_near_duplicates(df, on_empty="send", mode=m).collect()) for m in ("global", "tiled", "blocks")]
    assert got[0] == got[1] == got[2] == [1, 2, 3]


def test_similar_to_any_is_exact(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(300):
        text = "".join(rnd.choice("abc{}") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 127, 129, 200, 300])))
        ring = []
        for _ in range(rnd.randrange(6)):
            other = list(text)
            for _ in range(rnd.randrange(24)):
                at = rnd.randrange(len(other) + 1)
                other[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "b", "c", "é" if k % 9 == 0 else "d"])
            ring.append("".join(other))
        rows.append((k, None if k == 7 else text, None if k == 8 else ring))
    df = spark.createDataFrame(rows, "id int, t string, ring array<string>").repartition(3)
    for limit in (0, 3, 13):
        want = F.exists("ring", lambda r: F.levenshtein(r, F.coalesce("t", F.lit("")), limit) >= 0)
        found = df.select("id", want.alias("w"), similar_to_any(F.coalesce("t", F.lit("")), F.col("ring"), limit).alias("g")).collect()
        assert [r.id for r in found if r.w != r.g] == [] and 20 < sum(bool(r.w) for r in found) < 280


def test_short_ascii_texts_are_compared_in_batches():
    texts = pa.array(["kernel panic", "kernel panic", "", "x" * 100, "é", None])
    rings = pa.array([["kernel pAnic!"], ["disk full", "network"], ["a"], ["x" * 98 + "yy", "z"], ["e"], ["a"]])
    assert near_any(texts, rings, 2).to_pylist() == [True, False, True, True, None, None]
