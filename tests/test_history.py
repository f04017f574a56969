import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from alertmill.operators.documents import pages
from alertmill.operators.history import bin_bits, item_history, items_at, moment_of

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LOG = "list_name string, id bigint, op string, pattern string, expired_at timestamp, ts timestamp, seq bigint"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def random_log(n=400):
    rnd, rows = random.Random(9), []
    for seq in range(n):
        minutes = rnd.randrange(0, 3000)
        add = rnd.random() < 0.65
        expires = None if rnd.random() < 0.2 else at(minutes + rnd.choice([-1, 0, 1, 30, 400, 100_000]))
        rows.append((rnd.choice(["a", "b"]), rnd.choice([1, 1, 1, 2, 3, 4]), "add" if add else "rm", f"p{seq}" if add else None, expires if add else None, at(minutes), seq))
    return rows


def replayed(log, list_name, moment):
    state = {}
    for name, key, op, pattern, expires, ts, seq in sorted(log, key=lambda r: (r[5], r[6])):
        if name != list_name or (ts, seq) >= moment:
            continue
        live = key in state and (state[key][1] is None or state[key][1] >= ts)
        if op == "rm":
            state.pop(key, None)
        elif not live and (expires is None or expires >= ts):
            state[key] = (pattern, expires)
    return {k: p for k, (p, e) in state.items() if e is None or e >= moment[0]}


@pytest.mark.parametrize("limit", [None, 60])
def test_items_at_every_moment(spark, limit, monkeypatch):
    if limit:  # an id with most of the commands, in blocks
        monkeypatch.setattr("alertmill.operators.ordered.BLOCK_ROWS", 50)
    log = random_log()
    history = item_history(spark.createDataFrame(log, LOG), limit)
    moments = [(name, at(m), seq) for name in ("a", "b", "none") for m, seq in [(-5, 3), (0, 0), (1, 1000), (777, 200), (1500, 0), (2999, 10**6), (90_000, 5)]]
    moments += [(r[0], r[5], r[6]) for r in log[::7]]
    given = spark.createDataFrame(moments, "list_name string, ts timestamp, seq bigint").selectExpr("list_name", "unix_micros(ts) AS at_us", "seq AS at_seq")
    got = {}
    for r in items_at(given, history).collect():
        got.setdefault((r.list_name, r.at_us, r.at_seq), {})[r.id] = r.pattern
    micros = lambda ts: int((ts - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))
    for name, ts, seq in moments:
        assert got.get((name, micros(ts), seq), {}) == replayed(log, name, (ts, seq)), (name, ts, seq)


def test_nothing_asked_and_no_commands(spark):
    moments = spark.createDataFrame([], "list_name string, at_us bigint, at_seq bigint")
    history = item_history(spark.createDataFrame([], LOG))
    assert items_at(moments, history).collect() == []
    assert items_at(spark.createDataFrame([("a", 5, 5)], moments.schema), history).collect() == []


def test_bins_follow_the_intervals(spark, monkeypatch):
    assert bin_bits(0) == bin_bits(60_000) == 12 and bin_bits(800_000) == 18 and bin_bits(30_000_000) == 21
    commands = [("l", k % 7, "add" if k % 3 else "rm", f"p{k % 7}" if k % 3 else None, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * k), k) for k in range(400)]
    log = spark.createDataFrame(commands, "list_name string, id bigint, op string, pattern string, ts timestamp, seq bigint").withColumn("expired_at", F.lit(None).cast("timestamp"))
    asked = log.where("seq % 5 = 0").select("list_name", *moment_of("ts", "seq"))
    past = item_history(log)
    want = sorted(items_at(asked, past).collect())
    monkeypatch.setattr("alertmill.operators.history.bin_bits", lambda n: 15)
    assert sorted(items_at(asked, past).collect()) == want and len(want) > 100


def test_documents_known_to_be_short_need_no_running_sizes(spark):
    rows = spark.createDataFrame([(k % 3, k, f"line {k}") for k in range(50)], "key int, at bigint, line string")
    whole = pages(rows, ["key"], "at", F.col("line"))
    short = pages(rows, ["key"], "at", F.col("line"), most_bytes=1000)
    assert sorted(short.collect()) == sorted(whole.collect()) and short.columns == whole.columns
    assert "Window" in whole._jdf.queryExecution().toString() and "Window" not in short._jdf.queryExecution().toString()
    assert pages(rows, ["key"], "at", F.col("line"), page_bytes=64, most_bytes=1000).count() > 3
