import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from alertmill.functions.text import PROBE_TEMPLATE
from alertmill.operators.patterns import literal_patterns
from alertmill.operators.similarity import suppress_near_duplicates, with_ring
from alertmill.plans.notify import notify_pipeline
from alertmill.operators.delivery import first_arrivals
from alertmill.operators.outbox import read_outbox
from alertmill.streaming.arrivals import first_arrivals_stream
from alertmill.streaming.delivery import undelivered_stream
from alertmill.streaming.pipeline import notify_batches, start_notify
from alertmill.streaming.refresh import ListVersions, RefreshedPatterns, RefreshedTable
from alertmill.streaming.ring import CarriedRing, keyed_ring, ring_by_batches

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp, host string, payload string"


def rows(n, seed=1, gap=25):
    rng, out, t = random.Random(seed), [], T0
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, gap]))
        out.append((i, t, rng.choice("ab"), rng.choice(["link down", "link up", "disk full on root", ""])))
    return out


def write_batches(spark, data, folder, size, schema=SCHEMA):
    for i in range(0, len(data), size):
        spark.createDataFrame(data[i : i + size], schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def finish(frame, tmp_path, name):
    out = str(tmp_path / name)
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(
        availableNow=True
    ).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(out)


def test_keyed_ring_equals_batch(spark, tmp_path):
    data = rows(120)
    write_batches(spark, data, tmp_path / "in", 30)
    done = finish(keyed_ring(stream(spark, tmp_path / "in"), "host"), tmp_path, "ring")
    want = with_ring(spark.createDataFrame(data, SCHEMA), keys=["host"], mode="global")
    assert {r.id: r.ring for r in done.collect()} == {r.id: r.ring for r in want.collect()}


def test_keyed_ring_drops_late_rows(spark, tmp_path):
    data = [(1, T0, "a", "x"), (2, T0 + dt.timedelta(hours=1), "a", "y")]
    data += [(3, T0 + dt.timedelta(hours=1, seconds=1), "a", "z"), (4, T0, "a", "late")]
    write_batches(spark, data, tmp_path / "in", 1)
    done = finish(keyed_ring(stream(spark, tmp_path / "in"), "host", watermark="1 minute"), tmp_path, "late")
    assert {r.id for r in done.collect()} == {1, 2, 3}


@pytest.mark.parametrize("keys", [None, ["host"]])
def test_carried_ring_equals_batch(spark, tmp_path, keys):
    data = rows(100, 2)
    write_batches(spark, data, tmp_path / "in", 20)
    out = str(tmp_path / "out")
    run = ring_by_batches(
        str(tmp_path / "state"), lambda df, b: df.write.mode("overwrite").parquet(f"{out}/batch_id={b}"), keys=keys, threshold=5, mode="tiled"
    )
    stream(spark, tmp_path / "in").writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "log")).trigger(
        availableNow=True
    ).start().awaitTermination()
    want = suppress_near_duplicates(spark.createDataFrame(data, SCHEMA), threshold=5, keys=keys, mode="global")
    got = spark.read.parquet(out)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_a_replayed_batch_decides_the_same(spark, tmp_path):
    first, second = (spark.createDataFrame(d, SCHEMA) for d in (rows(30, 3), [(100, T0 + dt.timedelta(seconds=700), "a", "link down")]))
    ring = CarriedRing(str(tmp_path / "state"))
    ring.store(first, 0)
    before = ring.ringed(second, 1, "tiled").collect()
    ring.store(second, 1)
    assert ring.ringed(second, 1, "tiled").collect() == before
    ring.store(second, 1)
    assert spark.read.parquet(str(tmp_path / "state" / "batch_id=1")).count() == 20
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "3")
    try:
        for batch in range(2, 8):
            ring.store(second, batch)
        assert ring._batches(spark) == [4, 5, 6, 7]
        with pytest.raises(RuntimeError, match="is gone"):
            ring.ringed(second, 2)
    finally:
        spark.conf.unset("spark.sql.streaming.minBatchesToRetain")


def test_carried_ring_forgets_keys_that_fell_silent(spark, tmp_path):
    ring = CarriedRing(str(tmp_path / "state"), ["host"])
    day = 86_400
    for batch in range(3):
        rows = [(f"h{batch}-{k}", batch * 100 + k, dt.datetime.fromtimestamp(batch * day + k, dt.timezone.utc), "x") for k in range(50)]
        ring.store(spark.createDataFrame(rows, "host string, id bigint, ts timestamp, payload string"), batch)
    assert spark.read.parquet(str(tmp_path / "state" / "batch_id=2")).count() == 50


def test_lists_refresh_and_keep_the_last_good_one(spark):
    now, loads = [0.0], []

    def load(_):
        loads.append(now[0])
        if now[0] == 200:
            raise OSError("gone")
        return spark.createDataFrame([] if now[0] == 600 else [(f"p{int(now[0])}",)], "pattern string")

    ban = RefreshedPatterns(load, clock=lambda: now[0])
    routes = RefreshedPatterns(load, keep_when_empty=True, clock=lambda: now[0])
    seen = []
    for t in (0, 100, 200, 400, 600):
        now[0] = t
        seen.append(([p for _, p, _ in ban.current(spark).literals], [p for _, p, _ in routes.current(spark).literals]))
    assert seen == [(["p0"], ["p0"]), (["p0"], ["p0"]), (["p0"], ["p0"]), (["p400"], ["p400"]), ([], ["p400"])]
    assert loads == [0, 0, 200, 200, 400, 400, 600, 600]
    lines = RefreshedTable(load, period_s=50, clock=lambda: now[0])
    now[0] = 0
    assert lines.current(spark).collect()[0].pattern == "p0"
    now[0] = 200
    assert lines.current(spark).collect()[0].pattern == "p0"


def test_delivery_on_streams(spark, tmp_path):
    def at(s):
        return T0 + dt.timedelta(seconds=s)

    probes = [(1, at(0)), (2, at(20)), (3, at(40)), (4, at(1000))]
    arrived = [(f"1, {PROBE_TEMPLATE}", at(3)), (f"2, {PROBE_TEMPLATE}", at(31)), ("noise", at(45)), (f"4, {PROBE_TEMPLATE}", at(1001))]
    write_batches(spark, probes, tmp_path / "p", 2, "nonce bigint, sent_at timestamp")
    write_batches(spark, arrived, tmp_path / "m", 2, "payload string, arrived_at timestamp")
    lost = undelivered_stream(
        stream(spark, tmp_path / "p", "nonce bigint, sent_at timestamp"), stream(spark, tmp_path / "m", "payload string, arrived_at timestamp")
    )
    assert {r.nonce for r in finish(lost, tmp_path, "lost").collect()} == {"2", "3"}


def payload(host, severity, msg):
    return json.dumps({"host": host, "severity": severity, "facility": "app", "timestamp": "t", "msg": msg})


def test_notify_stream_equals_batch(spark, tmp_path):
    rng, data, t = random.Random(7), [], T0
    for i in range(90):
        t += dt.timedelta(seconds=rng.choice([0, 5, 40]))
        body = payload(rng.choice(["sw-1", "sw-2"]), rng.choice(["err", "debug", "info"]), rng.choice(["link down", "fan broke loudly", "all fine"]))
        data.append((i, t, body if i % 13 else body[:-4]))
    schema = "id bigint, ts timestamp, payload string"
    write_batches(spark, data, tmp_path / "in", 30, schema)
    ban, notify = [(None, '"severity":"debug"'), (None, "(")], [(None, "sw-[0-9]"), (None, "fan")]

    def patterns(pairs):
        return RefreshedPatterns(lambda s: s.createDataFrame([(p,) for _, p in pairs], "pattern string"))

    start_notify(
        stream(spark, tmp_path / "in", schema), str(tmp_path / "log"), available_now=True, ban=patterns(ban), notify=patterns(notify), to="-5",
        outbox=str(tmp_path / "out"), ring_path=str(tmp_path / "ring"), threshold=3,
    ).awaitTermination()
    df = spark.createDataFrame(data, schema)
    want = notify_pipeline(df, literal_patterns(spark, ban), literal_patterns(spark, notify), threshold=3)
    got = read_outbox(spark, str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert want.count() > 3
    assert {(r.chat_id, r.parse_mode) for r in got.collect()} == {(-5, "HTML")}
    with pytest.raises(Exception, match="notify list is empty"):
        start_notify(
            stream(spark, tmp_path / "in", schema), str(tmp_path / "log2"), available_now=True, ban=patterns(ban), notify=patterns([]), to="-5",
            outbox=str(tmp_path / "out2"), ring_path=str(tmp_path / "ring2"),
        ).awaitTermination()
    start_notify(
        stream(spark, tmp_path / "in", schema), str(tmp_path / "log3"), available_now=True, ban=patterns(ban), notify=patterns([]), to="-5",
        outbox=str(tmp_path / "out3"), ring_path=str(tmp_path / "ring3"), when_empty="skip",
    ).awaitTermination()
    assert not (tmp_path / "out3").exists()
    fanned = notify_pipeline(df, literal_patterns(spark, ban), literal_patterns(spark, notify), threshold=3, fanout="pattern")
    assert fanned.select("id").distinct().count() == fanned.count()


def state_rows(spark, log, name):
    return spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", True).load(str(log)).count()


def test_silent_keys_leave_the_ring_store(spark, tmp_path):
    data = [(1, T0, "a", "x"), (2, T0 + dt.timedelta(seconds=10), "b", "y"), (3, T0 + dt.timedelta(hours=3), "b", "z"), (4, T0 + dt.timedelta(hours=6), "c", "w")]
    write_batches(spark, data, tmp_path / "in", 1)
    done = finish(keyed_ring(stream(spark, tmp_path / "in"), "host", watermark="1 minute"), tmp_path, "silent")
    assert {r.id: r.ring for r in done.collect()} == {1: [], 2: [], 3: [], 4: []}
    assert state_rows(spark, tmp_path / "silent-log", "ring") == 1  # the key that spoke last


EVENTS = "kind string, id bigint, subject string, ts timestamp, timeout_s int, payload string"


def test_first_arrivals_on_a_stream_equal_batch(spark, tmp_path):
    rnd, data, t = random.Random(4), [], T0
    for k in range(300):
        t += dt.timedelta(milliseconds=rnd.choice([0, 1, 500, 4000]))
        if rnd.random() < 0.4:
            data.append(("ask", k, rnd.choice("abc"), t, rnd.choice([0, 1, 5, 60]), None))
        else:
            data.append(("msg", k, rnd.choice("abcd"), t, None, rnd.choice(["p", "q", f"m{k}"])))
    cut = next(k for k in range(150, 300) if data[k][3] != data[k - 1][3])
    for part in (data[:cut], data[cut:], [("msg", 999, "z", t + dt.timedelta(days=1), None, "end")]):
        write_batches(spark, part, tmp_path / "in", len(part), EVENTS)

    def split(rows):
        asks = rows.where("kind = 'ask'").selectExpr("id AS request_id", "subject", "ts AS asked_at", "timeout_s")
        return asks, rows.where("kind = 'msg'").selectExpr("subject", "ts AS arrived_at", "payload")

    found = finish(first_arrivals_stream(*split(stream(spark, tmp_path / "in", EVENTS))), tmp_path, "first")
    want = first_arrivals(*split(spark.createDataFrame(data, EVENTS))).select("request_id", "response", "error")
    assert found.schema == want.schema or found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert state_rows(spark, tmp_path / "first-log", "open") == 0


def test_an_answer_is_never_replaced(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("ask", 1, "a", at(0), 60, None)], [("msg", 2, "a", at(20), None, "first processed")], [("msg", 3, "a", at(5), None, "earlier but late")], [("msg", 4, "z", at(9999), None, "end")]]
    for part in batches:
        write_batches(spark, part, tmp_path / "in", 1, EVENTS)
    rows = stream(spark, tmp_path / "in", EVENTS)
    asks = rows.where("kind = 'ask'").selectExpr("id AS request_id", "subject", "ts AS asked_at", "timeout_s")
    found = finish(first_arrivals_stream(asks, rows.where("kind = 'msg'").selectExpr("subject", "ts AS arrived_at", "payload")), tmp_path, "late")
    assert list(map(tuple, found.collect())) == [(1, "first processed", None)]


def test_a_replay_decides_with_the_lists_of_its_batch(spark, tmp_path):
    """Stopped between sink and commit, the list changes, restarted: the same outbox."""
    schema = "id bigint, ts timestamp, payload string"
    message = lambda k: (k, T0 + dt.timedelta(hours=k), payload("sw-1", "err", f"{'red' if k % 2 else 'blue'} {'x' * k}"))
    raw = [spark.createDataFrame([message(k) for k in ids], schema) for ids in (range(1, 7), range(7, 13))]
    lists = lambda *words: RefreshedPatterns(lambda s: s.createDataFrame([(w,) for w in words], "pattern string"))
    options = {"to": "-5", "outbox": str(tmp_path / "out"), "ring_path": str(tmp_path / "ring"), "on_empty": "send"}

    def ids(batch):
        return sorted(r.id for r in read_outbox(spark, options["outbox"]).where(f"batch_id = {batch}").collect())

    notify_batches(ban=lists("nothing"), notify=lists("red"), **options)(raw[0], 0)
    assert ids(0) == [1, 3, 5]
    later = notify_batches(ban=lists("x{4}"), notify=lists("blue"), **options)
    later(raw[0], 0)
    assert ids(0) == [1, 3, 5]
    later(raw[1], 1)
    assert ids(1) == []  # banned by the new list
    notify_batches(ban=lists("nothing"), notify=lists("blue"), **options)(raw[1], 2)
    assert ids(2) == [8, 10, 12]


def test_versions_are_written_once_and_forgotten(spark, tmp_path):
    versions, now = ListVersions(str(tmp_path / "v")), [0.0]
    own = RefreshedPatterns(lambda s: s.createDataFrame([(f"p{now[0]}",), ("[",)], "pattern string"), period_s=10, clock=lambda: now[0])
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    try:
        for batch in range(8):
            now[0] = 10.0 * (batch // 2)
            found = versions.for_batch(spark, batch, {"l": own})["l"]
            assert [x[1] for x in found.literals] == [f"p{now[0]}"]
            again = ListVersions(str(tmp_path / "v")).for_batch(spark, batch, {"l": own})["l"]
            assert [x[1] for x in again.literals] == [f"p{now[0]}"] and len(again.rejects) == 1
        assert len(list((tmp_path / "v" / "versions").iterdir())) < 4
    finally:
        spark.conf.unset("spark.sql.streaming.minBatchesToRetain")
    with pytest.raises(ValueError):
        versions.for_batch(spark, 9, {"l": RefreshedPatterns(lambda s: s.createDataFrame([], "pattern string"))}, needed=("l",))
    assert not (tmp_path / "v" / "batches" / "9").exists()
