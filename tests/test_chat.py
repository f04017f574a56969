import datetime as dt
import json
import zlib

import pytest
from pyspark.sql import functions as F

from alertmill.operators import chat
from alertmill.operators.outbox import alerts, publish, read_outbox, sendable, write_outbox
from alertmill.plans.chatbot import change_replies, list_replies, list_state, whois_replies
from alertmill.sources.chat import decode_envelopes, read_envelopes, updates
from alertmill.streaming.updates import stream_messages

NOW = 1_700_000_000


def message(text, age=None, chat_id=5, date=None):
    return {"message_id": 1, "date": NOW - age if date is None else date, "text": text, "chat": {"id": chat_id, "type": "private"}}


ENVELOPES = [
    {"ok": True, "result": [
        {"update_id": 10, "message": message("fresh", 179)},
        {"update_id": 11, "message": message("exactly", 180)},
        {"update_id": 12, "message": message("stale", 500), "channel_post": message("post", 1)},
        {"update_id": 13, "channel_post": message("post", 1, -100)},
        {"update_id": 14, "message": message("x", date=0), "channel_post": message("y", date=0)},
        {"update_id": 15},
        {"update_id": 16, "message": message("x", date=0), "channel_post": message("post2", 2)},
    ]},
    {"ok": False, "result": [{"update_id": 99, "message": message("no", 1)}]},
    {"ok": True, "result": []},
]
FRESH = {(10, "5", "fresh"), (13, "-100", "post"), (16, "5", "post2")}


def test_updates(spark, tmp_path):
    (tmp_path / "u.json").write_text("\n".join(json.dumps(e) for e in ENVELOPES))
    bodies = spark.createDataFrame([(json.dumps(e),) for e in ENVELOPES] + [("{",)], "body string")
    for envelopes in (read_envelopes(spark, str(tmp_path)), decode_envelopes(bodies)):
        ups = updates(envelopes)
        fresh = chat.fresh_messages(ups, F.lit(NOW))
        assert {(r.update_id, r["from"], r.text) for r in fresh.collect()} == FRESH
        assert chat.next_offset(ups).collect()[0][0] == 17
        assert chat.next_offset(ups, 40).collect()[0][0] == 40
        assert chat.next_offset(ups.where("false"), 3).collect()[0][0] == 3


def test_polling_continues_where_it_stopped(spark, tmp_path):
    source, log, out = tmp_path / "in", tmp_path / "log", tmp_path / "out"
    source.mkdir()

    def poll():
        fresh = stream_messages(spark, str(source), F.lit(NOW))
        fresh.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log)).trigger(
            availableNow=True
        ).start().awaitTermination()
        return sorted(r.update_id for r in spark.read.parquet(str(out)).collect())

    (source / "1.json").write_text(json.dumps(ENVELOPES[0]))
    assert poll() == [10, 13, 16]
    (source / "2.json").write_text(json.dumps({"ok": True, "result": [{"update_id": 20, "message": message("new", 3)}]}))
    assert poll() == [10, 13, 16, 20]


TEXTS = [
    (1, "/list testlist ls", 0), (2, "/other ls", 0), (3, "/testlist ls", 0),
    (4, "please /list ban add 1h30m .*flood.*", 1), (5, "/list ban add 90 x", 2), (6, f"/list ban rm {zlib.crc32(b'.*flood.*')}", 3),
    (7, "/list ban add 5m again", 4), (8, "/list ban add 5m again", 5), (9, "/list ban rm 0", 6), (10, "/list ban rm 77", 7),
    (11, "/list ban ls", 8), (12, "/whois Vlan111", 9), (13, "/whois [", 9), (14, "/whois nothing", 9), (15, "/list ban help", 9),
    (16, "/list ban add 1h a /list notify add 2h b", 10),
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(i, "5", t, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "update_id bigint, from string, text string, ts timestamp")


NAMES = ["ban", "notify", "testlist"]


def test_routing(messages):
    got = {(r.update_id, r.list_name, r.command) for r in chat.route_commands(messages, NAMES).collect()}
    assert got == {
        (1, "testlist", "ls"), (4, "ban", "add"), (5, "ban", "add"), (6, "ban", "rm"), (7, "ban", "add"), (8, "ban", "add"), (9, "ban", "rm"),
        (10, "ban", "rm"), (11, "ban", "ls"), (12, None, "whois"), (13, None, "whois"), (14, None, "whois"), (15, "ban", "help"),
        (16, "ban", "add"), (16, "notify", "add"),
    }


def test_list_state_and_replies(spark, messages):
    state = list_state(messages, NAMES)
    assert {(r.list_name, r.pattern, str(r.expired_at)) for r in state.collect()} == {
        ("ban", "again", "2024-01-01 00:05:04"), ("ban", "a /list notify add 2h b", "2024-01-01 01:00:10"), ("notify", "b", "2024-01-01 02:00:10"),
    }
    said = sorted(r.text for r in change_replies(messages, NAMES).collect())
    assert said == sorted(
        ["record added"] * 4 + ["record removed", "duration 90 is incorrect"]
        + ["can't change the list, duplicate", "can't change the list, bad_request", "can't change the list, not_found"]
    )
    routed = chat.route_commands(messages, NAMES)
    shown = {r.text for r in list_replies(routed, state, F.lit(dt.datetime(2024, 1, 1, 0, 30))).collect()}
    assert shown == {"", f"{zlib.crc32(b'a /list notify add 2h b')}:a /list notify add 2h b:2024-01-01 01:00:10 +0000 UTC\n"}
    lines = spark.createDataFrame([(1, "sw Vlan111"), (2, "x")], "line_no bigint, value string")
    assert {r.text for r in whois_replies(routed, lines, "line_no").collect()} == {
        "sw Vlan111", "bad_request from whois-service for query:[", "no_content from whois-service for query:nothing",
    }


def test_outbox_rejects_and_replays(spark, tmp_path):
    df = spark.createDataFrame([("5", "a<b"), ("0", "x"), ("x", "x"), ("7", ""), ("8", None)], "to string, body string")
    rows = alerts(df, F.col("to"), F.col("body"))
    assert {(r.chat_id, r.reject_reason) for r in rows.collect()} == {
        (5, None), (None, "chat id unspecified"), (7, "message text is empty"), (8, "message text is empty"),
    }
    assert [tuple(r) for r in sendable(rows).collect()] == [(5, "HTML", "<pre>a&lt;b</pre>")]
    for batch in (0, 1, 1):
        write_outbox(rows.withColumn("id", F.lit(9).cast("bigint")), str(tmp_path / "o"), batch)
    assert sorted((r.id, r.batch_id) for r in read_outbox(spark, str(tmp_path / "o")).collect()) == [(9, 0), (9, 1)]


def test_readers_of_the_outbox_see_whole_attempts(spark, tmp_path):
    rows = lambda n: spark.range(n).select("id", F.lit(1).cast("bigint").alias("chat_id"), F.lit("HTML").alias("parse_mode"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("reject_reason"))
    path = str(tmp_path / "o")
    assert read_outbox(spark, path).count() == 0
    write_outbox(rows(3), path, 0)
    reader = read_outbox(spark, path)
    # an attempt that was lost before its commit
    rows(50).drop("reject_reason").write.parquet(f"{path}/batch_id=0/attempt=lost")
    assert read_outbox(spark, path).count() == 3
    write_outbox(rows(5), path, 0)
    assert reader.count() == 3 and read_outbox(spark, path).count() == 5
    write_outbox(rows(6), path, 0)
    assert read_outbox(spark, path).count() == 6
    assert len([p for p in (tmp_path / "o" / "batch_id=0").iterdir()]) == 2


def test_publish_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(f"slg.{s}.app.h", "{}", s, "app") for s in ("err", "warn") for _ in range(3)]
    publish(spark.createDataFrame(rows, "subject string, payload string, severity string, facility string"), path)
    back = spark.read.parquet(path).where("severity = 'err'")
    assert back.count() == 3 and "PartitionFilters: [isnotnull(severity" in back._jdf.queryExecution().toString()
