import datetime as dt
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from alertmill.operators import documents, lists
from alertmill.sources.snapshots import decode_snapshot, read_snapshot

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def crc(text):
    return zlib.crc32(text.encode())


ITEM = "list_name string, id bigint, pattern string, expired_at timestamp"
COMMAND = "list_name string, id bigint, op string, pattern string, expired_at timestamp, ts timestamp, seq bigint"


def simulate(commands):
    """A process holding the lists, with exact expiry."""
    state, statuses = {}, {}
    for name, i, op, pattern, exp, ts, seq in sorted(commands, key=lambda c: (c[5], c[6])):
        key = (name, i)
        held = state.get(key)
        live = held is not None and (held[1] is None or held[1] >= ts)
        if op == "add":
            if exp is not None and exp < ts:
                statuses[seq] = "expired"
            elif live:
                statuses[seq] = "duplicate"
            else:
                state[key], statuses[seq] = (pattern, exp), "ok"
        else:
            statuses[seq] = "ok" if live else "not_found"
            state.pop(key, None)
    return state, statuses


def random_commands(n, seed, instants, keys, never=0.1):
    rng, out = random.Random(seed), []
    for seq in range(n):
        ts = at(rng.randrange(instants))
        p = f"p{rng.randrange(keys)}"
        if rng.random() < 0.25:
            out.append(("l", crc(p), "rm", None, None, ts, seq))
        else:
            exp = None if rng.random() < never else ts + dt.timedelta(seconds=rng.randrange(-1, 8))
            out.append(("l", crc(p), "add", p, exp, ts, seq))
    return out


@pytest.mark.parametrize("seed, instants, keys, never", [(1, 200, 5, 0.1), (2, 5, 3, 0.1), (3, 1, 2, 0.1), (4, 400, 1, 0.0), (5, 3000, 400, 0.0)])
def test_fold_equals_a_process(spark, seed, instants, keys, never):
    commands = random_commands(600, seed, instants, keys, never)
    state, statuses = simulate(commands)
    df = spark.createDataFrame(commands, COMMAND)
    got = {(r.list_name, r.id): (r.pattern, r.expired_at) for r in lists.fold_commands(df).collect()}
    assert got == state
    assert {r.seq: r.status for r in lists.command_outcomes(df).collect()} == statuses
    assert {r.seq: r.status for r in lists.command_outcomes(df, max_group_rows=3).collect()} == statuses


def test_fold_cases(spark):
    rows = [
        ("l", 1, "add", "a", at(10), at(0), 1), ("l", 1, "add", "b", None, at(10), 2), ("l", 1, "add", "c", None, at(11), 3),
        ("l", 2, "add", "x", None, at(0), 4), ("l", 2, "rm", None, None, at(1), 5), ("l", 2, "add", "y", None, at(2), 6),
        ("l", 3, "rm", None, None, at(1), 7),
    ]
    df = spark.createDataFrame(rows, COMMAND)
    assert {(r.id, r.pattern) for r in lists.fold_commands(df).collect()} == {(1, "c"), (2, "y")}
    assert [r.status for r in lists.command_outcomes(df).orderBy("seq").collect()] == [
        "ok", "duplicate", "ok", "ok", "ok", "ok", "not_found",
    ]


def adds(spark, *patterns):
    rows = [("ban", crc(p), p, None, at(i), i) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, ITEM + ", ts timestamp, seq bigint")


def test_add_duplicate_delete_and_patterns(spark):
    two = adds(spark, "this is the pattern1", "this is the pattern2", "this is the pattern1")
    assert [r.status for r in lists.add_outcomes(two, ["ts", "seq"]).orderBy("seq").collect()] == ["ok", "ok", "duplicate"]
    items = lists.first_adds(two, ["ts", "seq"])
    assert {r.pattern for r in lists.patterns_of(items, "ban").collect()} == {"this is the pattern1", "this is the pattern2"}
    assert lists.patterns_of(items, "unknown").count() == 0
    asked = [("ban", 1443610593, 0), ("ban", 1443610593, 1), ("ban", 5, 2), ("ban", 0, 3), ("ban", None, 4), ("other", 1443610593, 5)]
    deletes = spark.createDataFrame(asked, "list_name string, id bigint, seq int")
    got = [r.status for r in lists.delete_outcomes(items, deletes, ["seq"]).orderBy("seq").collect()]
    assert got == ["ok", "not_found", "not_found", "bad_request", "bad_request", "not_found"]
    assert [r.pattern for r in lists.remove_items(items, deletes).collect()] == ["this is the pattern2"]


def test_expiry_is_strict(spark):
    rows = [("l", 1, "a", at(0)), ("l", 2, "b", at(-1)), ("l", 3, "c", None), ("m", 4, "d", at(-1))]
    items = spark.createDataFrame(rows, ITEM)
    now = F.lit(T0)
    assert {r.id for r in lists.active_items(items, now).collect()} == {1, 3}
    names = spark.createDataFrame([("l",), ("m",), ("n",)], "list_name string")
    assert {r.list_name for r in lists.empty_lists(items, now, names).collect()} == {"m", "n"}
    assert {r.list_name: (r.n_live, r.n_items) for r in lists.list_sizes(items, now, names).collect()} == {
        "l": (2, 3), "m": (0, 1), "n": (0, 0),
    }


def test_uploads(spark):
    bodies = [
        '{"pattern":"a","expired_at":"0001-01-01T00:00:00Z"}', '{"pattern":"a"}', '{"pattern":3}', "{", "[]", "{}",
        '{"pattern":"b","expired_at":"soon"}', '{"pattern":"c","expired_at":"2024-01-01T00:00:00Z"}',
    ]
    df = spark.createDataFrame([("l", i, b) for i, b in enumerate(bodies)], "list_name string, seq int, body string")
    rows = lists.upload_outcomes(df, ["seq"]).orderBy("seq").collect()
    assert [r.status for r in rows] == ["ok", "duplicate", "bad_request", "bad_request", "bad_request", "ok", "bad_request", "ok"]
    assert (rows[0].id, rows[0].expired_at, rows[5].pattern, rows[7].expired_at) == (crc("a"), None, "", T0)


def list_items(spark, n):
    rows = [("big", crc(f"p{i}"), f'p{i} "q"', at(i) if i % 2 else None) for i in range(n)] + [("small", 7, "x", None)]
    return spark.createDataFrame(rows, ITEM), rows


def test_list_json_round_trip_and_pages(spark):
    items, rows = list_items(spark, 300)
    names = spark.createDataFrame([("small",), ("big",), ("none",)], "list_name string")
    whole = {r.list_name: r.body for r in documents.list_json(items, names).collect()}
    assert whole["none"] == "{}"
    assert json.loads(whole["small"]) == {"7": {"pattern": "x", "expired_at": "0001-01-01T00:00:00Z"}}
    big = json.loads(whole["big"])
    assert len(big) == 300 and list(big) == [str(i) for i in sorted(r[1] for r in rows if r[0] == "big")]
    pages = documents.list_json(items, page_bytes=1000).where("list_name = 'big'").orderBy("page").collect()
    assert [p.page for p in pages] == list(range(len(pages))) and len(pages) > 10
    assert max(len(p.body) for p in pages) < 1200
    merged = {}
    for p in pages:
        merged.update(json.loads(p.body))
    assert merged == big
    back = decode_snapshot(documents.list_json(items, page_bytes=1000))
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_list_text(spark):
    items = spark.createDataFrame([("l", 9, "b", None), ("l", 3, "a", at(0)), ("l", 4, "c", at(1) + dt.timedelta(microseconds=500000))], ITEM)
    body = documents.list_text(items).collect()[0].body
    assert body == (
        "3:a:2024-01-01 00:00:00 +0000 UTC\n4:c:2024-01-01 00:00:01.5 +0000 UTC\n9:b:0001-01-01 00:00:00 +0000 UTC\n"
    )


def test_snapshot_file(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"1443610593":{"pattern":"p","expired_at":"0001-01-01T00:00:00Z"}}\n')
    bad.write_text('{"1443610593":{"pattern":"p"\n')
    assert [tuple(r) for r in read_snapshot(spark, str(good), "ban").collect()] == [("ban", 1443610593, "p", None)]
    with pytest.raises(Exception, match="not a list snapshot"):
        read_snapshot(spark, str(bad), "ban").collect()
    with pytest.raises(Exception):
        read_snapshot(spark, str(tmp_path / "missing"), "ban").collect()


@pytest.mark.parametrize(
    "body", ['{"error":"down"}', "[]", '"x"', '{"1":{"pattern":3}}', '{"abc":{"pattern":"p"}}', '{"99999999999":{"pattern":"p"}}', '{"1":{"expired_at":"x"}}', "{"]
)
def test_wrong_snapshots_are_refused(spark, tmp_path, body):
    (tmp_path / "s.json").write_text(body)
    with pytest.raises(Exception, match="not a list snapshot"):
        read_snapshot(spark, str(tmp_path / "s.json"), "ban").collect()


def test_empty_snapshot_is_an_empty_list(spark, tmp_path):
    (tmp_path / "s.json").write_text("{}")
    assert read_snapshot(spark, str(tmp_path / "s.json"), "ban").collect() == []


def test_commands_without_id_are_refused(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("ban", None, "add", "p", None, at, 1), ("ban", 5, "add", "q", None, at, 2), ("ban", None, "rm", None, None, at, 3)]
    log = spark.createDataFrame(rows, "list_name string, id bigint, op string, pattern string, expired_at timestamp, ts timestamp, seq bigint")
    assert [tuple(r)[:3] for r in lists.fold_commands(log).collect()] == [("ban", 5, "q")]
    assert {r.seq: r.status for r in lists.command_outcomes(log).collect()} == {1: "bad_request", 2: "ok", 3: "bad_request"}
