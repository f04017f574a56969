import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from alertmill.operators import inventory
from alertmill.operators.grep import grep_outcomes
from alertmill.schemas import DEVICE
from alertmill.sources.devices import read_devices, valid_ip
from alertmill.sources.lines import read_lines, split_lines

DEVICES = [
    (0, "sw-1", "10.1.1.1", {"site": "a", "role": "core"}),
    (1, "sw-2", "10.1.1.2", {"site": "a", "role": "edge"}),
    (2, "sw-3", None, {"site": "b", "role": "core"}),
    (3, "sw-4", "10.1.1.4", {}),
    (4, "sw-5", "10.1.1.5", {"site": "b", "rack": "9"}),
]
BODIES = {
    1: '{"site":"a","role":"core"}', 2: "", 3: None, 4: "{}", 5: '{"*":"*"}', 6: '{"site":"zz"}', 7: '{"rack":"9","role":"core"}',
    8: '{"*":"*","role":"core"}', 9: '{"*":"x"}', 10: "[", 11: "[]", 12: '{"site":3}', 13: '{"site":"a","zz":"1"}', 14: "null",
}
WANT = {
    1: ("ok", [0]), 2: ("ok", [0, 1, 2, 3, 4]), 3: ("ok", [0, 1, 2, 3, 4]), 4: ("no_result", []), 5: ("ok", [0, 1, 2, 3, 4]),
    6: ("no_result", []), 7: ("ok", []), 8: ("ok", [0, 2]), 9: ("no_result", []), 10: ("bad_request", []), 11: ("bad_request", []),
    12: ("bad_request", []), 13: ("no_result", []), 14: ("no_result", []),
}


@pytest.fixture(scope="module")
def devices(spark):
    return spark.createDataFrame(DEVICES, "id bigint, name string, ip string, attributes map<string,string>")


def test_batch_search(spark, devices):
    requests = spark.createDataFrame(list(BODIES.items()), "query_id bigint, body string")
    queries = requests.select("query_id", inventory.parse_query("body").alias("q"))
    found = {}
    for r in inventory.search_batch(devices, queries).collect():
        found.setdefault(r.query_id, []).append(r.id)
    status = {r.query_id: (r.status, r.n_found) for r in inventory.search_status(devices, queries).collect()}
    for q, (want, ids) in WANT.items():
        assert (status[q], sorted(found.get(q, []))) == ((want, len(ids)), ids), q
    answers = {r.query_id: r for r in inventory.search_documents(devices, requests).collect()}
    assert answers[7].body == "[]" and answers[4].body is None and answers[10].status == "bad_request"
    assert json.loads(answers[8].body) == [{"name": "sw-1", "ip": "10.1.1.1"}, {"name": "sw-3", "ip": None}]


def test_single_search(devices):
    for q, body in BODIES.items():
        try:
            query = json.loads(body or '{"*":"*"}')
        except ValueError:
            continue
        if isinstance(query, dict) and all(isinstance(v, str) for v in query.values()) and q != 9:
            assert sorted(r.id for r in inventory.search(devices, query).collect()) == WANT[q][1], q


def test_search_equals_brute_force_with_a_hot_value(spark):
    rng = random.Random(3)
    rows = [(i, f"d{i}", None, {a: rng.choice(["hot", "hot", "x", "y"]) for a in rng.sample("abcd", rng.randrange(5))}) for i in range(400)]
    asks = [(q, {a: rng.choice(["hot", "x", "none"]) for a in rng.sample("abcd", rng.randrange(1, 4))}) for q in range(60)]
    df = spark.createDataFrame(rows, "id bigint, name string, ip string, attributes map<string,string>")
    queries = spark.createDataFrame(asks, "query_id bigint, q map<string,string>")
    want = {(q, i) for q, pairs in asks for i, _, _, attrs in rows if all(attrs.get(k) == v for k, v in pairs.items())}
    assert {(r.query_id, r.id) for r in inventory.search_batch(df, queries).collect()} == want


def test_index(devices):
    rows = {(r.attr, r.value, r.span): (r["count"], r.ids) for r in inventory.attribute_index(devices, span_bits=1).collect()}
    assert rows[("site", "a", 0)] == (2, [0, 1]) and rows[("*", "*", 1)] == (2, [2, 3]) and rows[("role", "core", 1)] == (1, [2])
    counts = {(r.attr, r.value): r["count"] for r in inventory.attribute_counts(devices).collect()}
    assert counts == {("site", "a"): 2, ("site", "b"): 2, ("role", "core"): 2, ("role", "edge"): 1, ("rack", "9"): 1, ("*", "*"): 5}


def test_read_devices(spark, tmp_path):
    plain = [{"name": n, "ip": ip or "", "attributes": a} for _, n, ip, a in DEVICES]
    (tmp_path / "a.json").write_text(json.dumps(plain, indent=1))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(d) for d in plain))
    for name, json_lines in (("a.json", False), ("a.jsonl", True)):
        got = read_devices(spark, str(tmp_path / name), json_lines, number=True).orderBy("id").collect()
        assert [(r.id, r.name, r.ip, r.attributes) for r in got] == DEVICES
        assert read_devices(spark, str(tmp_path / name), json_lines).count() == 5
    (tmp_path / "bad.json").write_text(json.dumps(plain)[:-5])
    (tmp_path / "ip.json").write_text('[{"name":"x","ip":"10.1.1.999","attributes":{}}]')
    for name in ("bad.json", "ip.json", "missing.json"):
        with pytest.raises(Exception):
            read_devices(spark, str(tmp_path / name)).collect()
    assert DEVICE.fieldNames() == ["name", "ip", "attributes"]


def test_valid_ip(spark):
    texts = [
        "10.1.1.1", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "", "a", "::", "::1", "1::", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7",
        "1:2:3:4:5:6:7:8:9", "1::2::3", "::ffff:10.0.0.1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "12345::", "g::", ":1", "1:", "1:2:3:4:5:6:1.2.3.4",
        "1:2:3:4:5:6:7:1.2.3.4", ":::", "1:::2", "10.1.1.1 ", "::1.2.3.4.5", "1:2:3:4::5:6:7:8",
    ]

    def valid(text):
        try:
            return bool(ipaddress.ip_address(text))
        except ValueError:
            return False

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", valid_ip("t").alias("ok")).collect()
    assert {r.t: r.ok for r in got} == {t: valid(t) for t in texts}


def test_line_numbers_across_splits_and_files(spark, tmp_path):
    want = {}
    for name, n in (("a.txt", 5000), ("b.txt", 300), ("c.txt", 0), ("d.txt", 7000)):
        body = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_bytes("".join(line + ("\r\n" if i % 3 else "\n") for i, line in enumerate(body)).encode())
        for line in body:
            want[len(want) + 1] = line
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_lines(spark, str(tmp_path))
        assert {r.line_no: r.value for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_lines(spark):
    df = spark.createDataFrame([(1, "a\n\nb\r\n"), (2, ""), (3, "x"), (4, "\n"), (5, None)], "id int, text string")
    got = [(r.id, r.line_in_text, r.value) for r in split_lines(df, "text", ["id"]).orderBy("id", "line_in_text").collect()]
    assert got == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (3, 0, "x"), (4, 0, "")]


def test_grep(spark):
    lines = spark.createDataFrame(
        [(3, "sw-1 10.1.1.1 Vlan111"), (1, "sw-2 10.1.1.2 Vlan112"), (2, "sw-3 1001111 Vlan1110")], "line_no bigint, value string"
    )
    asks = [(1, "10.1.1.1"), (2, "Vlan111"), (3, ".*Vlan111"), (4, "none"), (5, "["), (6, "Vlan111")]
    got = {r.query_id: r for r in grep_outcomes(lines, spark.createDataFrame(asks, "query_id int, pattern string"), "line_no").collect()}
    both = "sw-3 1001111 Vlan1110\nsw-1 10.1.1.1 Vlan111"
    assert got[1].text == "sw-1 10.1.1.1 Vlan111"
    assert got[2].text == got[3].text == got[6].text == both
    assert [got[q].status for q in range(1, 7)] == ["ok", "ok", "ok", "no_content", "bad_request", "ok"]
    assert [got[q].n_lines for q in range(1, 7)] == [1, 2, 2, 0, 0, 2]


def test_long_reply_holds_all_lines(spark):
    n = 20_000
    lines = spark.range(n).select(F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("value"))
    r = grep_outcomes(lines, spark.createDataFrame([(1, "line")], "query_id int, pattern string"), "line_no").collect()
    assert [(x.n_lines, x.page) for x in r] == [(n, 0)]
    assert r[0].text == "\n".join(f"line {i}" for i in range(n))


def test_grep_deals_out_the_pages_of_one_pattern(spark):
    """No task holds the whole reply; pages, their order and what each asker gets stay as they were."""
    rng = random.Random(5)
    rows = [(i << 24 | k, rng.choice(["", "é" * rng.randrange(30), "x" * rng.randrange(200)])) for i in range(40) for k in range(rng.randrange(40))]
    lines = spark.createDataFrame([*rows, (None, "xx")], "line_no bigint, value string").repartition(5)
    asks = [(1, ""), (2, "x"), (3, ""), (4, "nothing"), (5, "("), (6, None), (7, "^$")]
    queries = spark.createDataFrame(asks, "query_id int, pattern string")
    out = grep_outcomes(lines, queries, "line_no", page_bytes=1000).withColumn("task", F.spark_partition_id())
    got = [r.asDict() for r in out.collect()]
    assert len({r["task"] for r in got if r["query_id"] == 1}) > 4
    # of the lines one by one; a line without number is counted, but has no place in a text
    rows.sort()
    tests = {1: lambda v: True, 2: lambda v: "x" in v, 3: lambda v: True, 7: lambda v: v == ""}
    want = [(4, "no_content", 0, 0, None), (5, "bad_request", 0, 0, None), (6, "bad_request", 0, 0, None)]
    for query, match in tests.items():
        found, texts, start = [v for _, v in rows if match(v)], {}, 0
        for v in found:
            texts.setdefault(start // 1000, []).append(v)
            start += len(v.encode()) + 1
        assert len(texts) > 1 or query == 7
        want += [(query, "ok", len(found) + (query != 7), page, "\n".join(t)) for page, t in texts.items()]
    assert sorted((r["query_id"], r["status"], r["n_lines"], r["page"], r["text"] or "") for r in got) == sorted((*w[:4], w[4] or "") for w in want)
