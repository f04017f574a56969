import json

from alertmill.sources.syslog import accepted, parse_syslog, rejected

GOOD = {"host": "sw-1", "severity": "err", "facility": "daemon", "timestamp": "t", "msg": "link down"}


def parsed(spark, payloads, **options):
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    return {r.id: r for r in parse_syslog(df, **options).collect()}


def test_fields_and_rejects(spark):
    cases = [
        (json.dumps(GOOD), None),
        (json.dumps({**GOOD, "msg": "é € \"q\""}), None),
        ('{"host":null}', None),
        ("{}", None),
        ("null", None),
        ('  {"host":"a"}\n', None),
        ('{"host":"a","host":"b"}', None),
        ('{"host":"a","extra":{"x":[1]}}', None),
        (json.dumps(GOOD)[:-3], "not_one_document"),
        ('{"host":"a"}{"host":"b"}', "not_one_document"),
        ('{"host":"a"}\n{"host":"b"}', "not_one_document"),
        ('{"host":"a"},{"host":"b"}', "not_one_document"),
        ('{"host":"a"}] x', "not_one_document"),
        ('{"host":"a"}],"k"] x', "not_one_document"),
        ("", "not_one_document"),
        (None, "not_one_document"),
        ("{'host':'a'}", "not_one_document"),
        ('{"host":"a\tb"}', "not_one_document"),
        ("[]", "not_an_object"),
        ("3", "not_an_object"),
        ('"x"', "not_an_object"),
        ('{"host":3}', "wrong_field_type"),
        ('{"msg":{"a":"b"}}', "wrong_field_type"),
        ('{"timestamp":true}', "wrong_field_type"),
    ]
    got = parsed(spark, [c for c, _ in cases])
    assert {i: got[i].reject_reason for i in got} == {i: why for i, (_, why) in enumerate(cases)}
    assert got[0].asDict() == {"id": 0, "payload": cases[0][0], "reject_reason": None, **GOOD}
    assert got[1].msg == 'é € "q"'
    assert got[6].host == "b"


def test_split_keeps_every_payload(spark):
    df = spark.createDataFrame([(1, '{"host":"a"}'), (2, "x")], "id int, payload string")
    both = parse_syslog(df)
    assert [r.id for r in accepted(both).collect()] == [1]
    assert [(r.id, r.payload, r.reject_reason) for r in rejected(both).collect()] == [(2, "x", "not_one_document")]


def test_lenient_takes_numbers(spark):
    got = parsed(spark, ['{"host":3}', "{"], lenient=True)
    assert (got[0].host, got[0].reject_reason) == ("3", None)
