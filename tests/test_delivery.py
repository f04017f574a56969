import datetime as dt
import random

from pyspark.sql import functions as F

from alertmill.functions.text import PROBE_TEMPLATE, probe_text
from alertmill.operators.delivery import carriers, contains_text, first_arrivals, undelivered

T0 = dt.datetime(2024, 1, 1)


def at(us):
    return T0 + dt.timedelta(microseconds=us)


def test_probes(spark):
    s = 1_000_000
    sent = [(17, 0), (7, 0), (20, 0), (21, 5 * s), (22, 0), (23, 0), (24, 0)]
    carried = [
        (f'{{"msg":"17, {PROBE_TEMPLATE}"}}', 10 * s), (f"21, {PROBE_TEMPLATE}", 4 * s), (f"22, {PROBE_TEMPLATE}", 10 * s + 1), ("20, One", s),
        (f"x23, {PROBE_TEMPLATE} and 24, {PROBE_TEMPLATE}", 0), (None, 0),
    ]
    probes = spark.createDataFrame([(n, at(t)) for n, t in sent], "nonce bigint, sent_at timestamp")
    messages = spark.createDataFrame([(p, at(t)) for p, t in carried], "payload string, arrived_at timestamp")
    lost = {r.nonce for r in undelivered(probes, messages).collect()}
    want = {
        n for n, t in sent
        if not any(p and f"{n}, {PROBE_TEMPLATE}" in p and t <= a <= t + 10 * s for p, a in carried)
    }
    assert lost == want == {20, 21, 22}
    assert messages.where(contains_text("payload", F.lit("and 24"))).count() == 1


def test_hot_nonce_is_reduced(spark):
    rows = spark.range(5000).select(
        F.lit(f"5, {PROBE_TEMPLATE}").alias("payload"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 3).alias("arrived_at")
    )
    assert carriers(rows, "payload", "arrived_at", [1]).distinct().count() == 3


def test_first_arrivals_equal_brute_force(spark):
    rng = random.Random(11)
    span = 60_000_000
    asks = [(i, rng.choice("hhhab"), rng.randrange(span) // 10**5 * 10**5, rng.choice([0, 1, 5, 30])) for i in range(300)]
    sent = [(rng.choice("hhhb"), rng.randrange(span) // 10**5 * 10**5, f"m{rng.randrange(50)}") for i in range(200)]
    requests = spark.createDataFrame(
        [(i, s, at(t), n) for i, s, t, n in asks], "request_id int, subject string, asked_at timestamp, timeout_s int"
    )
    arrivals = spark.createDataFrame([(s, at(t), p) for s, t, p in sent], "subject string, arrived_at timestamp, payload string")
    want = {}
    for i, s, t, n in asks:
        hits = sorted((a, p) for s2, a, p in sent if s2 == s and t <= a <= t + n * 10**6)
        want[i] = (hits[0][1], None) if hits else ("{}", "timeout error")
    got = {r.request_id: (r.response, r.error) for r in first_arrivals(requests, arrivals).collect()}
    assert got == want


def test_first_arrivals_over_days(spark):
    """The next message can be days after the request, in a day of its own."""
    rng, day = random.Random(12), 86_400 * 10**6
    asks = [(i, rng.choice("ha"), rng.randrange(40) * day // 2 + rng.choice([0, 1, day // 2 - 1]), rng.choice([5, 86_400, 10 * 86_400])) for i in range(200)]
    sent = [(rng.choice("ha"), rng.randrange(40) * day // 2 + rng.choice([0, 1, day // 2 - 1, 7]), f"m{k}") for k in range(25)]
    requests = spark.createDataFrame([(i, s, at(t), n) for i, s, t, n in asks], "request_id int, subject string, asked_at timestamp, timeout_s int")
    arrivals = spark.createDataFrame([(s, at(t), p) for s, t, p in sent], "subject string, arrived_at timestamp, payload string")
    want = {}
    for i, s, t, n in asks:
        hits = sorted((a, p) for s2, a, p in sent if s2 == s and t <= a <= t + n * 10**6)
        want[i] = (hits[0][1], None) if hits else ("{}", "timeout error")
    assert {r.request_id: (r.response, r.error) for r in first_arrivals(requests, arrivals).collect()} == want


def test_first_arrival_without_messages(spark):
    requests = spark.createDataFrame([(1, None, T0, 5), (2, "x", T0, 5)], "request_id int, subject string, asked_at timestamp, timeout_s int")
    arrivals = spark.createDataFrame([], "subject string, arrived_at timestamp, payload string")
    assert {(r.request_id, r.response, r.error) for r in first_arrivals(requests, arrivals).collect()} == {
        (1, "{}", "timeout error"), (2, "{}", "timeout error"),
    }


def test_nonces_of_any_text_and_length(spark):
    at = dt.datetime(2024, 1, 1)
    names = ["1" * 23, "abc-1", "é x"]
    probes = spark.createDataFrame([(n, at) for n in [*names, "lost"]], "nonce string, sent_at timestamp")
    messages = probes.where("nonce <> 'lost'").select(F.col("sent_at").alias("arrived_at"), probe_text(F.col("nonce")).alias("payload"))
    assert [r.nonce for r in undelivered(probes, messages).collect()] == ["lost"]
