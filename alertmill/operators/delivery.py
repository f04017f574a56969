"""Did a probe arrive in time, and which message came first on a subject."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions.text import PROBE_TEMPLATE

# Fixed values.
DELIVERY_S = 10
DEFAULT_RESPONSE = "{}"
TIMEOUT_ERROR = "timeout error"
FAILURE_TEXT = "Dear engineers, syslog doesn't work correctly"

DAY_S = 86_400


def contains_text(payload: Column | str, text: Column | str) -> Column:
    payload = F.col(payload) if isinstance(payload, str) else payload
    text = F.col(text) if isinstance(text, str) else text
    return F.contains(payload, text)


def carried_nonces(payload: Column, lengths: list[int], template: str = PROBE_TEMPLATE) -> Column:
    """All texts of the given lengths that the probe text follows in the payload.

    A probe is carried when its nonce and the template are contained, so every ending of what precedes the template
    counts, whatever its characters.
    """
    rest = f", {template}"
    pieces = F.split(payload, re.escape(rest), -1)
    before = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, 1, k), rest))
    sizes = F.array(*[F.lit(n) for n in lengths])
    ends = F.transform(before, lambda b: F.transform(F.filter(sizes, lambda n: n <= F.length(b)), lambda n: F.right(b, n)))
    return F.when(F.size(pieces) > 1, F.array_distinct(F.flatten(ends))).otherwise(F.array().cast("array<string>"))


def carriers(messages: DataFrame, payload: str, arrived_at: str, lengths: list[int], template: str = PROBE_TEMPLATE) -> DataFrame:
    """``nonce, arrived_at`` of the messages that carry a probe; other messages drop out at the scan."""
    hits = messages.where(F.contains(F.col(payload), F.lit(", " + template)))
    return hits.select(F.explode(carried_nonces(F.col(payload), lengths, template)).alias("nonce"), F.col(arrived_at).alias("arrived_at"))


def undelivered(
    probes: DataFrame,
    messages: DataFrame,
    payload: str = "payload",
    arrived_at: str = "arrived_at",
    within_s: int = DELIVERY_S,
    template: str = PROBE_TEMPLATE,
) -> DataFrame:
    """Probes (nonce, sent_at, ..) without a carrying message from ``sent_at`` to ``within_s`` later."""
    # Distinct lengths, not nonces: at most as many as the longest nonce has characters.
    lengths = sorted(r[0] for r in probes.select(F.length(F.col("nonce").cast("string"))).distinct().collect() if r[0])
    if not lengths:
        return probes
    arrived = carriers(messages, payload, arrived_at, lengths, template).distinct()
    sent = probes.select(F.col("nonce").cast("string").alias("nonce"), "sent_at").distinct()
    late = F.expr(f"sent_at + interval {within_s} seconds")
    # Joined as inner first: the optimizer can split a hot nonce on either side.
    hits = sent.join(arrived, "nonce").where((F.col("arrived_at") >= F.col("sent_at")) & (F.col("arrived_at") <= late))
    hits = hits.select("nonce", "sent_at").distinct()
    keyed = probes.withColumn("_nonce", F.col("nonce").cast("string"))
    hits = hits.select(F.col("nonce").alias("_nonce"), "sent_at")
    return keyed.join(hits, ["_nonce", "sent_at"], "left_anti").select(*probes.columns)


def _with_next(rows: DataFrame, asked: DataFrame, backwards, out: str) -> DataFrame:
    """``asked`` with ``out``: the ``m`` of the first of ``rows`` that comes strictly after, None without one."""
    empty = F.lit(None).cast(rows.schema["m"].dataType).alias("m")
    both = rows.withColumn("kind", F.lit(1)).unionByName(asked.select("*", empty, F.lit(0).alias("kind")))
    return both.withColumn(out, F.last("m", ignorenulls=True).over(backwards)).where("kind = 0").drop("kind", "m")


def first_arrivals(
    requests: DataFrame,
    arrivals: DataFrame,
    subject: str = "subject",
    asked_at: str = "asked_at",
    timeout_s: str = "timeout_s",
    arrived_at: str = "arrived_at",
    payload: str = "payload",
) -> DataFrame:
    """Requests with ``response`` and ``error``: the first message on the subject in time.

    Without one the response is ``{}`` and the error says so. Of messages of
    one instant the smallest payload counts.

    No request meets all messages of its subject. Messages are reduced to one
    per instant and to the first of each second; a request looks through its
    own second and, failing that, takes the first of the next second that has
    one, in the same day or else on the next day with any. The windows hold one
    second, the seconds of one day, or one row per day of a subject.
    """
    asked = F.unix_micros(F.col(asked_at).cast("timestamp"))
    second, day = F.expr("us div 1000000"), F.expr(f"sec div {DAY_S}")
    messages = (
        arrivals.select(F.col(subject).alias("s"), F.unix_micros(F.col(arrived_at).cast("timestamp")).alias("us"), F.col(payload).alias("p"))
        .groupBy("s", "us")
        .agg(F.min("p").alias("p"))
        .withColumn("sec", second)
    )
    asks = requests.select(F.col(subject).alias("s"), asked.alias("us")).distinct().withColumn("sec", second)
    message = F.struct("us", "p")
    nothing = F.lit(None).cast("struct<us:bigint,p:string>")

    own = messages.select("s", "sec", "us", F.lit(0).alias("kind"), message.alias("m")).unionByName(
        asks.select("s", "sec", "us", F.lit(1).alias("kind"), nothing.alias("m"))
    )
    backwards = Window.partitionBy("s", "sec").orderBy(F.desc("us"), "kind")
    own = own.withColumn("own", F.last("m", ignorenulls=True).over(backwards)).where("kind = 1").select("s", "sec", "us", "own")

    firsts = messages.groupBy("s", "sec").agg(F.min(message).alias("m")).withColumn("day", day)
    wanted = asks.select("s", "sec").distinct().withColumn("day", day)
    in_day = Window.partitionBy("s", "day").orderBy(F.desc("sec"), "kind")
    later = _with_next(firsts.select("s", "day", "sec", "m"), wanted, in_day, "next")
    days = firsts.groupBy("s", "day").agg(F.min("m").alias("m"))
    over_days = _with_next(days, wanted.select("s", "day").distinct(), Window.partitionBy("s").orderBy(F.desc("day"), "kind"), "next_day")
    later = later.join(over_days, ["s", "day"]).select("s", "sec", F.coalesce("next", "next_day").alias("next"))

    answers = own.join(later, ["s", "sec"]).select("s", "us", F.coalesce("own", "next").alias("m"))
    joined = requests.withColumn("_us", asked).join(
        answers.withColumnRenamed("s", subject).withColumnRenamed("us", "_us"), [subject, "_us"], "left"
    )
    in_time = F.coalesce(F.col("m.us") <= F.col("_us") + F.col(timeout_s).cast("bigint") * 1_000_000, F.lit(False))
    return joined.select(
        *requests.columns,
        F.when(in_time, F.col("m.p")).otherwise(F.lit(DEFAULT_RESPONSE)).alias("response"),
        F.when(~in_time, F.lit(TIMEOUT_ERROR)).alias("error"),
    )
