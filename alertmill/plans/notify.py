"""From log payloads to alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.functions.subjects import subject_matches
from alertmill.functions.text import SUBJECT_PREFIX, message_text, subject
from alertmill.operators.patterns import PatternSet, drop_matching, keep_matching, require_patterns, route_matches
from alertmill.operators.similarity import THRESHOLD, is_new, with_ring
from alertmill.sources.syslog import accepted, parse_syslog


def received(raw: DataFrame, prefix: str = SUBJECT_PREFIX, lenient: bool = False) -> DataFrame:
    """Accepted payloads with their fields and ``subject``."""
    parsed = accepted(parse_syslog(raw, lenient=lenient))
    return parsed.withColumn("subject", subject("severity", "facility", "host", prefix))


def candidates(
    raw: DataFrame, ban: PatternSet, notify: PatternSet, subscription: str = "slg.>", prefix: str = SUBJECT_PREFIX, lenient: bool = False
) -> DataFrame:
    """Messages of the subscription that no ban pattern and some notify pattern matches.

    The pattern tests need the payload only and run before it is parsed.
    """
    kept = keep_matching(drop_matching(raw, "payload", ban), "payload", require_patterns(notify))
    return received(kept, prefix, lenient).where(subject_matches("subject", subscription))


def notify_pipeline(
    raw: DataFrame,
    ban: PatternSet,
    notify: PatternSet,
    threshold: int = THRESHOLD,
    subscription: str = "slg.>",
    prefix: str = SUBJECT_PREFIX,
    on_empty: str = "suppress",
    fanout: str = "message",
    keys: list[str] | None = None,
    mode: str = "auto",
    lenient: bool = False,
) -> DataFrame:
    """Messages to send, with ``alert_text``. Columns in: id, ts, payload.

    ``fanout='message'`` compares a message once. ``'pattern'`` puts it into
    the ring once per matching pattern, in pattern order.
    """
    kept = candidates(raw, ban, notify, subscription, prefix, lenient)
    order = "id"
    if fanout == "pattern":
        kept = route_matches(kept, "payload", notify).drop("route").withColumnRenamed("pattern", "matched_pattern")
        kept = kept.withColumn("_order", F.struct("id", "matched_pattern"))
        order = "_order"
    elif fanout != "message":
        raise ValueError(f"unknown fanout {fanout!r}")
    # Tiles are counted on the input: filters can only make them smaller.
    profile = raw if fanout == "message" and not keys else None
    ringed = with_ring(kept, order_id=order, keys=keys, mode=mode, profile=profile)
    sent = ringed.where(is_new("ring", "payload", threshold, on_empty)).drop("ring", "_order")
    return sent.withColumn("alert_text", message_text("timestamp", "host", "msg"))
