"""The delivery check on two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.functions.text import PROBE_TEMPLATE
from alertmill.operators.delivery import DELIVERY_S, FAILURE_TEXT, carriers


def undelivered_stream(
    probes: DataFrame,
    messages: DataFrame,
    payload: str = "payload",
    within_s: int = DELIVERY_S,
    watermark: str = "30 seconds",
    template: str = PROBE_TEMPLATE,
    max_nonce: int = 32,
) -> DataFrame:
    """Alerts ``nonce, sent_at, text`` for probes (nonce, sent_at) no message carried in time.

    An alert appears once the watermark of both streams has passed its window. A nonce of more than ``max_nonce``
    characters fails the stream, because it would be looked for in vain.
    """
    name = F.col("nonce").cast("string")
    long = F.raise_error(F.lit(f"a nonce has more than {max_nonce} characters"))
    sent = probes.select(F.when(F.length(name) > max_nonce, long).otherwise(name).alias("nonce"), "sent_at").withWatermark("sent_at", watermark)
    arrived = carriers(messages, payload, "arrived_at", list(range(1, max_nonce + 1)), template).withColumnRenamed("nonce", "seen")
    arrived = arrived.withWatermark("arrived_at", watermark)
    on = F.expr(f"nonce = seen and arrived_at >= sent_at and arrived_at <= sent_at + interval {within_s} seconds")
    joined = sent.join(arrived, on, "leftOuter")
    return joined.where("seen is null").select("nonce", "sent_at", F.lit(FAILURE_TEXT).alias("text"))
