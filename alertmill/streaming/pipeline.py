"""The alert pipeline on a stream of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertmill.functions.text import SUBJECT_PREFIX, message_text
from alertmill.operators.outbox import alerts, write_outbox
from alertmill.operators.similarity import THRESHOLD
from alertmill.plans.notify import candidates
from alertmill.streaming.refresh import ListVersions, RefreshedPatterns
from alertmill.streaming.ring import ring_by_batches


def notify_batches(
    ban: RefreshedPatterns,
    notify: RefreshedPatterns,
    to: str,
    outbox: str,
    ring_path: str,
    threshold: int = THRESHOLD,
    subscription: str = "slg.>",
    prefix: str = SUBJECT_PREFIX,
    keys: list[str] | None = None,
    on_empty: str = "suppress",
    mode: str = "auto",
    when_empty: str = "fail",
):
    """A ``foreachBatch`` function from payloads (id, ts, payload) to an outbox folder per batch.

    The lists a batch was decided with are noted beside the ring, so a replay
    decides the same. A batch that finds the notify list empty fails, to be
    tried again on restart with the list of then; ``when_empty='skip'`` lets its
    messages go, like a listener that has not subscribed yet.
    """

    def deliver(sent: DataFrame, batch: int) -> None:
        rows = alerts(sent, F.lit(to), message_text("timestamp", "host", "msg"), keep=["id"])
        write_outbox(rows, outbox, batch)

    suppress = ring_by_batches(ring_path, deliver, keys, threshold, on_empty, mode)
    versions = ListVersions(f"{ring_path}-lists")

    def run(raw: DataFrame, batch: int) -> None:
        needed = () if when_empty == "skip" else ("notify",)
        found = versions.for_batch(raw.sparkSession, batch, {"ban": ban, "notify": notify}, needed)
        if when_empty == "skip" and found["notify"].is_empty():
            return
        suppress(candidates(raw, found["ban"], found["notify"], subscription, prefix), batch)

    return run


def start_notify(
    payloads: DataFrame, checkpoint: str, available_now: bool = False, trigger: str = "10 seconds", **options
) -> StreamingQuery:
    """Run :func:`notify_batches` on a stream."""
    writer = payloads.writeStream.foreachBatch(notify_batches(**options)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
