"""The first message on a subject within a timeout, on two streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertmill.operators.delivery import DEFAULT_RESPONSE, TIMEOUT_ERROR
from alertmill.session import ROCKSDB_PROVIDER

ASK, MESSAGE = 0, 1
OUT = "request string, response string, error string"


def _fires_at(until_us: int) -> int:
    """The millisecond from which an instant is past."""
    return until_us // 1000 + 1


class _FirstArrival(StatefulProcessor):
    """Open requests of a subject are its state; a message answers them, or a timer does.

    A request is gone from the state once it is answered, so a later message never replaces an answer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "request string, us bigint, until bigint")

    def _keep(self, waiting: list[tuple]) -> None:
        if waiting:
            self.open.put(waiting)
        else:
            self.open.clear()
        wanted = {_fires_at(min(w[2] for w in waiting))} if waiting else set()
        known = set(self.handle.listTimers())
        for timer in known - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - known:
            self.handle.registerTimer(timer)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "kind", "payload"], kind="stable")
        waiting, past, answers = [tuple(w) for w in self.open.get()], [], []
        for us, kind, request, until, payload in zip(batch["us"], batch["kind"], batch["request"], batch["until"], batch["payload"]):
            if kind == ASK:
                waiting.append((request, int(us), int(until)))
            elif kind == MESSAGE and waiting:
                later = [w for w in waiting if w[1] > us]
                for own in waiting:
                    if own[1] <= us:
                        (answers if us <= own[2] else past).append((own[0], payload) if us <= own[2] else own)
                waiting = later
        self._keep(past + waiting)
        if answers:
            yield pd.DataFrame([(r, p, None) for r, p in answers], columns=["request", "response", "error"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed: a timer set now would wait for the next trigger
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = [tuple(w) for w in self.open.get()]
        self._keep([w for w in waiting if _fires_at(w[2]) > now])
        lost = [(w[0], DEFAULT_RESPONSE, TIMEOUT_ERROR) for w in waiting if _fires_at(w[2]) <= now]
        if lost:
            yield pd.DataFrame(lost, columns=["request", "response", "error"])

    def close(self) -> None:
        pass


def first_arrivals_stream(
    requests: DataFrame,
    arrivals: DataFrame,
    request_id: str = "request_id",
    subject: str = "subject",
    asked_at: str = "asked_at",
    timeout_s: str = "timeout_s",
    arrived_at: str = "arrived_at",
    payload: str = "payload",
    watermark: str = "30 seconds",
) -> DataFrame:
    """``request_id, response, error`` as :func:`~alertmill.operators.delivery.first_arrivals`; needs the RocksDB state store.

    An answer appears with the first message that is processed in time, a timeout once the watermark has passed it. Rows of a
    trigger are taken in time order, so the result equals the batch operator when triggers come in time order; rows
    behind the watermark are dropped. The state holds open requests only. Requests without id or subject, and messages
    without subject, take no part.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    text = lambda c: F.col(c).cast("string")
    asked = F.unix_micros(F.col(asked_at).cast("timestamp"))
    asks = requests.select(
        text(subject).alias("key"), F.lit(ASK).alias("kind"), F.col(asked_at).cast("timestamp").alias("at"), asked.alias("us"),
        text(request_id).alias("request"), (asked + F.col(timeout_s).cast("bigint") * 1_000_000).alias("until"), F.lit(None).cast("string").alias("payload"),
    ).where("request IS NOT NULL AND us IS NOT NULL")
    came = arrivals.select(
        text(subject).alias("key"), F.lit(MESSAGE).alias("kind"), F.col(arrived_at).cast("timestamp").alias("at"),
        F.unix_micros(F.col(arrived_at).cast("timestamp")).alias("us"), F.lit(None).cast("string").alias("request"), F.lit(0).cast("bigint").alias("until"), text(payload).alias("payload"),
    )
    both = asks.unionByName(came).where("key IS NOT NULL").withWatermark("at", watermark)
    found = both.groupBy("key").transformWithStateInPandas(_FirstArrival(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return found.select(F.col("request").cast(requests.schema[request_id].dataType).alias(request_id), "response", "error")
