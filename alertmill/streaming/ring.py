"""The similarity ring on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertmill.operators.similarity import LIFETIME_S, SAMPLES, THRESHOLD, is_new, with_ring
from alertmill.session import ROCKSDB_PROVIDER
from alertmill.storage import list_dir, path_exists

RING_SCHEMA = "us bigint, text string"
OUT_ROWS = 500


class _RingProcessor(StatefulProcessor):
    """Keeps the last samples of a key and hands each row the live ones.

    Bookkeeping only; distances are computed by the JVM afterwards. A timer drops the ring of a key that fell silent: once
    the watermark is past the lifetime of its newest sample, no row that still counts can be compared with it.
    """

    def __init__(self, samples: int, lifetime_s: int):
        self.samples = samples
        self.lifetime_us = lifetime_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", RING_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ring = [(int(us), text) for us, text in self.ring.get()]
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "id"], kind="stable")
        for low in range(0, len(batch), OUT_ROWS):
            piece = batch.iloc[low : low + OUT_ROWS]
            rings = []
            for us, text in zip(piece["us"], piece["text"]):
                live = [t for at, t in ring if us - at <= self.lifetime_us and t]
                rings.append(live)
                ring = [*ring, (int(us), text)][-self.samples :]
            yield pd.DataFrame({"key": key[0], "id": piece["id"], "us": piece["us"], "text": piece["text"], "ring": rings})
        self.ring.put(ring)
        expiry = (max(us for us, _ in ring) + self.lifetime_us) // 1000 + 1
        known = set(self.handle.listTimers())
        for timer in known - {expiry}:
            self.handle.deleteTimer(timer)
        if expiry not in known:
            self.handle.registerTimer(expiry)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_ring(
    stream: DataFrame,
    key: str,
    text: str = "payload",
    ts: str = "ts",
    order_id: str = "id",
    watermark: str = "10 minutes",
    samples: int = SAMPLES,
    lifetime_s: int = LIFETIME_S,
) -> DataFrame:
    """``key, id, ts, text, ring`` with one ring per key; needs the RocksDB state store.

    Rows of a trigger are taken in (ts, id) order, triggers in order of
    arrival, so the result equals the batch operator when triggers come in
    time order. Rows behind the watermark are dropped. One key is one state:
    choose a key no single value of which dominates, or use
    :func:`ring_by_batches`.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    rows = stream.withWatermark(ts, watermark).select(
        F.col(key).cast("string").alias("key"),
        F.col(order_id).cast("bigint").alias("id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(ts),
    )
    # Event-time rows behind the watermark are filtered where the state is kept.
    out = rows.groupBy("key").transformWithStateInPandas(
        _RingProcessor(samples, lifetime_s),
        outputStructType="key string, id bigint, us bigint, text string, ring array<string>",
        outputMode="Append",
        timeMode="EventTime",
    )
    return out.select("key", "id", F.timestamp_micros("us").alias("ts"), "text", "ring")


def new_on_stream(stream: DataFrame, key: str, threshold: int = THRESHOLD, on_empty: str = "suppress", **options) -> DataFrame:
    """The rows of a stream worth sending, one ring per key."""
    return keyed_ring(stream, key, **options).where(is_new("ring", "text", threshold, on_empty)).drop("ring")


class CarriedRing:
    """The ring between micro-batches: the last rows of a batch, stored per batch id.

    A replayed batch reads the ring its first run read, so it decides the same.
    """

    def __init__(
        self, path: str, keys: list[str] | None = None, samples: int = SAMPLES, lifetime_s: int = LIFETIME_S, lateness_s: int = LIFETIME_S
    ):
        self.path, self.keys, self.samples, self.lifetime_s, self.lateness_s = path, keys or [], samples, lifetime_s, lateness_s

    def _batches(self, spark) -> list[int]:
        names = [n.partition("=")[2] for n in list_dir(spark, self.path) if n.startswith("batch_id=")]
        return sorted(int(n) for n in names if path_exists(spark, f"{self.path}/batch_id={n}/_SUCCESS"))

    def ringed(self, rows: DataFrame, batch: int, mode: str = "auto") -> DataFrame:
        """``rows`` (keys, id, ts, payload, ..) of a batch with their ``ring``."""
        spark = rows.sparkSession
        stored = self._batches(spark)
        before = [b for b in stored if b < batch]
        if not before and stored and stored[0] > batch:
            raise RuntimeError(f"the ring before batch {batch} is gone, the oldest kept is of batch {stored[0]}")
        fresh = rows.withColumn("_carried", F.lit(False))
        if before:
            carried = spark.read.parquet(f"{self.path}/batch_id={before[-1]}").withColumn("_carried", F.lit(True))
            fresh = fresh.unionByName(carried, allowMissingColumns=True)
        ringed = with_ring(fresh, keys=self.keys, samples=self.samples, lifetime_s=self.lifetime_s, mode=mode)
        return ringed.where(~F.col("_carried")).drop("_carried")

    def store(self, rows: DataFrame, batch: int) -> None:
        """Keep the last rows for the next batch; no key keeps more than the ring holds.

        Rows that expired ``lateness_s`` before the newest one can be compared with nothing any more and go, and with
        them the keys that fell silent.
        """
        spark = rows.sparkSession
        held = rows.select(*self.keys, "id", "ts", "payload")
        before = [b for b in self._batches(spark) if b < batch]
        if before:
            held = held.unionByName(spark.read.parquet(f"{self.path}/batch_id={before[-1]}"))
        newest = held.agg(F.max("ts")).first()[0]
        if newest is not None:
            gone = F.lit(newest).cast(held.schema["ts"].dataType) - F.expr(f"interval {self.lifetime_s + self.lateness_s} seconds")
            held = held.where(F.col("ts").isNull() | (F.col("ts") >= gone))
        latest = [F.desc("ts"), F.desc("id")]
        if self.keys:
            number = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*latest))
            held = held.withColumn("_n", number).where(F.col("_n") <= self.samples).drop("_n")
        else:
            held = held.orderBy(*latest).limit(self.samples)
        held.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch}")
        self._forget(spark, batch)

    def _forget(self, spark, batch: int) -> None:
        """Drop rings no replay can ask for any more: older than the batches the checkpoint keeps."""
        keep = int(spark.conf.get("spark.sql.streaming.minBatchesToRetain"))
        for old in [b for b in self._batches(spark) if b < batch][:-keep]:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id={old}")
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def ring_by_batches(path: str, sink, keys: list[str] | None = None, threshold: int = THRESHOLD, on_empty: str = "suppress", mode: str = "auto"):
    """A ``foreachBatch`` function: suppress near-duplicates, pass the rest to ``sink(df, batch_id)``.

    Uses the windows of the batch operator, so a burst on one key is spread
    over time tiles or blocks.
    """
    ring = CarriedRing(path, keys)

    def run(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            ringed = ring.ringed(rows, batch, mode)
            sink(ringed.where(is_new("ring", "payload", threshold, on_empty)).drop("ring"), batch)
            ring.store(rows, batch)
        finally:
            rows.unpersist()

    return run
