"""Outgoing alerts and published messages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions.text import PARSE_MODE_HTML, chat_id, html_alert
from alertmill.storage import delete_dir, get_text, list_dir, put_text


def alerts(df: DataFrame, to: Column, text: Column, keep: list[str] | None = None) -> DataFrame:
    """``chat_id, parse_mode, text`` plus ``reject_reason`` for what cannot be sent."""
    address, body = chat_id(to), html_alert(text)
    reason = F.when(address.isNull(), F.lit("chat id unspecified")).when(body.isNull(), F.lit("message text is empty"))
    return df.select(
        *(keep or []),
        address.alias("chat_id"),
        F.lit(PARSE_MODE_HTML).alias("parse_mode"),
        body.alias("text"),
        reason.alias("reject_reason"),
    )


def sendable(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.where("reject_reason is null").drop("reject_reason")


OUTBOX = "id bigint, chat_id bigint, parse_mode string, text string"


def write_outbox(alert_rows: DataFrame, path: str, batch: int) -> None:
    """Write one batch of alerts; a replay of the batch replaces it.

    Every attempt has a folder of its own and counts from the moment its manifest entry is renamed into place, so readers
    see the rows of the attempt before or those of the new one. The attempt before stays for those who have
    listed it already; older ones go.
    """
    spark, attempt = alert_rows.sparkSession, uuid.uuid4().hex
    entry = f"{path}/_committed/{batch}"
    sendable(alert_rows).write.parquet(f"{path}/batch_id={batch}/attempt={attempt}")
    before = (get_text(spark, entry) or "").split()[:1]
    put_text(spark, entry, " ".join([attempt, *before]))
    for name in list_dir(spark, f"{path}/batch_id={batch}"):
        if name.removeprefix("attempt=") not in (attempt, *before):
            delete_dir(spark, f"{path}/batch_id={batch}/{name}")


def read_outbox(spark: SparkSession, path: str, schema: str = OUTBOX) -> DataFrame:
    """All alerts of committed batches with their ``batch_id``; what an unfinished attempt has written is not seen."""
    batches = [name for name in list_dir(spark, f"{path}/_committed") if name.isdigit()]
    found = [f"{path}/batch_id={b}/attempt={get_text(spark, f'{path}/_committed/{b}').split()[0]}" for b in batches]
    if not found:
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    rows = spark.read.schema(f"{schema}, batch_id bigint, attempt string").option("basePath", path).parquet(*found)
    return rows.drop("attempt")


def publish(messages: DataFrame, path: str, mode: str = "append", max_records: int = 5_000_000) -> None:
    """Write (subject, payload, severity, facility) so that subject filters prune folders.

    The rebalance evens out file sizes: small folders share a task, a large
    one is split over many.
    """
    spread = messages.hint("rebalance", "severity", "facility")
    spread.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy("severity", "facility").parquet(path)


def publish_stream(messages: DataFrame, path: str, checkpoint: str):
    """The same for a stream; start the returned writer with ``start()``."""
    return (
        messages.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("severity", "facility")
        .outputMode("append")
    )
