"""Chat updates as a stream; the checkpoint is the offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.operators.chat import FRESH_S, fresh_messages
from alertmill.schemas import CHAT_ENVELOPE
from alertmill.sources.chat import updates


def stream_updates(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CHAT_ENVELOPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return updates(reader.json(path))


def stream_messages(
    spark: SparkSession, path: str, as_of_unix: Column | None = None, max_age_s: int = FRESH_S, max_files: int | None = None
) -> DataFrame:
    """Fresh messages; ``as_of_unix`` defaults to the time of the trigger."""
    now = F.unix_timestamp(F.current_timestamp()) if as_of_unix is None else as_of_unix
    return fresh_messages(stream_updates(spark, path, max_files), now, max_age_s)
