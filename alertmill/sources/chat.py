"""Chat update envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.schemas import CHAT_ENVELOPE


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT_ENVELOPE).json(path)


def decode_envelopes(df: DataFrame, body: str = "body") -> DataFrame:
    """Envelope columns of JSON texts; a body that does not parse gives ``ok`` null."""
    parsed = F.from_json(F.col(body), CHAT_ENVELOPE)
    return df.select(F.explode(F.array(parsed)).alias("_e")).select("_e.ok", "_e.result")


def updates(envelopes: DataFrame) -> DataFrame:
    """One row per update of the envelopes that are ok."""
    return envelopes.where("ok").select(F.inline("result"))
