"""List snapshots ``{id: {pattern, expired_at}}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions.text import expiry_time
from alertmill.schemas import LIST_ITEM, SNAPSHOT

# Fixed value: ids are unsigned 32-bit numbers.
MAX_ID = 4294967295


def decode_snapshot(df: DataFrame, body: str = "body", list_name: str = "list_name") -> DataFrame:
    """Items of JSON snapshots; a body that does not parse gives no items."""
    items = F.from_json(F.col(body), SNAPSHOT)
    return df.select(F.col(list_name).alias("list_name"), F.explode(items).alias("key", "item")).select(
        "list_name",
        F.col("key").try_cast("bigint").alias("id"),
        F.col("item.pattern").alias("pattern"),
        expiry_time(F.col("item.expired_at")).alias("expired_at"),
    )


def read_snapshot(spark: SparkSession, path: str, list_name: str) -> DataFrame:
    """Read pages of a list snapshot written as JSON text, one document per line.

    Fails when the file is missing or a document is not an object of item ids
    (0 to 4294967295) with items that have a pattern and, if any, an expiry
    time as text, so that the caller keeps the snapshot it has.
    """
    lines = spark.read.text(path)
    refused = F.raise_error(F.lit("not a list snapshot"))
    checked = lines.select(F.lit(list_name).alias("list_name"), F.when(is_snapshot(F.col("value")), F.col("value")).otherwise(refused).alias("body"))
    return decode_snapshot(checked)


def is_snapshot(body: Column) -> Column:
    """True for a JSON object of unsigned 32-bit ids and well-formed items."""
    items = F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")

    def good(entry: Column) -> Column:
        number = entry.getField("key").try_cast("bigint")
        kind = lambda path: F.schema_of_variant(F.try_variant_get(entry.getField("value"), path, "variant"))
        return (
            entry.getField("key").rlike("^[0-9]{1,10}$")
            & (number <= MAX_ID)
            & F.coalesce(kind("$.pattern") == "STRING", F.lit(False))
            & F.coalesce(kind("$.expired_at") == "STRING", F.lit(True))
        )

    return F.coalesce(F.forall(F.map_entries(items), good), F.lit(False))


def empty_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LIST_ITEM)
