"""The device inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.operators.ordered import dense_numbers
from alertmill.schemas import DEVICE

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"
_SHORT = rf"(?:{_H}(?::{_H})*)?::"
# Full form, or one "::" with at most seven groups beside it; an IPv4 address can stand for the last two.
_V6 = (
    rf"(?:{_H}:){{7}}{_H}|(?!:*(?:{_H}(?::+|\z)){{8}}){_SHORT}(?:{_H}(?::{_H})*)?"
    rf"|(?:{_H}:){{6}}{_V4}|(?!:*(?:{_H}:+){{6}}){_SHORT}(?:{_H}:)*{_V4}"
)


def valid_ip(ip: Column | str) -> Column:
    col = F.col(ip) if isinstance(ip, str) else ip
    return col.rlike(rf"\A(?:{_V4})\z") | col.rlike(rf"\A(?:{_V6})\z")


def read_devices(spark: SparkSession, path: str, json_lines: bool = False, number: bool = False) -> DataFrame:
    """Devices of a JSON array file, or of JSON lines, which large inventories should use.

    A file that cannot be read or parsed, or a bad address, fails the load.
    ``number`` adds ``id``, the dense position in the file order.
    """
    reader = spark.read.schema(DEVICE).option("mode", "FAILFAST")
    df = reader.option("multiLine", not json_lines).json(path)
    bad = F.col("ip").isNotNull() & (F.col("ip") != "") & ~valid_ip("ip")
    df = df.withColumn(
        "ip", F.when(bad, F.raise_error(F.concat(F.lit("invalid ip: "), F.col("ip")))).otherwise(F.nullif("ip", F.lit("")))
    )
    if not number:
        return df
    return dense_numbers(df, "id", first=0)
