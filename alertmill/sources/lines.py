"""Line-oriented text that keeps its order across file splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.operators.ordered import dense_numbers


def _without_end(text: Column, end: str) -> Column:
    return F.when(F.endswith(text, F.lit(end)), text.substr(F.lit(1), F.length(text) - 1)).otherwise(text)


def read_lines(spark: SparkSession, path: str, number: bool = True) -> DataFrame:
    """``value`` per line, one trailing carriage return removed, and ``line_no`` from 1."""
    df = spark.read.option("lineSep", "\n").text(path)
    df = df.select(_without_end(F.col("value"), "\r").alias("value"))
    return dense_numbers(df, "line_no", first=1) if number else df


def split_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per line of a text column, ``line_in_text`` from 0; no row for a closing newline."""
    parts = F.when(F.length(F.col(text)) > 0, F.split(_without_end(F.col(text), "\n"), "\n"))
    return df.select(*keys, F.posexplode(parts).alias("line_in_text", "value")).withColumn(
        "value", _without_end(F.col("value"), "\r")
    )
