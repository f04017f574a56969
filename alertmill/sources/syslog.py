"""Decode JSON log payloads, one document each."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.schemas import SYSLOG, SYSLOG_FIELDS
from alertmill.session import prepare

# Reject reasons.
NOT_ONE_DOCUMENT = "not_one_document"
NOT_AN_OBJECT = "not_an_object"
WRONG_FIELD_TYPE = "wrong_field_type"


def _wrapped(payload: Column) -> Column:
    # A closing mark the payload cannot know: text after the document, or a
    # second document, breaks the outer array or moves the mark.
    return F.concat(F.lit("[["), payload, F.lit('],"'), F.md5(payload.cast("binary")), F.lit('"]'))


def parse_syslog(df: DataFrame, payload: str = "payload", lenient: bool = False) -> DataFrame:
    """Add the message fields and ``reject_reason`` (null for a good message).

    The payload stays as it came. Strict mode wants exactly one JSON object
    whose known fields are strings or null. ``lenient`` takes whatever
    ``from_json`` accepts.
    """
    prepare(df.sparkSession)
    if lenient:
        parsed = F.from_json(F.col(payload), SYSLOG, {"columnNameOfCorruptRecord": "_corrupt"})
        out = df.withColumn("_m", parsed)
        fields = [F.col("_m").getField(name).alias(name) for name in SYSLOG_FIELDS]
        reason = F.when(F.col("_m").isNull(), F.lit(NOT_ONE_DOCUMENT)).alias("reject_reason")
        return out.select("*", *fields, reason).drop("_m")

    # One-row generators: later filters stay above them, so each step is done once.
    out = df.select("*", F.explode(F.array(F.try_parse_json(_wrapped(F.col(payload))))).alias("_v"))
    mark = F.try_variant_get("_v", "$[1]", "string")
    second = F.try_variant_get("_v", "$[0][1]", "variant")
    root = F.try_variant_get("_v", "$[0][0]", "variant")
    head = F.struct(mark.alias("_mark"), second.isNull().alias("_single"), root.alias("_root"))
    out = out.select(*df.columns, F.inline(F.array(head)))
    whole = F.coalesce((F.col("_mark") == F.md5(F.col(payload).cast("binary"))) & F.col("_single"), F.lit(False))
    values = [F.try_variant_get("_root", f"$.{name}", "variant").alias(f"_{name}") for name in SYSLOG_FIELDS]
    parts = F.struct(whole.alias("_whole"), F.schema_of_variant("_root").substr(1, 7).alias("_kind"), *values)
    out = out.select(*df.columns, F.inline(F.array(parts)))

    wrong = reduce(or_, [~F.schema_of_variant(f"_{name}").isin("STRING", "VOID") for name in SYSLOG_FIELDS])
    kind = F.col("_kind")
    reason = (
        F.when(~F.col("_whole") | kind.isNull(), F.lit(NOT_ONE_DOCUMENT))
        .when((kind != "OBJECT<") & (kind != "VOID"), F.lit(NOT_AN_OBJECT))
        .when(F.coalesce(wrong, F.lit(False)), F.lit(WRONG_FIELD_TYPE))
    )
    fields = [F.try_variant_get(f"_{name}", "$", "string").alias(name) for name in SYSLOG_FIELDS]
    return out.select(*df.columns, *fields, reason.alias("reject_reason"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).drop(*SYSLOG_FIELDS)
