"""The given tables seen as messages, lists, chats, devices, probes and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions.text import pattern_id
from alertmill.session import prepare
from alertmill.sources.lines import split_lines
from alertmill.storage import spread

LIST_NAMES = ["ban", "notify"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(col: str):
    return F.col(col).cast("timestamp_ntz")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ts, payload``: every event as a JSON log message."""
    fields = F.struct(
        F.col("user_id").cast("string").alias("host"),
        F.col("event_type").alias("severity"),
        F.lit("app").alias("facility"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("props").alias("msg"),
    )
    events = spread(table(spark, sf_dir, "events").drop("value"))
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.to_json(fields).alias("payload")
    )


def damaged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, spoiled in a way that depends on their severity."""
    p = F.col("payload")
    kind = F.get_json_object(p, "$.severity")
    spoiled = (
        F.when(kind == "view", F.expr("left(payload, length(payload) - 5)"))
        .when(kind == "purchase", F.regexp_replace(p, '"host":"([0-9]+)"', '"host":$1'))
        .when(kind == "signup", F.concat(p, F.lit(" "), p))
        .when(kind == "error", F.concat(F.lit("["), p, F.lit("]")))
        .otherwise(p)
    )
    return messages(spark, sf_dir).withColumn("payload", spoiled)


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props").alias("payload"),
    )


def list_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an add of its ``props`` to the list of its type."""
    hours = F.col("user_id") % 50
    expires = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + hours * 3_600_000_000)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("list_name"),
        pattern_id("props").alias("id"),
        F.col("props").alias("pattern"),
        F.when(F.col("user_id") % 11 != 0, expires).alias("expired_at"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        "value",
        "user_id",
    )


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a list command: errors remove, the others add."""
    adds = list_adds(spark, sf_dir)
    remove = F.col("list_name") == "error"
    return adds.select(
        F.concat(F.lit("list"), (F.col("user_id") % 5).cast("string")).alias("list_name"),
        "id",
        F.when(remove, F.lit("rm")).otherwise(F.lit("add")).alias("op"),
        F.when(~remove, F.col("pattern")).alias("pattern"),
        F.when(~remove, F.col("expired_at")).alias("expired_at"),
        "ts",
        "seq",
    )


def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a chat text; a role stands for a command."""
    turns = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    text = (
        F.when(F.col("role") == "user", F.concat(F.lit("/list ban add "), F.col("turn").cast("string"), F.lit("h30m "), F.col("text")))
        .when(F.col("role") == "assistant", F.concat(F.lit("/list notify add "), F.col("turn").cast("string"), F.lit(" "), F.col("text")))
        .otherwise(F.concat(F.lit("/whois "), F.col("text")))
    )
    return turns.select(
        number.alias("update_id"),
        F.col("conv_id").cast("string").alias("from"),
        text.alias("text"),
        F.timestamp_seconds(F.lit(1_700_000_000) + number).alias("ts"),
    )


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a chat command on the ban list, or as a search."""
    events = table(spark, sf_dir, "events")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    text = (
        F.when(kind.isin("click", "signup"), F.concat(F.lit("/list ban add "), user, F.lit("h "), F.col("props")))
        .when(kind == "view", F.concat(F.lit("/list ban rm "), pattern_id("props").cast("string")))
        .when(kind == "error", F.lit("/list ban ls"))
        .otherwise(F.concat(F.lit("/whois #0*"), (F.col("user_id") % 10).cast("string"), F.lit("$")))
    )
    return events.select(
        F.col("event_id").alias("update_id"), user.alias("from"), text.alias("text"), F.col("ts").cast("timestamp").alias("ts")
    )


def chat_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``body``: every turn as an update envelope; system turns fail, assistants post to a channel."""
    turns = table(spark, sf_dir, "conversations")
    message = F.struct(
        F.col("turn").cast("int").alias("message_id"),
        (F.lit(1_700_000_000) + F.col("turn") * 60).alias("date"),
        F.col("text"),
        F.struct(F.col("conv_id").alias("id"), F.lit("private").alias("type")).alias("chat"),
    )
    update = F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("update_id"),
        F.when(F.col("role") != "user", message).alias("channel_post"),
        F.when(F.col("role") != "assistant", message).alias("message"),
    )
    return turns.select(F.to_json(F.struct((F.col("role") != "system").alias("ok"), F.array(update).alias("result"))).alias("body"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a device with its brand, type and size as attributes."""
    key = F.col("p_partkey")
    ip = F.concat_ws(".", F.lit("10"), *[F.pmod(F.shiftright(key, s), F.lit(256)).cast("string") for s in (16, 8, 0)])
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        ip.alias("ip"),
        F.create_map(
            F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")
        ).alias("attributes"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, value``: the lines of all documents, numbered in document order."""
    lines = split_lines(documents(spark, sf_dir), "text", ["doc_id"])
    return lines.select(
        F.shiftleft("doc_id", 24).bitwiseOR(F.col("line_in_text").cast("bigint")).alias("line_no"), "value"
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nonce, sent_at``: every error event as a probe."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.select(F.col("event_id").alias("nonce"), F.col("ts").cast("timestamp").alias("sent_at"))
