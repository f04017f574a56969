"""Chat updates and the commands in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions import text as fx
from alertmill.functions.once import with_once
from alertmill.operators.lists import ADD, REMOVE
from alertmill.operators.patterns import PatternSet, literal_patterns, route_matches

# Fixed values.
FRESH_S = 180
LIST_COMMANDS = {
    "ls": "/list {} ls",
    "add": "/list {} add [0-9hm]* .*",
    "rm": "/list {} rm [0-9]*",
    "help": "/list {} help",
}
WHOIS_PATTERN = "/whois .*"


def chosen_message(update: str | None = None) -> Column:
    """The direct message if it has a date, else the channel post, else null."""
    prefix = f"{update}." if update else ""
    direct, post = F.col(f"{prefix}message"), F.col(f"{prefix}channel_post")
    return F.when(direct.getField("date") > 0, direct).when(post.getField("date") > 0, post)


def fresh_messages(updates: DataFrame, as_of_unix: Column, max_age_s: int = FRESH_S) -> DataFrame:
    """``update_id, from, text, ts`` of updates younger than ``max_age_s``.

    A stale direct message does not fall back to the channel post.
    """
    picked = updates.select("update_id", chosen_message().alias("m")).where(F.col("m").isNotNull())
    return picked.where(as_of_unix - F.col("m.date") < max_age_s).select(
        "update_id",
        F.coalesce(F.col("m.chat.id"), F.lit(0)).cast("string").alias("from"),
        F.coalesce(F.col("m.text"), F.lit("")).alias("text"),
        F.timestamp_seconds("m.date").alias("ts"),
    )


def next_offset(updates: DataFrame, previous: int = 0) -> DataFrame:
    """One row: the highest update id of all rows plus one, never below ``previous``."""
    return updates.agg(F.greatest(F.coalesce(F.max("update_id") + 1, F.lit(previous)), F.lit(previous)).alias("next_offset"))


def command_routes(spark, list_names: list[str], whois: bool = True) -> PatternSet:
    """Routes ``list/command`` for each list, and ``/whois``."""
    pairs: list[tuple[str | None, str | None]] = [
        (f"{name}/{command}", pattern.format(name)) for name in list_names for command, pattern in LIST_COMMANDS.items()
    ]
    if whois:
        pairs.append(("/whois", WHOIS_PATTERN))
    return literal_patterns(spark, pairs)


def route_commands(messages: DataFrame, list_names: list[str], whois: bool = True, text: str = "text") -> DataFrame:
    """One row per command a text fires: ``list_name`` (null for whois) and ``command``."""
    routed = route_matches(messages, text, command_routes(messages.sparkSession, list_names, whois))
    parts = F.split("route", "/")
    name = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return routed.select(
        *messages.columns, F.when(name != "", name).alias("list_name"), F.element_at(parts, -1).alias("command")
    )


def _per_list(list_names: list[str], make) -> Column:
    out = F.lit(None).cast("string")
    for name in list_names:
        out = F.when(F.col("list_name") == name, make(name)).otherwise(out)
    return out


def parse_adds(commands: DataFrame, list_names: list[str], text: str = "text", ts: str = "ts") -> DataFrame:
    """``add`` commands with id, pattern, expired_at; ``reply`` is set when the duration is bad."""
    adds = commands.where(F.col("command") == "add")
    adds = with_once(
        adds,
        _duration=_per_list(list_names, lambda n: fx.add_args(text, n)[0]),
        pattern=_per_list(list_names, lambda n: fx.add_args(text, n)[1]),
    )
    adds = with_once(adds, _seconds=fx.duration_seconds("_duration"))
    return (
        adds.withColumn("id", fx.pattern_id("pattern"))
        .withColumn("expired_at", fx.expiry(ts, F.col("_seconds")))
        .withColumn("reply", F.when(F.col("_seconds").isNull(), fx.incorrect_duration("_duration")))
        .drop("_duration", "_seconds")
    )


def parse_removes(commands: DataFrame, list_names: list[str], text: str = "text") -> DataFrame:
    """``rm`` commands with ``id``, null when it is no valid id."""
    removes = commands.where(F.col("command") == "rm")
    return removes.withColumn("id", fx.list_item_id(_per_list(list_names, lambda n: fx.rm_arg(text, n))))


def parse_whois(commands: DataFrame, text: str = "text") -> DataFrame:
    """``whois`` commands with the ``pattern`` to search for."""
    return commands.where((F.col("command") == "whois") & F.col("list_name").isNull()).withColumn("pattern", fx.whois_arg(text))


def list_commands(commands: DataFrame, list_names: list[str], seq: str = "update_id") -> DataFrame:
    """The command log for the fold: list_name, id, op, pattern, expired_at, ts, seq."""
    adds = parse_adds(commands, list_names).where("reply is null")
    removes = parse_removes(commands, list_names).where("id is not null")
    columns = ["list_name", "id", "op", "pattern", "expired_at", "ts", "seq"]
    adds = adds.withColumn("op", F.lit(ADD)).withColumn("seq", F.col(seq).cast("bigint"))
    removes = (
        removes.withColumn("op", F.lit(REMOVE))
        .withColumn("seq", F.col(seq).cast("bigint"))
        .withColumn("pattern", F.lit(None).cast("string"))
        .withColumn("expired_at", F.lit(None).cast("timestamp"))
    )
    return adds.select(*columns).unionByName(removes.select(*columns))
