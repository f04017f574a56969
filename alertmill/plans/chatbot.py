"""From chat updates to list state and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.operators.chat import list_commands, parse_adds, parse_removes, parse_whois, route_commands
from alertmill.operators.documents import list_line, pages, reply_texts
from alertmill.operators.grep import grep_outcomes
from alertmill.operators.history import item_history, items_at, moment_of
from alertmill.operators.lists import BAD_REQUEST, KEY, active_items, command_outcomes, fold_commands
from alertmill.storage import materialize

# Reply texts.
ADDED, REMOVED = "record added", "record removed"


def list_state(messages: DataFrame, list_names: list[str]) -> DataFrame:
    """Items of the lists after all commands of the messages."""
    return fold_commands(list_commands(route_commands(messages, list_names, whois=False), list_names))


def change_replies(messages: DataFrame, list_names: list[str]) -> DataFrame:
    """``from, text`` answering every ``add`` and ``rm``, with what really happened to it."""
    # Written once: adds, removes and refusals are all read from it.
    commands = materialize(route_commands(messages, list_names, whois=False), "routed")
    asked = commands.select("list_name", F.col("update_id").cast("bigint").alias("seq"), "from", "command")
    done = command_outcomes(list_commands(commands, list_names)).select("list_name", "seq", F.col("op").alias("command"), "status")
    said = (
        F.when(F.col("status") != "ok", F.concat(F.lit("can't change the list, "), F.col("status")))
        .when(F.col("command") == "add", F.lit(ADDED))
        .otherwise(F.lit(REMOVED))
    )
    replies = asked.join(done, ["list_name", "seq", "command"]).select("from", said.alias("text"))
    bad_adds = parse_adds(commands, list_names).where("reply is not null").select("from", F.col("reply").alias("text"))
    bad_removes = (
        parse_removes(commands, list_names)
        .where("id is null")
        .select("from", F.lit(f"can't change the list, {BAD_REQUEST}").alias("text"))
    )
    return replies.unionByName(bad_adds).unionByName(bad_removes)


def list_replies(commands: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """``from, text`` answering every ``ls`` from a list state."""
    asked = commands.where(F.col("command") == "ls").select("from", "list_name")
    live = active_items(items, as_of)
    texts = reply_texts(live, ["list_name"], "id", F.rtrim(list_line(), F.lit("\n")))
    return asked.join(texts, "list_name", "left").select(
        "from", F.coalesce(F.concat("text", F.lit("\n")), F.lit("")).alias("text")
    )


def list_replies_then(commands: DataFrame, list_names: list[str]) -> DataFrame:
    """``from, text`` answering every ``ls`` with the list as it was when it was asked.

    ``commands`` are routed messages with ``ts`` and ``update_id``; of one instant those with smaller ids come first.
    """
    # Written once: the log and the questions are both read from it.
    commands = materialize(commands, "routed")
    asked = commands.where(F.col("command") == "ls").select("from", "list_name", *moment_of("ts", "update_id"))
    history = item_history(list_commands(commands, list_names))
    line = F.rtrim(list_line(), F.lit("\n"))
    # An item is in a list once at a time, so no reply is longer than the longest lines of all items of its list.
    longest = history.groupBy(*KEY).agg((F.max(F.octet_length(line)) + 1).alias("n"))
    most = longest.groupBy("list_name").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    keys = ["list_name", "at_us", "at_seq"]
    texts = pages(items_at(asked, history), keys, "id", line, most_bytes=most)
    return asked.join(texts, keys, "left").select("from", F.coalesce(F.concat("body", F.lit("\n")), F.lit("")).alias("text"))


def whois_replies(commands: DataFrame, lines: DataFrame, position: str) -> DataFrame:
    """``from, text`` answering every ``whois``, a row per page of the reply."""
    asked = parse_whois(commands)
    found = grep_outcomes(lines, asked.select("pattern").distinct(), position, query_id="pattern")
    answer = F.coalesce(
        "found_text", F.concat(F.col("status"), F.lit(" from whois-service for query:"), F.col("pattern"))
    )
    found = found.select(F.col("pattern"), "status", F.col("text").alias("found_text"))
    return asked.select("from", "pattern").join(found, "pattern", "left").select("from", answer.alias("text"))
