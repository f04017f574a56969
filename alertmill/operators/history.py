"""What lists held at any moment: validity intervals out of the command log, and moments joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.operators.lists import ADD, KEY, OK, REMOVE, command_outcomes
from alertmill.operators.ordered import previous_rows
from alertmill.storage import materialize

LEAST_BIN_BITS = 12  # bins of the time from the first to the last moment, on the finest level, as a power of two
SPANS_PER_BIN = 16  # intervals for which there is a bin at least
STEP_BITS = 3  # a bin of a level holds eight of the level below


def bin_bits(n_spans: int) -> int:
    """Bins as a power of two, in whole steps: a moment meets the intervals of its bin, so these must not grow with the log."""
    wanted = max(0, n_spans // SPANS_PER_BIN).bit_length()
    return max(LEAST_BIN_BITS, -(-wanted // STEP_BITS) * STEP_BITS)


def item_history(commands: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """One row for every time an item was in a list: KEY, pattern, expired_at, from_us, from_seq, to_us, to_seq.

    Columns in: as for ``fold_commands``. An item is there after its add, until the remove that found it (``to_us`` and
    ``to_seq``, null without one) and up to ``expired_at``. Written as a table; changes that had no effect make no row.
    """
    limits = {} if max_group_rows is None else {"max_group_rows": max_group_rows}
    done = command_outcomes(commands, max_group_rows).where(F.col("status") == OK)
    done = done.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    backwards = done.withColumns({"_later": -F.col("_us"), "_later_seq": -F.col("seq")})
    after = F.struct(F.col("op"), F.col("_us").alias("us"), "seq")
    backwards = previous_rows(backwards, ["_later", "_later_seq"], 1, after, "_next", partition=KEY, **limits)
    ended = F.get("_next", F.lit(0))
    ended = F.when(ended.getField("op") == REMOVE, ended)
    rows = backwards.where(F.col("op") == ADD).select(
        *KEY, "pattern", "expired_at", F.col("_us").alias("from_us"), F.col("seq").alias("from_seq"),
        ended.getField("us").alias("to_us"), ended.getField("seq").alias("to_seq"),
    )
    return materialize(rows, "history")


def items_at(moments: DataFrame, history: DataFrame) -> DataFrame:
    """Items that were live at each moment (list_name, at_us, at_seq): those columns, id, pattern, expired_at.

    The time of the moments is cut into bins on several levels. An interval goes to the finest level on which it covers
    a few bins, a moment to its bin on every level, so rows meet by equality and none is copied more than
    a few times, however long it is valid. The more intervals there are, the finer the bins.
    """
    span = moments.agg(F.min("at_us").alias("low"), F.max("at_us").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    bits = bin_bits(history.count())
    levels_of = bits // STEP_BITS + 1
    width = (high - low) // (1 << bits) + 1
    bin_of = lambda us: F.expr(f"({us} - {low}L) div {width}L")
    end = F.least(F.coalesce("to_us", F.lit(high)), F.coalesce(F.unix_micros("expired_at"), F.lit(high)), F.lit(high))
    spans = history.withColumns({"_begin": F.greatest("from_us", F.lit(low)), "_end": end}).where("_begin <= _end")
    spans = spans.withColumns({"_first": bin_of("_begin"), "_last": bin_of("_end")})
    at_level = lambda c, k: F.shiftright(c, STEP_BITS * k)
    fits = lambda k: at_level("_last", k) - at_level("_first", k) <= 1 << STEP_BITS
    level = F.coalesce(*[F.when(fits(k), F.lit(k)) for k in range(levels_of)], F.lit(levels_of - 1))
    spans = spans.withColumn("_level", level)
    covered = F.expr(f"sequence(shiftright(_first, {STEP_BITS} * _level), shiftright(_last, {STEP_BITS} * _level))")
    spans = spans.withColumn("_bin", F.explode(covered)).drop("_begin", "_end", "_first", "_last")

    levels = F.array(*[F.struct(F.lit(k).alias("_level"), at_level(bin_of("at_us"), k).alias("_bin")) for k in range(levels_of)])
    asked = moments.select("list_name", "at_us", "at_seq").distinct().select("*", F.inline(levels))
    met = asked.join(spans, ["list_name", "_level", "_bin"])
    moment = F.struct(F.col("at_us").alias("us"), F.col("at_seq").alias("seq"))
    begun = F.struct(F.col("from_us").alias("us"), F.col("from_seq").alias("seq")) < moment
    gone = F.coalesce(F.struct(F.col("to_us").alias("us"), F.col("to_seq").alias("seq")) < moment, F.lit(False)) & F.col("to_us").isNotNull()
    late = F.coalesce(F.unix_micros("expired_at") < F.col("at_us"), F.lit(False))
    return met.where(begun & ~gone & ~late).select("list_name", "at_us", "at_seq", "id", "pattern", "expired_at")


def moment_of(ts: str, seq: str) -> tuple[Column, Column]:
    return F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(seq).cast("bigint").alias("at_seq")
