"""Named lists of expiring patterns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions.once import with_once
from alertmill.functions.text import expiry_time, list_item_id, pattern_id
from alertmill.operators.ordered import previous_rows
from alertmill.storage import materialize

KEY = ["list_name", "id"]
# Outcomes of list operations.
OK, DUPLICATE, NOT_FOUND, BAD_REQUEST, EXPIRED = "ok", "duplicate", "not_found", "bad_request", "expired"
ADD, REMOVE = "add", "rm"
# "Never expires" inside the fold, later than any timestamp.
_NEVER = np.iinfo(np.int64).max


def active_items(items: DataFrame, as_of: Column, expired_at: str = "expired_at") -> DataFrame:
    """Items not expired at ``as_of``; an item expires strictly after its time."""
    return items.where(F.col(expired_at).isNull() | (F.col(expired_at) >= as_of))


def first_adds(adds: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """First add of each id. Pre-aggregated, so a pattern added over and over is no hot group."""
    key = key or KEY
    rest = [c for c in adds.columns if c not in key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return adds.groupBy(*key).agg(first).select(*key, "_first.*").select(*adds.columns)


def add_outcomes(adds: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """All adds with ``status``: ok for the first of an id, duplicate for the others."""
    key = key or KEY
    winners = adds.groupBy(*key).agg(F.min(F.struct(*order)).alias("_winner"))
    joined = adds.join(winners, key)
    won = F.struct(*order) == F.col("_winner")
    return joined.withColumn("status", F.when(won, F.lit(OK)).otherwise(F.lit(DUPLICATE))).drop("_winner")


def remove_items(items: DataFrame, deletes: DataFrame, key: list[str] | None = None) -> DataFrame:
    key = key or KEY
    return items.join(deletes.select(*key).distinct(), key, "left_anti")


def delete_outcomes(
    items: DataFrame, deletes: DataFrame, order: list[str], key: list[str] | None = None
) -> DataFrame:
    """Deletes with ``status``; only the first delete of an id can find it."""
    key = key or KEY
    valid = (F.col(key[-1]) > 0) & (F.col(key[-1]) <= 4294967295)
    firsts = deletes.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    known = items.select(*key).distinct().withColumn("_known", F.lit(True))
    found = firsts.join(known, key, "left")
    status = (
        F.when(~F.coalesce(valid, F.lit(False)), F.lit(BAD_REQUEST))
        .when(F.col("_known") & (F.struct(*order) == F.col("_first")), F.lit(OK))
        .otherwise(F.lit(NOT_FOUND))
    )
    # Null-safe on the id, so that a request without one still gets its answer.
    found = found.select(*[F.col(k).alias(f"_{k}") for k in key], "_first", "_known")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return deletes.join(found, on, "left").withColumn("status", status).select(*deletes.columns, "status")


def list_sizes(items: DataFrame, as_of: Column, names: DataFrame | None = None) -> DataFrame:
    """Live items of each list; ``names`` adds known lists that hold none."""
    live = F.col("expired_at").isNull() | (F.col("expired_at") >= as_of)
    sizes = items.groupBy("list_name").agg(F.count_if(live).alias("n_live"), F.count(F.lit(1)).alias("n_items"))
    if names is None:
        return sizes
    return names.select("list_name").distinct().join(sizes, "list_name", "left").na.fill(0, ["n_live", "n_items"])


def empty_lists(items: DataFrame, as_of: Column, names: DataFrame | None = None) -> DataFrame:
    """Lists to forget: nothing live is left in them."""
    return list_sizes(items, as_of, names).where("n_live = 0").select("list_name")


def patterns_of(items: DataFrame, list_name: str) -> DataFrame:
    """All patterns of a list, expired or not; an unknown list is empty."""
    return items.where(F.col("list_name") == list_name).select("pattern").distinct()


def decode_uploads(df: DataFrame, body: str = "body") -> DataFrame:
    """Items posted as JSON: pattern, expired_at and id, ``status`` set for malformed ones."""
    out = with_once(
        df, _item=F.from_json(F.col(body), "pattern string, expired_at string"), _doc=F.try_parse_json(body)
    )
    typed = F.lit(True)
    for name in ("pattern", "expired_at"):
        field = F.schema_of_variant(F.try_variant_get("_doc", f"$.{name}", "variant"))
        typed = typed & F.coalesce(field.isin("STRING", "VOID"), F.lit(True))
    when_ = F.col("_item.expired_at")
    good = F.schema_of_variant("_doc").startswith("OBJECT<") & typed & (when_.isNull() | F.try_to_timestamp(when_).isNotNull())
    out = with_once(out, _good=F.coalesce(good, F.lit(False)))
    # A missing pattern is the empty pattern, as for any missing text.
    text = F.coalesce(F.col("_item.pattern"), F.lit(""))
    return out.select(
        *df.columns,
        F.when(F.col("_good"), text).alias("pattern"),
        F.when(F.col("_good"), expiry_time(when_)).alias("expired_at"),
        F.when(~F.col("_good"), F.lit(BAD_REQUEST)).alias("status"),
    ).withColumn("id", pattern_id("pattern"))


def upload_outcomes(uploads: DataFrame, order: list[str], body: str = "body") -> DataFrame:
    """Uploads (list_name, body) with ``status`` ok, duplicate or bad_request."""
    # Written once: it is read for the first of each id, for their outcomes and for the refused.
    decoded = materialize(decode_uploads(uploads, body), "uploads")
    good = add_outcomes(decoded.where("status is null").drop("status"), order)
    return good.unionByName(decoded.where("status is not null"))


def delete_requests(df: DataFrame, id_text: str) -> DataFrame:
    """Add ``id`` parsed from text, null when it is no valid id."""
    return df.withColumn("id", list_item_id(id_text))


# --- folding a command log into list state -------------------------------------------------


def _us(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def _stillborn() -> Column:
    """An add that has expired on arrival: it is never live, so it changes nothing."""
    return (F.col("op") == ADD) & F.col("expired_at").isNotNull() & (F.col("expired_at") < F.col("ts"))


def fold_commands(commands: DataFrame) -> DataFrame:
    """List state after a log of ``add`` and ``rm`` commands.

    Columns in: list_name, id, op, pattern, expired_at, ts, seq. An add is
    taken when the id is absent or expired at that moment, so the state is not
    the last write. Whatever came before the last ``rm`` of an id no longer
    counts, and of the adds of one instant only the first can be taken; both
    are settled by pre-aggregation. What is left holds one row per id and
    instant and is walked in time order with constant memory. Commands without
    an id change nothing.
    """
    rows = commands.where(F.col("id").isNotNull()).withColumn("_us", _us("ts"))
    last_rm = rows.where(F.col("op") == REMOVE).groupBy(*KEY).agg(F.max(F.struct("_us", "seq")).alias("_rm"))
    adds = rows.where((F.col("op") == ADD) & ~_stillborn()).join(last_rm, KEY, "left")
    adds = adds.where(F.col("_rm").isNull() | (F.struct("_us", "seq") > F.col("_rm")))
    instants = adds.groupBy(*KEY, "_us").agg(F.min_by(F.struct("pattern", "expired_at"), "seq").alias("_add"))
    instants = instants.select(
        *KEY, F.col("_us").alias("us"), "_add.pattern", _us("_add.expired_at").alias("exp_us")
    )
    placed = instants.repartition(*KEY).sortWithinPartitions(*KEY, "us")
    schema = "list_name string, id bigint, pattern string, exp_us bigint"
    return placed.mapInArrow(_last_taken, schema).select(
        *KEY, "pattern", F.timestamp_micros("exp_us").alias("expired_at")
    )


def _key_runs(batch: pa.RecordBatch) -> tuple[list[int], list]:
    """Starts of the runs of equal (list_name, id), closed by the row count, and their keys."""
    names = batch.column("list_name").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    names = np.nan_to_num(names, nan=-1)
    change = np.flatnonzero((names[1:] != names[:-1]) | (ids[1:] != ids[:-1])) + 1
    starts = [0, *change.tolist(), batch.num_rows]
    keys = [(batch.column("list_name")[s].as_py(), int(ids[s])) for s in starts[:-1]]
    return starts, keys


def _last_taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key, the add that is live last: hop to the first add after each expiry."""
    names, ids, patterns, expiries = [], [], [], []
    current, pattern, until = None, None, None

    def drain() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array(ids, pa.int64()),
                pa.array(patterns, pa.string()),
                pa.array([None if e == _NEVER else e for e in expiries], pa.int64()),
            ],
            names=["list_name", "id", "pattern", "exp_us"],
        )
        for column in (names, ids, patterns, expiries):
            column.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        us = batch.column("us").to_numpy(zero_copy_only=False)
        exp = batch.column("exp_us").fill_null(_NEVER).to_numpy(zero_copy_only=False)
        texts = batch.column("pattern")
        starts, keys = _key_runs(batch)
        for key, low, high in zip(keys, starts[:-1], starts[1:]):
            if key != current:
                if current is not None:
                    names.append(current[0]), ids.append(current[1])
                    patterns.append(pattern), expiries.append(until)
                current, until = key, None
            at = low if until is None else low + int(np.searchsorted(us[low:high], until, "right"))
            while at < high:
                pattern, until = texts[at].as_py(), int(exp[at])
                at = low + int(np.searchsorted(us[low:high], until, "right"))
        if len(ids) >= 10_000:
            yield drain()
    if current is not None:
        names.append(current[0]), ids.append(current[1])
        patterns.append(pattern), expiries.append(until)
    yield drain()


def command_outcomes(commands: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Every command with ``status``: ok, duplicate, not_found, expired on arrival, or bad_request without an id.

    Within one instant of an id the outcome follows from the command before.
    Only the first command of an instant needs the state carried over from
    earlier ones, which one row per instant is enough to work out.
    """
    limits = {} if max_group_rows is None else {"max_group_rows": max_group_rows}
    nameless = commands.where(F.col("id").isNull()).withColumn("status", F.lit(BAD_REQUEST))
    commands = commands.where(F.col("id").isNotNull())
    stillborn = commands.where(_stillborn()).withColumn("status", F.lit(EXPIRED))
    rows = commands.where(~_stillborn()).withColumn("_us", _us("ts"))
    instant = [*KEY, "_us"]
    rows = previous_rows(rows, ["seq"], 1, F.col("op"), "_prev", partition=instant, **limits)
    # Written once: the rows are used three times below.
    rows = materialize(rows, "commands")
    before = F.get("_prev", F.lit(0))
    follow = (
        F.when(F.col("op") == ADD, F.when(before == ADD, F.lit(DUPLICATE)).otherwise(F.lit(OK)))
        .when(before == ADD, F.lit(OK))
        .otherwise(F.lit(NOT_FOUND))
    )
    rows = rows.withColumn("_first", F.size("_prev") == 0)
    later = rows.where(~F.col("_first")).withColumn("status", follow)

    is_add = F.col("op") == ADD
    expiry = F.coalesce(_us("expired_at"), F.lit(_NEVER))
    opens = is_add & (before == REMOVE)
    cells = rows.groupBy(*instant).agg(
        F.min_by("op", "seq").alias("first_op"),
        F.min("seq").alias("first_seq"),
        F.min_by(expiry, F.when(is_add, F.col("seq"))).alias("first_exp"),
        F.max(F.when(~is_add, F.col("seq"))).alias("rm_seq"),
        F.max(F.when(opens, F.col("seq"))).alias("open_seq"),
        F.max_by(expiry, F.when(opens, F.col("seq"))).alias("open_exp"),
    )
    cells = cells.withColumn("open_exp", F.when(F.col("open_seq") > F.col("rm_seq"), F.col("open_exp")))
    placed = cells.repartition(*KEY).sortWithinPartitions(*instant)
    schema = "list_name string, id bigint, _us bigint, seq bigint, status string"
    firsts = placed.select(
        *instant, "first_op", "first_exp", "rm_seq", "open_exp", F.col("first_seq").alias("seq")
    ).mapInArrow(_first_outcomes, schema)
    resolved = rows.where("_first").join(firsts, [*instant, "seq"])
    columns = [*commands.columns, "status"]
    return later.select(*columns).unionByName(resolved.select(*columns)).unionByName(stillborn.select(*columns)).unionByName(nameless.select(*columns))


def _first_outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the instants of each key in order, carrying the expiry of the live item."""
    current, until = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        us = batch.column("_us").to_pylist()
        ops = batch.column("first_op").to_pylist()
        first = batch.column("first_exp").to_pylist()
        removed = batch.column("rm_seq").to_pylist()
        reopened = batch.column("open_exp").to_pylist()
        starts, keys = _key_runs(batch)
        status: list[str] = []
        for key, low, high in zip(keys, starts[:-1], starts[1:]):
            if key != current:
                current, until = key, None
            for i in range(low, high):
                live = until is not None and until >= us[i]
                if ops[i] == ADD:
                    status.append(DUPLICATE if live else OK)
                else:
                    status.append(OK if live else NOT_FOUND)
                if removed[i] is not None:
                    until = reopened[i]
                elif not live:
                    until = first[i]
        yield pa.RecordBatch.from_arrays(
            [batch.column("list_name"), batch.column("id"), batch.column("_us"), batch.column("seq"), pa.array(status)],
            names=["list_name", "id", "_us", "seq", "status"],
        )
