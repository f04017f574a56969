"""Row order at scale: neighbours, numbers and running sums without one big sort task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.storage import materialize

# Rows one window partition may hold before another way is taken.
MAX_GROUP_ROWS = 500_000
BLOCK_ROWS = 50_000
_POSITION_BITS = 33


def largest_group(df: DataFrame, keys: list[Column | str]) -> int:
    """Size of the largest group: counted before the shuffle, one number back."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _starts(table: DataFrame, position: str) -> DataFrame:
    """First global rank of each partition of a table numbered by ``position``.

    One row per partition: the count of partitions bounds what is collected.
    """
    spark = table.sparkSession
    counts = (
        table.groupBy(F.shiftright(position, _POSITION_BITS).alias("_part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("_part")
        .collect()
    )
    rows, total = [], 0
    for row in counts:
        rows.append((row["_part"], total))
        total += row["n"]
    return spark.createDataFrame(rows, "_part bigint, _start bigint")


def _with_rank(table: DataFrame, position: str, out: str) -> DataFrame:
    offset = F.col(position).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    starts = F.broadcast(_starts(table, position))  # one row per partition
    return (
        table.withColumn("_part", F.shiftright(position, _POSITION_BITS))
        .join(starts, "_part")
        .withColumn(out, F.col("_start") + offset)
        .drop("_part", "_start")
    )


def global_rank(df: DataFrame, order: list[str], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Dense rank from 0 over the whole table by a unique ``order``.

    Range partitioning balances the sort whatever the keys hold; the sorted
    rows are written once so that every later use sees the same positions.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = materialize(placed.withColumn("_position", F.monotonically_increasing_id()), "ranked")
    return _with_rank(table, "_position", out).drop("_position")


def dense_numbers(df: DataFrame, out: str, first: int) -> DataFrame:
    """Number the rows of a file scan in file order.

    Splits of a scan are ordered by file and offset, rows within a split by
    their position, so only the count of each split has to be summed up.
    """
    marked = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_position"),
    )
    table = materialize(marked, "numbered")
    # One row per file split; the window runs over that list, not over the rows.
    splits = table.groupBy("_file", "_offset").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_position").alias("_low")
    )
    before = Window.orderBy("_file", "_offset").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = table.join(splits, ["_file", "_offset"])
    return numbered.withColumn(out, F.col("_before") + F.col("_position") - F.col("_low") + first).drop(
        "_file", "_offset", "_position", "_low", "_before"
    )


def previous_rows(
    df: DataFrame,
    order: list[str],
    k: int,
    value: Column,
    out: str,
    partition: list[str] | None = None,
    mode: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``out``: the ``value`` of up to ``k`` rows before each row, oldest first.

    ``order`` must be unique within ``partition``. ``window`` uses one window
    per partition; ``blocks`` cuts the global order into equal blocks, each
    with the ``k`` rows before it, so no group can be too large; ``auto``
    measures the groups and decides.
    """
    partition = partition or []
    if mode == "auto":
        mode = "window" if largest_group(df, partition) <= max_group_rows else "blocks"
    if mode == "window":
        frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-k, -1)
        return df.withColumn(out, F.collect_list(value).over(frame))
    if mode != "blocks":
        raise ValueError(f"unknown mode {mode!r}")
    if block_rows < k:
        raise ValueError("a block must hold at least k rows")

    ranked = global_rank(df, [*partition, *order], "_rank")
    block = F.expr(f"_rank div {block_rows}")
    tail = F.pmod("_rank", F.lit(block_rows)) >= block_rows - k
    copies = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    spread = ranked.withColumn("_block", F.explode(copies))
    frame = Window.partitionBy("_block").orderBy("_rank").rowsBetween(-k, -1)
    keys = F.struct(*[F.col(c) for c in partition]) if partition else F.lit(0)
    entry = F.struct(keys.alias("k"), value.alias("v"))
    spread = spread.withColumn("_window", F.collect_list(entry).over(frame)).where(F.col("_block") == block)
    same = F.filter("_window", lambda e: e.getField("k").eqNullSafe(keys))
    return spread.withColumn(out, F.transform(same, lambda e: e.getField("v"))).drop("_window", "_block", "_rank")


def running_start(
    df: DataFrame, keys: list[str], position: str, size: Column, out: str, shift: int = 16, levels: int = 1
) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows of the key at lower ``position``.

    ``position`` is a bigint, unique within the key. Sums run inside ranges of
    ``2**shift`` positions and then over the ranges, so no window holds a whole
    key. With more ``levels`` the sums over the ranges are made in the same way,
    for a key with very many ranges.
    """
    sized = df.withColumn("_size", size).withColumn("_range", F.shiftright(position, shift))
    inner = Window.partitionBy(*keys, "_range").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy(*keys, "_range").agg(F.sum("_size").alias("_total"))
    if levels > 1:
        wider = totals.select(*keys, F.col("_range").alias("_position"), "_total")
        wider = running_start(wider, keys, "_position", F.col("_total"), "_sum", shift, levels - 1)
        totals = wider.select(*keys, F.col("_position").alias("_range"), F.col("_sum").alias("_before"))
    else:
        totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(outer), F.lit(0))).drop("_total")
    local = sized.withColumn("_inside", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    return (
        local.join(totals, [*keys, "_range"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_size", "_range", "_before", "_inside")
    )
