"""Near-duplicate suppression over a ring of recent messages.

The ring holds the last ``samples`` messages, each for ``lifetime_s`` seconds.
What a message is compared with depends on the input alone, never on earlier
decisions, so a bounded window frame gives the ring of every message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions.distance import similar_to_any
from alertmill.operators.ordered import MAX_GROUP_ROWS, largest_group, previous_rows

# Fixed values.
SAMPLES = 20
LIFETIME_S = 300
THRESHOLD = 14
# Length of a time tile in lifetimes: one in this many rows is copied to the next tile.
TILE_LIFETIMES = 4


def _tile_us(lifetime_s: int) -> int:
    return lifetime_s * TILE_LIFETIMES * 1_000_000


def hottest_tile(df: DataFrame, ts: str = "ts", keys: list[str] | None = None, lifetime_s: int = LIFETIME_S) -> int:
    """Rows of the fullest time tile; reads the time and key columns only."""
    tile = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / _tile_us(lifetime_s)).alias("_tile")
    return largest_group(df, [*(keys or []), tile])


def with_ring(
    df: DataFrame,
    text: str = "payload",
    ts: str = "ts",
    order_id: str = "id",
    keys: list[str] | None = None,
    samples: int = SAMPLES,
    lifetime_s: int = LIFETIME_S,
    mode: str = "auto",
    profile: DataFrame | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    out: str = "ring",
) -> DataFrame:
    """Add ``ring``: texts of the live samples each message is compared with.

    ``keys`` gives one ring per key value, no keys one ring for all. Modes:
    ``tiled`` windows over time tiles that overlap by one lifetime, ``global``
    one window (a reference for tests), ``blocks`` equal blocks of the sorted
    table for bursts that overfill a tile, ``auto`` tiled unless a tile is too
    full. ``profile`` is a cheaper table to count tiles on, such as the scan
    ``df`` was filtered from.
    """
    keys = keys or []
    if mode == "auto":
        full = hottest_tile(df if profile is None else profile, ts, keys, lifetime_s)
        mode = "tiled" if full <= max_group_rows else "blocks"
    timed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    entry = F.struct(F.col("_us").alias("us"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["_us", order_id]

    if mode == "tiled":
        length = _tile_us(lifetime_s)
        tile = F.floor(F.col("_us") / length)
        # Only rows still alive when the next tile starts can be compared there.
        reaches_next = F.pmod("_us", F.lit(length)) >= length - lifetime_s * 1_000_000
        copies = F.when(reaches_next, F.array(tile, tile + 1)).otherwise(F.array(tile))
        spread = timed.withColumn("_tile", F.explode(copies))
        ringed = previous_rows(spread, order, samples, entry, "_prev", [*keys, "_tile"], mode="window")
        ringed = ringed.where(F.col("_tile").eqNullSafe(tile)).drop("_tile")
    elif mode == "global":
        ringed = previous_rows(timed, order, samples, entry, "_prev", keys, mode="window")
    elif mode == "blocks":
        ringed = previous_rows(timed, order, samples, entry, "_prev", keys, mode="blocks")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return ringed.withColumn(out, live_texts(F.col("_prev"), F.col("_us"), lifetime_s)).drop("_prev", "_us")


def live_texts(samples: Column, now_us: Column, lifetime_s: int = LIFETIME_S) -> Column:
    """Texts of ``array<struct<us, text>>`` samples that are neither expired nor empty."""
    live = F.filter(
        samples, lambda s: (now_us - s.getField("us") <= lifetime_s * 1_000_000) & (s.getField("text") != "")
    )
    return F.transform(live, lambda s: s.getField("text"))


def min_distance(ring: Column | str, text: Column | str) -> Column:
    """Smallest edit distance to the ring, -1 when the ring is empty.

    Samples are tried from the newest; each only has to beat the best so far,
    and a distance beyond that bound is not worked out in full.
    """
    ring = F.col(ring) if isinstance(ring, str) else ring
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def closer(best: Column, sample: Column) -> Column:
        bounded = F.call_function("levenshtein", sample, text, best - 1)
        closest = F.array_min(F.filter(F.array(bounded, best), lambda v: v >= 0))
        return F.when(best < 0, F.levenshtein(sample, text)).when(best == 0, best).otherwise(closest)

    return F.aggregate(F.reverse(ring), F.lit(-1), closer)


def is_new(ring: Column | str, text: Column | str, threshold: int = THRESHOLD, on_empty: str = "suppress") -> Column:
    """True when the message differs enough from every sample.

    With nothing to compare the message is suppressed; ``on_empty='send'``
    sends it instead.
    """
    ring = F.col(ring) if isinstance(ring, str) else ring
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    similar = similar_to_any(text, ring, threshold - 1)
    if on_empty == "suppress":
        return (F.size(ring) > 0) & ~similar
    if on_empty == "send":
        return ~similar
    raise ValueError(f"unknown on_empty {on_empty!r}")


def suppress_near_duplicates(
    df: DataFrame, text: str = "payload", threshold: int = THRESHOLD, on_empty: str = "suppress", **ring_options
) -> DataFrame:
    """Keep the messages worth sending."""
    ringed = with_ring(df, text=text, **ring_options)
    return ringed.where(is_new("ring", text, threshold, on_empty)).drop("ring")
