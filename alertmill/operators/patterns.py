"""Ban, notify and route by lists of regular expressions.

A list of ordinary size is compiled into the expression as literals, so the
JVM compiles every pattern once per task and no join is planned. A larger list
is looked up by grams: each pattern gives grams one of which every match holds
and that few other patterns have, texts are joined with the patterns of the
grams they hold, and only those are tested. Patterns without such a gram are cut into parts of a fixed size, each
joined as a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions.literals import (
    BLOCK_BITS,
    SKETCH_BITS,
    SKETCH_BLOCK,
    WIDTHS,
    Wanted,
    bitmap_size,
    chosen_grams,
    gram_slots,
    grams_of,
    required_literals,
    sketch_blocks,
)
from alertmill.functions.regex import CATEGORIES, BadPattern, property_names, to_java
from alertmill.storage import materialize

# Patterns and bytes of patterns that go into the plan as literals.
MAX_LITERALS = 1000
MAX_LITERAL_BYTES = 256 * 1024
# A broadcast part holds this many patterns of at most this many characters, or
# one longer pattern.
PART_ROWS = 5000
LONG_PATTERN = 4096


def _rewrite(pattern: str | None) -> tuple[str | None, str | None]:
    if pattern is None:
        return None, "null pattern"
    try:
        return to_java(pattern), None
    except BadPattern as exc:
        return None, str(exc)


@dataclass
class PatternSet:
    """Distinct (route, pattern) pairs ready for matching."""

    spark: SparkSession
    literals: list[tuple[str | None, str, str]] = field(default_factory=list)  # route, pattern, java
    rejects: list[tuple[str | None, str | None, str]] = field(default_factory=list)
    table: DataFrame | None = None  # route, pattern, java, reason, grams of a list that is no literal
    parts: DataFrame | None = None  # route, pattern, java, part: those without a gram
    n_parts: int = 0
    wanted: Wanted | None = None  # the grams of the others

    def is_empty(self) -> bool:
        return not self.literals and not self.n_parts and self.wanted is None

    def rejects_frame(self) -> DataFrame:
        if self.table is not None:
            return self.table.where("java is null").select("route", "pattern", "reason")
        return self.spark.createDataFrame(self.rejects, "route string, pattern string, reason string")

    def given(self) -> DataFrame:
        """(route, pattern) of all patterns, refused ones included: what the set can be compiled from again."""
        if self.table is not None:
            return self.table.select("route", "pattern")
        rows = [(route, pattern) for route, pattern, _ in (*self.literals, *self.rejects)]
        return self.spark.createDataFrame(rows, "route string, pattern string")

    def part(self, i: int) -> DataFrame:
        # Bounded: PART_ROWS patterns of at most LONG_PATTERN characters, or one pattern.
        return F.broadcast(self.parts.where(F.col("part") == i).select("route", "pattern", "java"))

    def by_gram(self) -> DataFrame:
        """The patterns that have grams, once for each of them."""
        rows = self.table.where("java IS NOT NULL AND grams IS NOT NULL")
        return rows.select("route", "pattern", F.col("java").alias("_java"), F.col("grams").alias("_needs"), F.explode("grams").alias("_gram"))


def _jvm_refuses(spark: SparkSession, java: str) -> str | None:
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
        return None
    except Exception as exc:  # the JVM names the fault in the message
        return str(exc).splitlines()[0]


def literal_patterns(spark: SparkSession, pairs: list[tuple[str | None, str | None]]) -> PatternSet:
    """A set from (route, pattern) pairs at hand; of a pattern given twice the last route stays."""
    result = PatternSet(spark)
    routes = {pattern: route for route, pattern in pairs}
    for pattern in sorted(routes, key=lambda p: (p is None, p or "")):
        java, reason = _rewrite(pattern)
        reason = reason or _jvm_refuses(spark, java)
        if reason:
            result.rejects.append((routes[pattern], pattern, reason))
        else:
            result.literals.append((routes[pattern], pattern, java))
    return result


def compile_patterns(
    patterns: DataFrame,
    pattern: str = "pattern",
    route: str | None = None,
    max_literals: int = MAX_LITERALS,
    part_rows: int = PART_ROWS,
    order: str | None = None,
) -> PatternSet:
    """Rewrite and check the patterns of a list; bad ones are set aside and match nothing.

    A pattern registered twice keeps one route: the last by the column ``order``, or the greatest by name without one.
    """
    spark = patterns.sparkSession
    named = patterns.select(
        (F.col(route) if route else F.lit(None).cast("string")).alias("route"),
        F.col(pattern).alias("pattern"),
        (F.col(order) if order else F.lit(0)).alias("_order"),
    )
    last = F.max(F.struct("_order", "route")).getField("route")
    named = named.groupBy("pattern").agg(last.alias("route")).select("route", "pattern")
    head = named.limit(max_literals + 1).collect()
    small = len(head) <= max_literals and sum(len((r.pattern or "").encode()) for r in head) <= MAX_LITERAL_BYTES
    if small:
        return literal_patterns(spark, [(r.route, r.pattern) for r in head])

    scripts = {str(script) for script in spark._jvm.java.lang.Character.UnicodeScript.values()}

    def checked(pattern: str | None) -> tuple[str | None, str | None]:
        java, reason = _rewrite(pattern)
        unknown = [n for n in property_names(java or "") if n not in CATEGORIES and n.removeprefix("Is").upper() not in scripts]
        return (None, f"unknown character property {unknown[0]}") if unknown else (java, reason)

    def rewrite_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [checked(p) for p in pdf["pattern"]]
            held = [None if d[0] is None else required_literals(d[0]) for d in done]
            yield pdf.assign(java=[d[0] for d in done], reason=[d[1] for d in done], literals=[None if x is None else sorted(x) for x in held])

    # Reading patterns is the slow part: all cores share it, however few bytes they have.
    named = named.repartition(spark.sparkContext.defaultParallelism, "pattern")
    done = named.mapInPandas(rewrite_batches, "route string, pattern string, java string, reason string, literals array<binary>")
    table = _with_grams(materialize(done, "literals"))
    table = materialize(table.withColumn("position", F.monotonically_increasing_id()), "patterns")
    result = PatternSet(spark, table=table.drop("position"))
    result.wanted = _wanted(result.by_gram().select("_gram"))
    table = table.where("java IS NOT NULL AND grams IS NULL")
    # Rows of a written partition are consecutive: cut each into parts of part_rows,
    # a long pattern by itself.
    offset = F.col("position").bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.when(F.length("pattern") > LONG_PATTERN, -1 - offset).otherwise(F.floor(offset / part_rows))
    table = table.withColumn("p", F.shiftright("position", 33)).withColumn("c", chunk)
    pieces = table.select("p", "c").distinct()
    numbered = {(r.p, r.c): i for i, r in enumerate(pieces.orderBy("p", "c").collect())}
    index = spark.createDataFrame([(p, c, i) for (p, c), i in numbered.items()], "p bigint, c bigint, part int")
    parts = table.join(index, ["p", "c"]).drop("p", "c", "position", "grams")
    result.parts, result.n_parts = materialize(parts, "pattern-parts"), len(numbered)
    return result


def _with_grams(table: DataFrame) -> DataFrame:
    """The patterns with ``grams`` for their ``literals``; how often the list has a gram is counted in a sketch of fixed size."""
    spark = table.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, counts in sketch_blocks(pdf["literals"].tolist() for pdf in batches):
            yield pd.DataFrame({"block": [block], "counts": [counts.tobytes()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in parts["counts"])
        return pd.DataFrame({"block": parts["block"].iloc[:1], "counts": [total.tobytes()]})

    schema = "block int, counts binary"
    held = table.where("literals IS NOT NULL").select("literals")
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for row in held.mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema).collect():
        counts[row["block"] * SKETCH_BLOCK :][:SKETCH_BLOCK] = np.frombuffer(row["counts"], dtype=np.int64)
    sent = spark.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            none = pdf["literals"].isna().tolist()
            grams = chosen_grams([[] if no else list(x) for no, x in zip(none, pdf["literals"], strict=True)], sent.value)
            yield pdf.drop(columns="literals").assign(grams=[None if no else g for no, g in zip(none, grams, strict=True)])

    return table.mapInPandas(choose, "route string, pattern string, java string, reason string, grams array<bigint>")


def _wanted(grams: DataFrame) -> Wanted | None:
    """The grams as a bitmap, put together in blocks. Its greatest size bounds what comes back, whatever the length of the list."""
    found = grams.groupBy(F.col("_gram").bitwiseAND(F.lit(3)).alias("width")).count().collect()
    if not found:
        return None
    size = bitmap_size(sum(r["count"] for r in found))
    slots = grams.select(F.explode(gram_slots(F.col("_gram"), size)).alias("slot")).select((F.col("slot") + 1).alias("slot"))  # counted from 1
    blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(1 << (size - 3), dtype=np.uint8)
    for row in blocks.collect():
        begin = (row["block"] - 1) << (BLOCK_BITS - 3)
        bits[begin : begin + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Wanted(bits, tuple(WIDTHS[r["width"]] for r in sorted(found)))


def _any(flags: list[Column]) -> Column:
    """Balanced OR, so that long lists do not nest deeply."""
    while len(flags) > 1:
        flags = [reduce(or_, flags[i : i + 2]) for i in range(0, len(flags), 2)]
    return flags[0]


def matches_any(text: Column | str, patterns: PatternSet) -> Column:
    """True when any literal pattern matches; patterns in parts need :func:`flag_matches`."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if not patterns.literals:
        return F.lit(False)
    # A lambda keeps long lists out of the generated method, which has a size limit.
    return F.exists(F.array(col), lambda t: _any([t.rlike(java) for _, _, java in patterns.literals]))


def _hit(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.col("_java")), F.lit(False))


def _flag_by_gram(df: DataFrame, text: str, patterns: PatternSet, out: str) -> DataFrame:
    """``df`` with ``out``: does a pattern match that has grams. Rows are read once and put together again by a number."""
    rows = df.select(F.struct(*df.columns).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
    body = F.coalesce(F.col("_row").getField(text), F.lit(""))
    rows = rows.withColumn("_grams", grams_of(patterns.spark, body, patterns.wanted))
    opened = rows.select("_row", "_rid", F.explode_outer("_grams").alias("_gram"))
    # rows without a gram are dealt out by their number; what they may meet by chance is tested like the rest
    opened = opened.withColumn("_gram", F.coalesce("_gram", F.xxhash64("_rid")))
    tried = opened.join(patterns.by_gram().select("_gram", "_java"), "_gram", "left")
    flagged = tried.groupBy("_rid").agg(F.first("_row").alias("_row"), F.max(_hit(body)).alias("_hit"))
    return flagged.select("_row.*", F.col("_hit").alias(out))


def flag_matches(df: DataFrame, text: str, patterns: PatternSet, out: str = "matched") -> DataFrame:
    """Add ``out``: does any pattern match."""
    if patterns.table is None:
        return df.withColumn(out, matches_any(text, patterns))
    df = df.drop(out)
    df = _flag_by_gram(df, text, patterns, out) if patterns.wanted is not None else df.withColumn(out, F.lit(False))
    if not patterns.n_parts:
        return df
    flagged = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    tried = [patterns.part(i).where(F.rlike(F.col("_text").outer(), F.col("java"))).exists() for i in range(patterns.n_parts)]
    return flagged.withColumn("_more", _any(tried)).withColumn(out, F.col(out) | F.col("_more")).drop("_text", "_more")


def drop_matching(df: DataFrame, text: str, patterns: PatternSet) -> DataFrame:
    """Left anti: keep the rows no pattern matches."""
    if patterns.table is None:
        return df.where(~matches_any(text, patterns)) if patterns.literals else df
    if patterns.wanted is not None:
        df = _flag_by_gram(df, text, patterns, "_matched").where("NOT _matched").drop("_matched")
    for i in range(patterns.n_parts):
        df = df.join(patterns.part(i), F.rlike(F.coalesce(df[text], F.lit("")), F.col("java")), "left_anti")
    return df


def keep_matching(df: DataFrame, text: str, patterns: PatternSet) -> DataFrame:
    """Left semi: keep the rows some pattern matches."""
    if patterns.table is None:
        return df.where(matches_any(text, patterns))
    return flag_matches(df, text, patterns, "_matched").where("_matched").drop("_matched")


def _routes_by_gram(df: DataFrame, text: str, patterns: PatternSet) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn("_grams", grams_of(patterns.spark, body, patterns.wanted))
    tried = rows.withColumn("_gram", F.explode("_grams")).join(patterns.by_gram(), "_gram")
    # a pattern that shares several grams with a text is tested for the least of them
    once = F.col("_gram") == F.array_min(F.array_intersect("_grams", "_needs"))
    return tried.where(once & _hit(body)).select(*df.columns, "route", "pattern")


def route_matches(df: DataFrame, text: str, patterns: PatternSet) -> DataFrame:
    """Inner fan-out: one row per matching pattern with ``route`` and ``pattern``."""
    if patterns.table is not None:
        joined = [
            df.join(patterns.part(i), F.rlike(F.coalesce(df[text], F.lit("")), F.col("java"))).drop("java")
            for i in range(patterns.n_parts)
        ]
        if patterns.wanted is not None:
            joined.append(_routes_by_gram(df, text, patterns))
        if joined:
            return reduce(DataFrame.unionByName, joined)
    if not patterns.literals:
        empty = F.lit(None).cast("string")
        return df.withColumn("route", empty).withColumn("pattern", empty).where(F.lit(False))

    def hits(t: Column) -> Column:
        found = [
            F.when(t.rlike(java), F.struct(F.lit(route).cast("string").alias("route"), F.lit(pattern).alias("pattern")))
            for route, pattern, java in patterns.literals
        ]
        return F.array_compact(F.array(*found))

    body = F.coalesce(F.col(text), F.lit(""))
    matched = F.flatten(F.transform(F.array(body), hits))
    return df.select("*", F.inline(matched))


def route_to_handlers(
    df: DataFrame, text: str, patterns: PatternSet, handlers: dict[str, Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Apply a DataFrame function per route and unite the results; routes without one are dropped."""
    routed = route_matches(df, text, patterns)
    results = [handler(routed.where(F.col("route") == name)) for name, handler in handlers.items()]
    if not results:
        raise ValueError("no handlers")
    return reduce(DataFrame.unionByName, results)


def require_patterns(patterns: PatternSet) -> PatternSet:
    """The gate before routing: a notify list must not be empty."""
    if patterns.is_empty():
        raise ValueError("the notify list is empty")
    return patterns
