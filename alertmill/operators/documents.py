"""Results as text documents: JSON lists, line replies, list renderings.

A document is written as pages of bounded size. A result that fits one page is
the whole document; a larger one is the pages in order, none of them larger
than ``page_bytes`` by more than its last entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from alertmill.functions.text import ZERO_TIME
from alertmill.operators.ordered import running_start
from alertmill.storage import materialize

PAGE_BYTES = 4 * 1024 * 1024
TASK_PAGES = 4  # pages that a task writes, about


def pages(
    df: DataFrame,
    keys: list[str],
    position: str,
    entry: Column,
    separator: str = "\n",
    opening: str = "",
    closing: str = "",
    page_bytes: int = PAGE_BYTES,
    most_bytes: int | None = None,
) -> DataFrame:
    """``keys, page, body``: entries of a key in ``position`` order, joined page by page.

    ``most_bytes`` is what no document can exceed, separators included, if that is known: documents that fit one page
    need no running sizes.
    """
    entries = df.select(*keys, F.col(position).cast("bigint").alias("_at"), entry.alias("_entry"))
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_entry"))), lambda e: e.getField("_entry")), separator
    ).alias("_body")
    if most_bytes is not None and most_bytes < page_bytes:
        joined = entries.groupBy(*keys).agg(body).withColumn("page", F.lit(0).cast("bigint"))
    else:
        size = F.octet_length("_entry") + len(separator.encode())
        placed = running_start(entries, keys, "_at", size, "_start")
        joined = placed.withColumn("page", F.expr(f"_start div {page_bytes}")).groupBy(*keys, "page").agg(body)
    return joined.select(*keys, "page", F.concat(F.lit(opening), "_body", F.lit(closing)).alias("body"))


def reply_texts(df: DataFrame, keys: list[str], position: str, line: Column, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``keys, n_lines, page, text``: all lines of a reply, joined by newlines page by page.

    Nothing is cut here; an alert made from a reply cuts itself.
    """
    texts = pages(df, keys, position, line, "\n", page_bytes=page_bytes).withColumnRenamed("body", "text")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.join(texts, keys)


def _page_of(index: DataFrame, key: str) -> Column:
    """The page of a row by its key and place, from the first place of each page but 0: one row for ``page_bytes`` of text."""
    firsts: dict = {}
    for row in index.where("page > 0").orderBy("page").collect():
        at, page = firsts.setdefault(row[key], ([], []))
        at.append(row["_first"])
        page.append(row["page"])
    if not firsts:
        return F.lit(0).cast("bigint")
    sent = index.sparkSession.sparkContext.broadcast({k: (np.array(at), np.array([0, *page])) for k, (at, page) in firsts.items()})

    def look(keys: pd.Series, places: pd.Series) -> pd.Series:
        places, out = places.to_numpy(), np.zeros(len(places), dtype=np.int64)
        codes, names = pd.factorize(keys)
        for code, name in enumerate(names):
            if name in sent.value:
                at, page = sent.value[name]
                rows = np.flatnonzero(codes == code)
                out[rows] = page[np.searchsorted(at, places[rows], side="right")]
        return pd.Series(out)

    return F.pandas_udf(look, "bigint")(F.col(key), F.col("_at"))


def replies(df: DataFrame, asks: DataFrame, key: str, position: str, line: Column, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``asks`` with ``n_lines, page, text``: all lines of ``df`` that have its ``key``, page by page as :func:`reply_texts` gives them.

    An ask without lines is one row without text. ``df`` is a table at rest, as it is read several times. Lines are
    shuffled once, straight to their page, where the asks meet them; a task holds one page at a time and writes
    about ``TASK_PAGES``, so no key has its whole reply in one task.
    """
    entries = df.select(key, F.col(position).cast("bigint").alias("_at"), line.alias("_entry")).where(F.col(key).isNotNull() & F.col("_at").isNotNull())
    sizes = entries.select(key, "_at", (F.octet_length("_entry") + 1).alias("_bytes"))
    placed = running_start(sizes, [key], "_at", F.col("_bytes"), "_start", levels=3)
    index = placed.withColumn("page", F.expr(f"_start div {page_bytes}")).groupBy(key, "page").agg(F.min("_at").alias("_first"))
    index = materialize(index, "pages")
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))
    heads = asks.join(index.select(key, "page").join(counts, key), key, "left")
    heads = heads.withColumns({"n_lines": F.coalesce("n_lines", F.lit(0).cast("bigint")), "page": F.coalesce("page", F.lit(0).cast("bigint"))})
    given = heads.columns
    lines = entries.withColumns({"page": _page_of(index, key), "_is_line": F.lit(True)})
    rows = heads.withColumn("_is_line", F.lit(False)).unionByName(lines, allowMissingColumns=True)
    tasks = max(1, math.ceil(index.count() / TASK_PAGES))
    rows = rows.repartition(tasks, key, "page").sortWithinPartitions(key, "page", "_is_line", "_at", "_entry")

    def written(asked: pa.RecordBatch, texts: list[str] | None) -> Iterator[pa.RecordBatch]:
        text = None if texts is None else "\n".join(texts)
        for i in range(asked.num_rows):
            row = asked.slice(i, 1)
            if text is not None or not row.column("n_lines")[0].as_py():
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.string())], names=[*given, "text"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # asks come before the lines of their page
        place, asked, texts = None, [], None
        for batch in batches:
            keys, pages_, is_line = batch.column(key), batch.column("page"), batch.column("_is_line")
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            numbers, kinds = pages_.to_numpy(zero_copy_only=False), is_line.to_numpy(zero_copy_only=False)
            new = (codes[1:] != codes[:-1]) | (numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])
            for first, stop in _runs(new, batch.num_rows):
                here = (keys[first].as_py(), int(numbers[first]))
                if here != place:
                    for some in asked:
                        yield from written(some, texts)
                    place, asked, texts = here, [], None
                if not kinds[first]:
                    asked.append(batch.slice(first, stop - first).select(given))
                elif asked:
                    texts = [] if texts is None else texts
                    texts.extend(_joined(batch.column("_entry").slice(first, stop - first)))
        for some in asked:
            yield from written(some, texts)

    return rows.mapInArrow(write, StructType([*heads.schema.fields, *StructType().add("text", StringType()).fields]))


def _runs(new: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(first, after the last) of the runs of ``n`` rows; ``new`` says of all rows but the first if they begin one."""
    if n:
        first = np.r_[0, np.flatnonzero(new) + 1]
        yield from zip(first.tolist(), [*first[1:].tolist(), n], strict=True)


def _joined(entries: pa.Array) -> list[str]:
    """The entries as one line text, or nothing when all are null."""
    entries = entries.drop_null().to_pylist()
    return ["\n".join(entries)] if entries else []


def rfc3339(ts: Column) -> Column:
    """UTC time with a fraction only when there is one; null is the zero time."""
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.rtrim(micros, F.lit("0"))
    text = F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.length(fraction) > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
        F.lit("Z"),
    )
    return F.coalesce(text, F.lit(ZERO_TIME))


def go_time(ts: Column) -> Column:
    """Time as the list reply prints it: ``2024-01-01 00:00:00 +0000 UTC``."""
    text = rfc3339(ts)
    return F.concat(F.replace(F.rtrim(text, F.lit("Z")), F.lit("T"), F.lit(" ")), F.lit(" +0000 UTC"))


def list_json(items: DataFrame, names: DataFrame | None = None, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``list_name, page, body`` with body ``{"id":{"pattern":..,"expired_at":..},..}``.

    Expired items that were not swept are included. ``names`` adds ``{}`` for
    lists without items.
    """
    item = F.to_json(F.struct(F.col("pattern"), rfc3339(F.col("expired_at")).alias("expired_at")))
    entry = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('":'), item)
    out = pages(items, ["list_name"], "id", entry, ",", "{", "}", page_bytes)
    return _with_empty(out, "list_name", names, "{}")


def device_json(matches: DataFrame, key: str, position: str = "id", names: DataFrame | None = None, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``key, page, body`` with body ``[{"name":..,"ip":..},..]`` in inventory order."""
    entry = F.to_json(F.struct("name", "ip"), {"ignoreNullFields": "false"})
    out = pages(matches, [key], position, entry, ",", "[", "]", page_bytes)
    return _with_empty(out, key, names, "[]")


def list_text(items: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``list_name, page, body``: a line ``id:pattern:expiry`` per item, by id."""
    return pages(items, ["list_name"], "id", list_line(), "", "", "", page_bytes)


def list_line() -> Column:
    return F.concat(
        F.col("id").cast("string"), F.lit(":"), F.col("pattern"), F.lit(":"), go_time(F.col("expired_at")), F.lit("\n")
    )


def _with_empty(out: DataFrame, key: str, names: DataFrame | None, body: str) -> DataFrame:
    if names is None:
        return out
    filled = names.select(key).distinct().join(out, key, "left")
    return filled.select(key, F.coalesce("page", F.lit(0).cast("bigint")).alias("page"), F.coalesce("body", F.lit(body)).alias("body"))
