"""Posting lists of an inventory as a table that is searched and kept up.

The table is sorted by attribute and value, so a search reads the row groups of its pairs only. Changes are written as
deltas beside the base, and a merge makes one base of them. What belongs to the table stands in one small
file that is replaced as a whole, so readers see a state from before or after a change.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.operators.inventory import ALL, POSTING_SPAN_BITS, attribute_index
from alertmill.storage import delete_dir, get_text, put_text

ROW = "attr string, value string, span bigint, ids array<bigint>, gone boolean"


class PostingTable:
    def __init__(self, spark: SparkSession, path: str, span_bits: int = POSTING_SPAN_BITS):
        self.spark, self.path, self.span_bits = spark, path, span_bits

    def _state(self) -> list[str]:
        """Folders of the table: the base, then the deltas in order."""
        return json.loads(get_text(self.spark, f"{self.path}/state.json") or "[]")

    def _write(self, rows: DataFrame, name: str) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        by = ["attr", "value", "span"]
        rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, folders: list[str]) -> None:
        put_text(self.spark, f"{self.path}/state.json", json.dumps(folders))

    def _rows(self, devices: DataFrame, gone: bool) -> DataFrame:
        found = attribute_index(devices, span_bits=self.span_bits)
        return found.select("attr", "value", F.col("span").cast("bigint").alias("span"), F.col("ids").cast("array<bigint>").alias("ids"), F.lit(gone).alias("gone"))

    def build(self, devices: DataFrame) -> None:
        """Start anew from devices (id, attributes)."""
        before = self._state()
        self._commit([self._write(self._rows(devices, False), "base")])
        self._delete(before)

    def change(self, old: DataFrame | None = None, new: DataFrame | None = None) -> None:
        """Take ``old`` devices out and put ``new`` ones in; a device in both is one whose attributes change.

        Both have id and attributes, those of ``old`` as they are in the table.
        """
        parts = [self._rows(d, gone) for d, gone in ((old, True), (new, False)) if d is not None]
        if parts:
            self._commit([*self._state(), self._write(reduce(DataFrame.unionByName, parts), "delta")])

    def merge(self) -> None:
        """One base of the base and all deltas; a reader that has listed the old files finds them until the next merge."""
        folders = self._state()
        whole = self.postings().where("size(ids) > 0").select("attr", "value", "span", "ids", F.lit(False).alias("gone"))
        retired = json.loads(get_text(self.spark, f"{self.path}/retired.json") or "[]")
        self._commit([self._write(whole, "base")])
        put_text(self.spark, f"{self.path}/retired.json", json.dumps(folders))
        self._delete(retired)

    def _delete(self, folders: list[str]) -> None:
        for folder in folders:
            delete_dir(self.spark, f"{self.path}/{folder}")

    def postings(self, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
        """``attr, value, span, ids`` as they are now, of some pairs or all."""
        folders = self._state()
        read = lambda f: self.spark.read.schema(ROW).parquet(f"{self.path}/{f}")
        tables = [read(f).withColumn("turn", F.lit(k)) for k, f in enumerate(folders)]
        if not tables:
            return self.spark.createDataFrame([], ROW).drop("gone")
        if pairs is not None:
            wanted = reduce(or_, [(F.col("attr") == a) & (F.col("value") == v) for a, v in pairs], F.lit(False))
            tables = [t.where(wanted) for t in tables]
        if len(tables) == 1:
            return tables[0].select("attr", "value", "span", "ids")
        rows = reduce(DataFrame.unionByName, tables)
        # what was done to an id last counts; in one change what is put in comes after what is taken out
        ids = rows.select("attr", "value", "span", F.explode("ids").alias("id"), "turn", "gone")
        last = ids.groupBy("attr", "value", "span", "id").agg(F.max_by("gone", F.struct("turn", ~F.col("gone"))).alias("gone"))
        return last.groupBy("attr", "value", "span").agg(F.sort_array(F.collect_list(F.when(~F.col("gone"), F.col("id")))).alias("ids"))

    def search(self, query: dict[str, str]) -> DataFrame:
        """``id`` of the devices that have every pair of the query; ``{}`` finds nothing.

        Lists meet range by range of ids, so no row holds more than the ids of one range.
        """
        pairs = sorted({(k, v) for k, v in query.items() if (k, v) != (ALL, ALL)}) or ([(ALL, ALL)] if query else [])
        found = self.postings(pairs).groupBy("span").agg(F.collect_list("ids").alias("lists"))
        both = F.aggregate("lists", F.element_at("lists", 1), lambda acc, ids: F.array_intersect(acc, ids))
        return found.where(F.size("lists") == len(pairs)).select(F.explode(both).alias("id"))
