"""Tables in the shared folder that are given up when the next ones are written."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from alertmill.storage import new_table_path


class Scratch:
    """Writes intermediate tables and deletes those that are no longer read, so that disk follows the step at hand.

    A table may only be dropped when everything that was made from it is written itself: then a lost
    executor needs the later tables only. ``tasks`` is how many write a table at most.
    """

    def __init__(self, spark: SparkSession, tasks: int | None = None):
        self.spark = spark
        self.tasks = tasks
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_table_path(self.spark, name)
        (df.coalesce(self.tasks) if self.tasks else df).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self._paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(table))[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner see which shuffles have no reader left."""
        gc.collect()
        self.spark._jvm.System.gc()
