"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime settings the operators rely on; all can be set on a live session.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with repeated keys keep the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts go to the Python workers in batches of some megabytes, which executor and worker both hold.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of the session this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="alertmill-")) / "alertmill.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators need on an existing session and ship the package to its workers."""
    ship(spark)
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "alertmill",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _REQUIRED.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
