"""Side data that is read again from time to time."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertmill.operators.patterns import PatternSet, compile_patterns, require_patterns
from alertmill.storage import delete_dir, get_text, list_dir, put_text

log = logging.getLogger(__name__)

# Fixed values.
IMPORT_PERIOD_S = 180
RELOAD_PERIOD_S = 1800


class RefreshedPatterns:
    """A compiled list, loaded again when older than ``period_s``.

    A failed load keeps the last good list. ``keep_when_empty`` also keeps it
    when the new list has no patterns, as routes do.
    """

    def __init__(
        self,
        load: Callable[[SparkSession], DataFrame],
        period_s: float = IMPORT_PERIOD_S,
        keep_when_empty: bool = False,
        clock: Callable[[], float] = time.monotonic,
    ):
        self.load, self.period_s, self.keep_when_empty, self.clock = load, period_s, keep_when_empty, clock
        self._patterns: PatternSet | None = None
        self._loaded_at: float | None = None

    def current(self, spark: SparkSession) -> PatternSet:
        now = self.clock()
        if self._loaded_at is None or now - self._loaded_at >= self.period_s:
            try:
                fresh = compile_patterns(self.load(spark))
                if not (self.keep_when_empty and self._patterns is not None and fresh.is_empty()):
                    self._patterns = fresh
            except Exception:
                log.exception("list not loaded, the last good one stays")
            self._loaded_at = now
        return self._patterns if self._patterns is not None else PatternSet(spark)


class ListVersions:
    """Which lists each micro-batch was decided with, so that a batch that is tried again is decided with the same.

    A list is written once, when a batch first meets it; a batch notes the version of each of its lists before anything
    is sent. Notes and versions that no replay can ask for any more are dropped.
    """

    def __init__(self, path: str):
        self.path = path
        self._written: dict[str, tuple[PatternSet, str]] = {}  # by list: the last set and its version

    def _note(self, batch: int) -> str:
        return f"{self.path}/batches/{batch}"

    def for_batch(
        self, spark: SparkSession, batch: int, lists: dict[str, RefreshedPatterns], needed: tuple[str, ...] = ()
    ) -> dict[str, PatternSet]:
        """The lists by name; a batch that finds one of ``needed`` empty fails and is not noted."""
        noted = get_text(spark, self._note(batch))
        if noted is not None:
            return {name: self._read(spark, name, version) for name, version in json.loads(noted).items()}
        found = {name: own.current(spark) for name, own in lists.items()}
        for name in needed:
            require_patterns(found[name])
        versions = {name: self._version(name, own) for name, own in found.items()}
        put_text(spark, self._note(batch), json.dumps(versions))
        self._forget(spark)
        return found

    def _version(self, name: str, patterns: PatternSet) -> str:
        known = self._written.get(name)
        if known is None or known[0] is not patterns:
            version = uuid.uuid4().hex
            patterns.given().write.parquet(f"{self.path}/versions/{version}")
            self._written[name] = known = (patterns, version)
        return known[1]

    def _read(self, spark: SparkSession, name: str, version: str) -> PatternSet:
        known = self._written.get(name)
        if known is None or known[1] != version:
            rows = spark.read.schema("route string, pattern string").parquet(f"{self.path}/versions/{version}")
            self._written[name] = known = (compile_patterns(rows, route="route"), version)
        return known[0]

    def _forget(self, spark: SparkSession) -> None:
        keep = int(spark.conf.get("spark.sql.streaming.minBatchesToRetain"))
        batches = sorted(int(b) for b in list_dir(spark, f"{self.path}/batches") if b.isdigit())
        if len(batches) <= 2 * keep:
            return
        for old in batches[:-keep]:
            delete_dir(spark, self._note(old))
        used = {v for b in batches[-keep:] for v in json.loads(get_text(spark, self._note(b)) or "{}").values()}
        for version in list_dir(spark, f"{self.path}/versions"):
            if version not in used:
                delete_dir(spark, f"{self.path}/versions/{version}")


class RefreshedTable:
    """A reference table read again per use, at most every ``period_s``; a failed read keeps the old one."""

    def __init__(
        self,
        load: Callable[[SparkSession], DataFrame],
        period_s: float = RELOAD_PERIOD_S,
        clock: Callable[[], float] = time.monotonic,
    ):
        self.load, self.period_s, self.clock = load, period_s, clock
        self._table: DataFrame | None = None
        self._loaded_at: float | None = None

    def current(self, spark: SparkSession) -> DataFrame | None:
        now = self.clock()
        if self._loaded_at is None or now - self._loaded_at >= self.period_s:
            try:
                self._table = self.load(spark)
            except Exception:
                log.exception("table not loaded, the last good one stays")
            self._loaded_at = now
        return self._table
