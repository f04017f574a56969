"""Time the catalog's queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from alertmill.plans.catalog import QUERIES
from alertmill.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Run once before anything is timed: scans, a pattern list, windows and a Python stage.
WARM_UP = ["syslog_parse", "ban_filter", "near_dup_by_user", "list_state_fold"]


def main(names: list[str]) -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        int(CPUS),
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog, took = dict(QUERIES), {}
    for name in WARM_UP:
        catalog[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    for name in names or catalog:
        start = time.perf_counter()
        catalog[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main(sys.argv[1:])
