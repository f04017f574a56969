import subprocess
import sys
from pathlib import Path

import pyarrow as pa

from alertmill.session import prepare

ROOT = Path(__file__).resolve().parents[1]

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
from __spark_entry__ import queries
print("ROWS", queries()["list_state_fold"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package_when_started_elsewhere(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(RUN.format(root=str(ROOT), shared=str(tmp_path / "shared")))
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
    env |= {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK", "PYSPARK", "PATH"))}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_workers_get_batches_of_bounded_size(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = prepare(spark).range(9000, numPartitions=1).mapInArrow(sizes, "n long").collect()
    assert sum(r.n for r in rows) == 9000 and max(r.n for r in rows) <= 2000
