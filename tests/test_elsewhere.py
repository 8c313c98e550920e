"""The contract from another working directory: Python workers must not need this folder on their path."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
assert e.entry(spark).count() > 0
for name in ("camera_tracker", "face_match", "blob_ingest", "motion_gate_stream"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("all ran")
"""


def test_queries_run_from_another_directory(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-3000:]
