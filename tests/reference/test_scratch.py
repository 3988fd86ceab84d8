"""Intermediate tables in a session that no default settings prepare."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
CODE = """
import sys
from pyspark.sql import SparkSession
from proofmill.queries import QUERIES
from proofmill.sources.scratch import discard, materialise, shared_dir

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
kept = materialise(spark.range(10))
assert kept.count() == 10 and shared_dir(spark) == shared_dir(spark)
discard(kept)
assert QUERIES["w2_dedup"](spark, sys.argv[1]).count() > 0
"""


def test_plain_local_mode(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE, "/root/testdata/sf0.001"], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
