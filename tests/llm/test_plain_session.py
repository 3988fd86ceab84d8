"""Every operator and the pipeline in a session that no default settings prepare."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
CODE = """
import sys
from pyspark.sql import SparkSession
import corpus_pipeline
from proofmill.llm.queries import QUERIES

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name, query in {**QUERIES, "pipeline": lambda s, d: corpus_pipeline.run(s, d)}.items():
    assert query(spark, sys.argv[1]).count() > 0, name
"""


def test_plain_local_mode(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE, "/root/testdata/sf0.001"], env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
