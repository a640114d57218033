"""Queries on a session that names no checkpoint folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
import __spark_entry__ as entry
from modelwatch.session import ensure_checkpoint_dir
assert entry.entry(spark).count() > 0
folder = ensure_checkpoint_dir(spark)
assert folder == ensure_checkpoint_dir(spark.newSession()) and folder
"""


def test_plain_session_without_defaults(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") and not k.startswith("PYSPARK_")}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
