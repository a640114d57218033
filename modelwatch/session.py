"""Session helpers: build a local session for tests / bench, resolve shared folders."""

from __future__ import annotations

import os
import re
import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "modelwatch") -> SparkSession:
    """Local session with the settings the tests and bench use.

    On a cluster the session comes from the launcher; nothing here is required there.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MODELWATCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Generated code for wide per-row expressions (binning every feature of a row in
        # place) can exceed HotSpot's 8 KB JIT limit and would then run interpreted.
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """The folder of this process for sessions that name none (Spark refuses to set it on a running session)."""
    return tempfile.mkdtemp(prefix="modelwatch-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster must name it in ``spark.checkpoint.dir``: a folder of the driver's own disk would hold only
    part of what executors write, so only a ``local`` master gets one of our own (one per process).
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", context.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {context.master})")
        current = _own_folder()
    context.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
