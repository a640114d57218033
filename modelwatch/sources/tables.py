"""Readers for the driver's parquet tables and generic table I/O.

Reads never infer schemas from text: CSV inputs take an explicit ``StructType``.
Writes go to a caller-named folder (on a cluster: a shared filesystem path).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Column pruning and filters reach the parquet scan via Catalyst."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    # events.ts is TIMESTAMP_NTZ in the files; watermarks need TIMESTAMP.
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    fmt: str = "parquet") -> DataFrame | None:
    """A table, or None when nothing is at the path (or it holds no data file). Every other failure is raised."""
    reader = spark.read.format(fmt).option("header", True) if fmt == "csv" else spark.read.format(fmt)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


#: Columns of a retraining table beside the training ones (:mod:`modelwatch.operators.retraining`): where a production row comes
#: from, when it was labelled, and the run that added it.
REQUEST_ID, LABELED_AT, PART = "_request_id", "_labeled_at", "part"


def _latest_rows(table: DataFrame) -> DataFrame:
    """Base rows as they are, and of every production row its latest label (ties: the later part)."""
    columns = [c for c in table.columns if c not in (REQUEST_ID, LABELED_AT, PART)]
    base = table.where(F.col(REQUEST_ID).isNull()).select(*columns)
    rows = table.where(F.col(REQUEST_ID).isNotNull()).groupBy(REQUEST_ID).agg(
        F.max_by(F.struct(*columns), F.struct(LABELED_AT, PART)).alias("row"))
    return base.unionByName(rows.select("row.*"))


def read_training_table(spark: SparkSession, raw_path: str, retraining_path: str | None = None,
                        schema: T.StructType | None = None, fmt: str = "parquet") -> tuple[DataFrame, str]:
    """A1: the retraining table when there is one, else the raw table; fail when absent.

    A retraining table's corrected labels count once, by their latest. Returns ``(df, path_used)``. CSV needs an explicit schema (no inference).
    """
    if fmt == "csv" and schema is None:
        raise ValueError("CSV sources need an explicit schema")
    for path in [p for p in (retraining_path, raw_path) if p]:
        df = read_if_present(spark, path, schema, fmt)
        if df is not None:
            return (_latest_rows(df) if {REQUEST_ID, LABELED_AT, PART} <= set(df.columns) else df), path
    raise FileNotFoundError(f"no training data at {retraining_path!r} or {raw_path!r}")


def write_snapshot(df: DataFrame, root: str, partition_value: str, key: str = "model_version",
                   mode: str = "overwrite") -> str:
    """Write a table under ``root/key=value`` (a rerun replaces it)."""
    path = f"{root.rstrip('/')}/{key}={partition_value}"
    df.write.mode(mode).parquet(path)
    return path


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a table; a missing table is an empty DataFrame with the schema."""
    df = read_if_present(spark, path, schema)
    return spark.createDataFrame([], schema) if df is None else df


def reference_and_production(spark: SparkSession, reference_path: str, events: DataFrame | None,
                             legacy_path: str | None = None, fmt: str = "parquet") -> tuple[DataFrame | None,
                                                                                         DataFrame | None, str]:
    """A4: the (reference, production) pair for monitoring, and a status.

    Production is the event table; only when it is empty does the legacy prediction
    log stand in. Status is ``ok``, or ``unknown`` when either side is missing or empty
    (callers report unknown instead of guessing). Emptiness is a one-row probe.
    """
    def load(path: str | None) -> DataFrame | None:
        return read_if_present(spark, path, fmt=fmt) if path else None

    reference = load(reference_path)
    if reference is None or reference.isEmpty():
        return None, None, "unknown"
    production = events
    if production is None or production.isEmpty():
        production = load(legacy_path)
    if production is None or production.isEmpty():
        return reference, None, "unknown"
    return reference, production, "ok"
