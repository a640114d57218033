"""A8 + H1: the retraining table, extended by what was labelled since the last run.

Layout: ``part=base`` holds the base rows, written once; every run adds ``part=<run>`` with the production rows labelled since
the table's high-water mark. Rows of production carry their request id and label time, so a label that is corrected
later comes in as a further row and the latest one counts (:func:`modelwatch.sources.tables.read_training_table`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators.events import latest_labels
from modelwatch.sources.tables import LABELED_AT, PART, REQUEST_ID, read_if_present, write_snapshot

BASE = "base"


def extend(spark: SparkSession, path: str, base: DataFrame, events: DataFrame, labels: DataFrame, target: str, run: str,
           lateness: str = "0 seconds", key: str = "request_id") -> DataFrame:
    """Add the rows labelled since the mark and return them (with their request id and label time).

    The mark is the latest label time of earlier runs; ``lateness`` says how far behind it a label may still come in. Labels
    that are stored already are not added again. Only columns of ``base`` are kept, in its order; those that production lacks are
    NULL, and ``target`` is the label. A replayed run replaces its own part. Without labelled rows the table is the base.
    """
    known = read_if_present(spark, path)
    if known is None or known.where(F.col(PART) == BASE).isEmpty():
        write_snapshot(base.select("*", F.lit(None).cast("string").alias(REQUEST_ID), F.lit(None).cast("timestamp").alias(LABELED_AT)),
                       path, BASE, key=PART)
    new = latest_labels(labels, key)
    if known is not None:
        earlier = known.where(~F.col(PART).isin(BASE, run)).select(F.col(REQUEST_ID).alias(key), F.col(LABELED_AT).alias("labeled_at"))
        mark = earlier.agg(F.max("labeled_at")).first()[0]
        if mark is not None:
            since = F.lit(mark) - F.expr(f"INTERVAL {lateness}")
            new = new.where(F.col("labeled_at") >= since).join(earlier.where(F.col("labeled_at") >= since), [key, "labeled_at"], "left_anti")
    rows = events.drop(target, "label", "labeled_at").join(new, key)
    have = {c.lower() for c in rows.columns}
    values = [F.col("label").cast(f.dataType).alias(f.name) if f.name == target
              else F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name)
              for f in base.schema.fields]
    write_snapshot(rows.select(*values, F.col(key).alias(REQUEST_ID), F.col("labeled_at").alias(LABELED_AT)), path, run, key=PART)
    return spark.read.parquet(f"{path}/{PART}={run}")
