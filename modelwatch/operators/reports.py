"""Reports (A9) and the dashboard read (A10).

A report is a row ``(kind, scope, ts, body)`` with the body as JSON text of the
report struct, appended to a ``reports`` table. The dashboard takes the latest
body per kind and lists the kinds present.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The report kinds the dashboard shows.
REPORT_KINDS = ("health", "data_quality", "calibration", "prediction")


def as_reports(report: DataFrame, kind: str, ts: Column, scope: Sequence[str] = (),
               exclude: Sequence[str] = ()) -> DataFrame:
    """One report row per row of an operator's output (scope = the grouping keys)."""
    scope_col = (F.concat_ws("/", *[F.col(c).cast("string") for c in scope]) if scope else F.lit("all"))
    body_cols = [c for c in report.columns if c not in scope and c not in exclude]
    return report.select(F.lit(kind).alias("kind"), scope_col.alias("scope"), ts.alias("ts"),
                         F.to_json(F.struct(*body_cols)).alias("body"))


def write_reports(reports: DataFrame, path: str, run: str) -> DataFrame:
    """A9 sink: the reports of a run under ``path/run=…`` by kind (a rerun replaces its own); returns the table."""
    reports.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/run={run}")
    return reports.sparkSession.read.option("basePath", path).parquet(f"{path}/run=*").select("kind", "scope", "ts", "body")


def dashboard(spark: SparkSession, reports: DataFrame, kinds: Sequence[str] = REPORT_KINDS) -> DataFrame:
    """A10: the latest report and the number of reports per kind and scope; a known kind without any is one row,
    not present."""
    latest = reports.groupBy("kind", "scope").agg(
        F.max_by(F.struct("ts", "body"), F.struct("ts", "body")).alias("latest"),
        F.count(F.lit(1)).cast("bigint").alias("reports"))
    known = spark.createDataFrame([(k,) for k in kinds], "kind string")
    return known.join(latest, "kind", "left").select(
        "kind", "scope", F.col("latest").isNotNull().alias("present"), F.col("latest.ts").alias("latest_ts"),
        F.col("latest.body").alias("latest_body"), F.coalesce("reports", F.lit(0)).alias("reports"))
