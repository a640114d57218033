"""Evaluation of scored, labelled tables (T6–T12), one row per candidate group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.operators.common import null_safe_join
from modelwatch.operators.ordered import ranking_metrics
from modelwatch.params import DEFAULTS


def target_distribution(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per target value."""
    return df.groupBy(*by, target).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


def split_summary(df: DataFrame, split: str, columns: Sequence[str], range_col: str | None = None) -> DataFrame:
    """Per split and column: mean and sample std; min / max of ``range_col``."""
    long = df.select(split, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        split, list(columns), "column_name", "value")
    out = long.groupBy(split, "column_name").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.count("value").cast("bigint").alias("n"))
    if range_col:
        rng = df.groupBy(split).agg(F.min(range_col).alias("range_min"), F.max(range_col).alias("range_max"))
        out = null_safe_join(out, rng, [split], "left")
    return out


def classification_metrics(df: DataFrame, score: str = "probability", label: str = "label",
                           by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 at ``score > cut`` (the model's own decision); 0 on zero divisors."""
    pred = F.col(score) > cut
    y = F.col(label) == 1
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    g = rows.groupBy(*by) if by else rows
    agg = g.agg(
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def safe(num, den):
        return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))

    return agg.select(
        *by,
        *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
        safe(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def evaluate_candidates(df: DataFrame, candidate: str, score: str = "probability", label: str = "label") -> DataFrame:
    """T8–T10 for every candidate in one table."""
    cls = classification_metrics(df, score, label, [candidate])
    rank = ranking_metrics(df, score, label, [candidate])
    return null_safe_join(cls, rank, [candidate], "full")


def leaderboard(metrics: DataFrame, candidate: str, metric: str = DEFAULTS.selection_metric,
                by: Sequence[str] = ()) -> DataFrame:
    """Rank candidates by ``metric`` (descending; ties by candidate name); the first is the winner.

    Candidates per family are few (one row each), so the window partitions are small.
    """
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), F.col(candidate).asc())
    return metrics.withColumn("rank", F.row_number().over(w)).withColumn("is_winner", F.col("rank") == 1)


def acceptance(scored: DataFrame, score: str = "probability", label: str = "label", by: Sequence[str] = (),
               floor: float = DEFAULTS.roc_auc_floor) -> DataFrame:
    """Every score in [0, 1] and ROC-AUC above the floor."""
    valid = F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) >= 0) & (F.col(score) <= 1)
    bad = (scored.groupBy(*by) if by else scored).agg(F.count_if(~valid).cast("bigint").alias("bad_scores"))
    auc = ranking_metrics(scored, score, label, by).select(*by, "roc_auc")
    return null_safe_join(bad, auc, by, "left").withColumn(
        "accepted", (F.col("bad_scores") == 0) & F.coalesce(F.col("roc_auc") > floor, F.lit(False)))
