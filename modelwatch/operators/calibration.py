"""Prediction behaviour and calibration (F1–F9), one aggregation pass per report.

Medians and percentiles are exact (linear interpolation, like NumPy) and come from
counted values (``ordered.quantiles``), so no task holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numeric import unit_bin
from modelwatch.operators.common import null_safe_join
from modelwatch.operators.ordered import prefix_sums, quantiles
from modelwatch.params import CONFIDENCE_BUCKETS, DEFAULTS


def _valid(df: DataFrame, prob: str) -> DataFrame:
    return df.where(F.col(prob).isNotNull() & ~F.isnan(prob))


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df


def prediction_report(df: DataFrame, prob: str = "probability", by: Sequence[str] = (),
                      high: float = DEFAULTS.high_risk, low: float = DEFAULTS.low_risk) -> DataFrame:
    """n, mean, sample std, min, max, share > high, share < low (strict)."""
    p = F.col(prob)
    return _grouped(_valid(df, prob), by).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(p).alias("avg_probability"),
        F.stddev_samp(p).alias("std_probability"),
        F.min(p).alias("min_probability"),
        F.max(p).alias("max_probability"),
        F.avg((p > high).cast("double")).alias("high_risk_ratio"),
        F.avg((p < low).cast("double")).alias("low_risk_ratio"),
    )


def confidence(prob: str) -> Column:
    return F.greatest(F.col(prob), 1 - F.col(prob))


def confidence_summary(df: DataFrame, prob: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    """confidence ``max(p, 1−p)``: mean, median, population std, p5, p95, shares."""
    rows = _valid(df, prob).select(*by, confidence(prob).alias("_conf"))
    c = F.col("_conf")
    main = _grouped(rows, by).agg(
        F.avg(c).alias("mean_confidence"),
        F.stddev_pop(c).alias("std_confidence"),
        F.avg((c < DEFAULTS.low_confidence).cast("double")).alias("low_confidence_ratio"),
        F.avg((c > DEFAULTS.high_confidence).cast("double")).alias("high_confidence_ratio"),
    )
    middle = quantiles(rows, "_conf", {"median_confidence": 0.5, "p5_confidence": 0.05, "p95_confidence": 0.95}, by)
    return null_safe_join(main, middle, by).select(
        *by, "mean_confidence", "median_confidence", "std_confidence", "p5_confidence", "p95_confidence",
        "low_confidence_ratio", "high_confidence_ratio")


def confidence_histogram(df: DataFrame, prob: str = "probability", by: Sequence[str] = (),
                         buckets: Sequence[float] = CONFIDENCE_BUCKETS) -> DataFrame:
    """cumulative ``le`` bucket counts of confidence, plus ``+Inf`` (= count)."""
    c = confidence(prob)
    names = [f"le_{i}" for i in range(len(buckets))] + ["le_inf"]
    wide = _grouped(_valid(df, prob), by).agg(
        *[F.count_if(c <= b).alias(n) for n, b in zip(names, buckets)], F.count(F.lit(1)).alias("le_inf"))
    long = wide.unpivot(list(by), names, "bucket", "cumulative_count")
    labels = F.create_map(*[x for n, b in zip(names, list(buckets) + ["+Inf"]) for x in (F.lit(n), F.lit(str(b)))])
    return long.select(*by, F.element_at(labels, F.col("bucket")).alias("le"),
                       F.col("cumulative_count").cast("bigint").alias("cumulative_count"))


def entropy(df: DataFrame, prob: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    """mean binary entropy (base 2) with p clipped to [1e-10, 1 − 1e-10]."""
    eps = 1e-10
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    h = -p * F.log2(p) - (1 - p) * F.log2(1 - p)
    return _grouped(_valid(df, prob), by).agg(F.avg(h).alias("prediction_entropy"))


def class_balance(df: DataFrame, prob: str = "probability", by: Sequence[str] = (),
                  threshold: float = DEFAULTS.threshold, reference_rate: Column | float | None = None,
                  shift_bound: float = DEFAULTS.class_balance_shift) -> DataFrame:
    """F7 + F9: predicted positive / negative rate; with a reference rate, shift and alert."""
    pos = F.avg((F.col(prob) >= threshold).cast("double"))
    out = _grouped(_valid(df, prob), by).agg(pos.alias("predicted_positive_rate"))
    out = out.withColumn("predicted_negative_rate", 1.0 - F.col("predicted_positive_rate"))
    if reference_rate is not None:
        ref = reference_rate if isinstance(reference_rate, Column) else F.lit(float(reference_rate))
        out = (out.withColumn("reference_positive_rate", ref)
               .withColumn("class_balance_shift", F.abs(F.col("predicted_positive_rate") - ref))
               .withColumn("shift_alert", F.col("class_balance_shift") > shift_bound))
    return out


def reliability_bins(df: DataFrame, prob: str = "probability", label: str = "label",
                     by: Sequence[str] = (), n_bins: int = DEFAULTS.calibration_bins,
                     close_last: bool = False) -> DataFrame:
    """per non-empty bin ``[i/n, (i+1)/n)``: count, mean p, mean label, gap.

    p = 1.0 is in no bin (reference rule) unless ``close_last``; it still counts in
    the group total ``N`` used by :func:`ece`.
    """
    rows = df.where(F.col(label).isNotNull())
    b = unit_bin(prob, n_bins)
    if close_last:
        b = F.when(F.col(prob) == 1.0, F.lit(n_bins - 1)).otherwise(b)
    binned = rows.withColumn("bin", b).where(F.col("bin").isNotNull())
    return binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(prob).alias("avg_confidence"),
        F.avg(F.col(label).cast("double")).alias("avg_accuracy"),
    ).withColumn("calibration_gap", F.abs(F.col("avg_confidence") - F.col("avg_accuracy")))


def ece(df: DataFrame, prob: str = "probability", label: str = "label", by: Sequence[str] = (),
        n_bins: int = DEFAULTS.calibration_bins, close_last: bool = False) -> DataFrame:
    """``ECE = Σ gap·count / N`` per group, N = all labelled rows of the group."""
    bins = reliability_bins(df, prob, label, by, n_bins, close_last)
    n = _grouped(df.where(F.col(label).isNotNull()), by).agg(F.count(F.lit(1)).alias("n"))
    w = _grouped(bins, by).agg(F.sum(F.col("calibration_gap") * F.col("count")).alias("w"))
    return null_safe_join(n, w, by, "left").where("n > 0").select(
        *by, F.col("n").cast("bigint").alias("n_labelled"), (F.coalesce("w", F.lit(0.0)) / F.col("n")).alias("ece"))


def calibration_report(df: DataFrame, prob: str = "probability", label: str | None = "label",
                       by: Sequence[str] = (), reference_rate: Column | float | None = None,
                       threshold: float = DEFAULTS.threshold) -> DataFrame:
    """F8: sample size, F3, F5, F6, F7 and (with labels) ECE, one row per group.

    Rows are counted once per (group, score); everything follows from the counts. The order statistics (median
    confidence, Gini) need them in two orders, by score and by confidence: one prefix pass over both.
    """
    p, c = F.col(prob).cast("double"), F.col("_c").cast("double")
    known = F.lit(0) if label is None else F.when(F.col(label).isNotNull(), 1).otherwise(0)
    hits = F.lit(0.0) if label is None else F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    counts = (_valid(df, prob).groupBy(*by, p.alias("_p"))
              .agg(F.count(F.lit(1)).alias("_c"), F.sum(known).alias("_known"), F.sum(hits).alias("_hits")))
    orders = F.explode(F.array(F.struct(F.lit(0).alias("_order"), F.col("_p").alias("_x")),
                               F.struct(F.lit(1).alias("_order"), confidence("_p").alias("_x"))))
    ranked = prefix_sums(counts.select("*", orders.alias("o")).select(*by, "_p", "_c", "_known", "_hits", "o.*"),
                         ["_x"], ["_c"], [*by, "_order"])
    score, conf = F.col("_order") == 0, F.col("_order") == 1
    x, before, n = F.col("_x"), F.col("_c_before").cast("double"), F.col("n")

    def over(which: Column, value: Column) -> Column:
        return F.sum(F.when(which, value))

    half = (F.col("_c_total") - 1) * 0.5

    def value_at(i: Column) -> Column:
        return F.max(F.when(conf & (F.col("_c_before") <= i) & (i < F.col("_c_before") + F.col("_c")), x))

    eps = 1e-10
    pc = F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps))
    centred = x - 0.75  # of [0.5, 1]: the variance of nearly equal confidences does not cancel
    bins = unit_bin("_p", DEFAULTS.calibration_bins)
    gaps = [] if label is None else [over(score & (bins == i), F.col("_p") * F.col("_known") - F.col("_hits")).alias(f"_gap_{i}")
                                     for i in range(DEFAULTS.calibration_bins)]
    sums = _grouped(ranked, by).agg(
        over(score, F.col("_c")).alias("sample_size"), over(score, c).alias("n"),
        over(conf, c * centred).alias("_s1"), over(conf, c * centred * centred).alias("_s2"),
        value_at(F.floor(half)).alias("_lo"), value_at(F.ceil(half)).alias("_hi"),
        over(conf & (x < DEFAULTS.low_confidence), c).alias("_low"), over(conf & (x > DEFAULTS.high_confidence), c).alias("_high"),
        over(score, c * (-pc * F.log2(pc) - (1 - pc) * F.log2(1 - pc))).alias("_entropy"),
        over(score & (x >= threshold), c).alias("_positive"),
        over(score, x * c).alias("_total"), over(score, x * (c * before + c * (c - 1) / 2.0)).alias("_b"),
        over(score, F.col("_known")).alias("_labelled"), *gaps)
    median = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * ((n - 1) * 0.5 - F.floor((n - 1) * 0.5))
    mean = F.col("_s1") / n
    gini = F.try_divide(2.0 * (n * F.col("_total") - F.col("_b")), n * F.col("_total")) - (n + 1) / n
    out = sums.select(
        *by, F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
        (F.coalesce("_entropy", F.lit(0.0)) / n).alias("prediction_entropy"), (F.coalesce("_positive", F.lit(0.0)) / n).alias("predicted_positive_rate"),
        (mean + 0.75).alias("mean_confidence"), median.alias("median_confidence"),
        F.sqrt(F.greatest(F.col("_s2") / n - mean * mean, F.lit(0.0))).alias("std_confidence"),
        (F.coalesce("_low", F.lit(0.0)) / n).alias("low_confidence_ratio"), (F.coalesce("_high", F.lit(0.0)) / n).alias("high_confidence_ratio"),
        (gini if by else F.when(n.isNull(), 0.0).otherwise(gini)).alias("gini"),
        *([] if label is None else [F.when(F.col("_labelled") > 0, sum(
            (F.abs(F.coalesce(F.col(f"_gap_{i}"), F.lit(0.0))) for i in range(DEFAULTS.calibration_bins)), F.lit(0.0))
            / F.col("_labelled")).alias("ece")]))
    if reference_rate is not None:
        ref = reference_rate if isinstance(reference_rate, Column) else F.lit(float(reference_rate))
        out = out.withColumn("shift_alert", F.abs(F.col("predicted_positive_rate") - ref) > DEFAULTS.class_balance_shift)
    return out
