"""Request-log analytics (R1–R8): totals, latency histogram, windowed rates, p95, sustained alerts.

Input: ``(ts, path, method, status, client, latency_seconds)``. Windowed
operators take the width (and slide) as parameters; the same expressions run in
batch and, with a watermark, in Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.operators.common import null_safe_join
from modelwatch.operators.ordered import quantiles
from modelwatch.params import DEFAULTS, LATENCY_BUCKETS


def request_totals(log: DataFrame) -> DataFrame:
    """Requests by path, method, status."""
    return log.groupBy("path", "method", "status").agg(F.count(F.lit(1)).cast("bigint").alias("requests"))


def bucket_counts(lat: Column, buckets: Sequence[float]) -> list[Column]:
    """Cumulative counts ``b0``, ``b1`` … of latencies up to each bound."""
    return [F.count_if(lat <= b).alias(f"b{i}") for i, b in enumerate(buckets)]


def latency_histogram(log: DataFrame, by: Sequence[str] = ("path", "method"),
                      buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """R2: cumulative ``le`` buckets (5 ms … 5 s, +Inf), with the sum and count per series."""
    lat = F.col("latency_seconds")
    wide = log.groupBy(*by).agg(*bucket_counts(lat, buckets), F.count(F.lit(1)).alias("binf"),
                                F.sum(lat).alias("latency_sum"))
    names = [f"b{i}" for i in range(len(buckets))] + ["binf"]
    labels = F.create_map(*[x for n, b in zip(names, [str(b) for b in buckets] + ["+Inf"]) for x in (F.lit(n), F.lit(b))])
    long = wide.unpivot(list(by) + ["latency_sum"], names, "bucket", "cumulative_count")
    return long.select(*by, F.element_at(labels, F.col("bucket")).alias("le"),
                       F.col("cumulative_count").cast("bigint").alias("cumulative_count"), "latency_sum")


def _windowed(log: DataFrame, width: str, slide: str | None, by: Sequence[str]):
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.groupBy(w.alias("w"), *by)


def error_rate(log: DataFrame, width: str = "5 minutes", slide: str | None = None, by: Sequence[str] = (),
               bound: float = DEFAULTS.error_rate_bound, error_status: int = 500) -> DataFrame:
    """R3 (+ I9 with ``slide``): share of error responses per window; alert above the bound."""
    out = _windowed(log, width, slide, by).agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"),
        F.count_if(F.col("status") == error_status).cast("bigint").alias("errors"))
    return out.select(F.col("w.start").alias("window_start"), *by, "requests", "errors",
                      (F.col("errors") / F.col("requests")).alias("error_rate"),
                      (F.col("errors") / F.col("requests") > bound).alias("alert"))


def histogram_quantile(q: float, cums: Column, les: Sequence[float]) -> Column:
    """Quantile from cumulative bucket counts (last entry = +Inf), linear inside the bucket.

    The first bucket's lower bound is 0; a rank in the +Inf bucket returns the
    largest finite bound; no observations → NULL.
    """
    total = F.element_at(cums, -1)
    rank = F.lit(q) * total
    idx = F.array_position(F.transform(cums, lambda c: c >= rank), True).cast("int")  # 1-based
    bounds = F.array(*[F.lit(float(b)) for b in les])
    n_finite = len(les)
    upper = F.element_at(bounds, F.least(idx, F.lit(n_finite)))
    lower = F.when(idx == 1, F.lit(0.0)).otherwise(F.element_at(bounds, F.greatest(idx - 1, F.lit(1))))
    c_hi = F.element_at(cums, idx)
    c_lo = F.when(idx == 1, F.lit(0)).otherwise(F.element_at(cums, F.greatest(idx - 1, F.lit(1))))
    inside = lower + (upper - lower) * (rank - c_lo) / (c_hi - c_lo)
    return (F.when(total == 0, F.lit(None))
            .when(idx > n_finite, F.lit(float(les[-1])))
            .otherwise(inside))


def p95_bucketed(log: DataFrame, width: str = "5 minutes", slide: str | None = None, by: Sequence[str] = (),
                 q: float = 0.95, bound: float = DEFAULTS.p95_bound_seconds,
                 buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """p95 latency per window from the bucketed histogram; alert above the bound."""
    lat = F.col("latency_seconds")
    out = _windowed(log, width, slide, by).agg(*bucket_counts(lat, buckets), F.count(F.lit(1)).alias("binf"))
    cums = F.array(*[F.col(f"b{i}") for i in range(len(buckets))], F.col("binf"))
    p = histogram_quantile(q, cums, buckets)
    return out.select(F.col("w.start").alias("window_start"), *by, F.col("binf").cast("bigint").alias("requests"),
                      p.alias("p95"), (p > bound).alias("alert"))


def p95_exact(log: DataFrame, width: str = "5 minutes", slide: str | None = None, by: Sequence[str] = (),
              q: float = 0.95) -> DataFrame:
    """R4 exact twin: the interpolated percentile of the raw latencies per window, from counted values."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = log.select(w.alias("w"), *by, "latency_seconds").select(F.col("w.start").alias("window_start"), *by, "latency_seconds")
    keys = ["window_start", *by]
    requests = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("requests"))
    return null_safe_join(requests, quantiles(rows, "latency_seconds", {"p95": q}, keys), keys, "left").select(
        *keys, "requests", "p95")


def sustained(windows: DataFrame, series: Sequence[str], start: str, cond: Column, width_seconds: int,
              for_seconds: int, slide_seconds: int | None = None) -> DataFrame:
    """Gaps-and-islands over window sequences: runs of consecutive windows where ``cond`` holds.

    Windows follow each other every ``slide_seconds`` (default: their width); a missing one
    breaks a run. The alert is evaluated at each window's end, so a run of n windows has held for n slides;
    it fires at ``for_seconds`` (the alert's ``for`` clause). Windows of one series are few (time span /
    slide), so the per-series ordering is a bounded partition.
    """
    slide = slide_seconds or width_seconds
    idx = F.floor(F.unix_timestamp(start) / slide).cast("bigint")
    rows = windows.where(cond).select(*series, F.col(start).alias("start"), idx.alias("idx"))
    rn = F.row_number().over(Window.partitionBy(*series).orderBy("idx"))
    islands = rows.withColumn("island", F.col("idx") - rn)
    runs = islands.groupBy(*series, "island").agg(
        F.min("start").alias("run_start"), F.max("start").alias("run_last"),
        F.count(F.lit(1)).cast("bigint").alias("windows"))
    return runs.select(*series, "run_start",
                       (F.col("run_last") + F.make_interval(secs=F.lit(width_seconds))).alias("run_end"),
                       "windows", (F.col("windows") * slide >= for_seconds).alias("fired"))


def busy_clients(log: DataFrame, per_minute: int = DEFAULTS.rate_limit_per_minute) -> DataFrame:
    """R7 (detection, not a limiter): per client the peak requests in one minute and the minutes over the limit."""
    per = log.groupBy("client", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("client").agg(
        F.max("n").cast("bigint").alias("peak_per_minute"),
        F.count_if(F.col("n") > per_minute).cast("bigint").alias("minutes_over_limit"))


def event_counters(log: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Counts and mean latency per series (explanations, writes, label outcomes …)."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("events"),
                                F.avg("latency_seconds").alias("mean_latency_seconds"))
