"""Drift: PSI with NumPy-exact edges (E1–E4, E6), the bin grid join (C4), health (E5).

Inputs are long tables ``(*by, feature, value)``: one pass over the data serves
every feature and group. The work is two aggregations with map-side partial
combine (min/max per group, counts per group × bin); only per-group metadata
(edges) and per-bin counts ever move, never the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numeric import bin_by_edges, edge_at, outer_edges, present_number
from modelwatch.operators.common import broadcast_stored, null_safe_join, r6
from modelwatch.params import DEFAULTS


def _keys(by: Sequence[str]) -> list[str]:
    return list(by) + ["feature"]


def bin_edges(reference: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Per (group, feature) range of the reference, widened by ±0.5 when constant."""
    keys = _keys(by)
    agg = (
        reference.where(present_number(value))
        .groupBy(*keys)
        .agg(F.min(value).alias("lo0"), F.max(value).alias("hi0"), F.count(F.lit(1)).alias("n_reference"))
    )
    lo, hi = outer_edges(F.col("lo0"), F.col("hi0"))
    return agg.select(*keys, lo.alias("lo"), hi.alias("hi"), "n_reference")


def _tagged(reference: DataFrame, production: DataFrame, columns: Sequence) -> DataFrame:
    return reference.select(*columns, F.lit(0).alias("_side")).unionByName(production.select(*columns, F.lit(1).alias("_side")))


def grid(meta: DataFrame, counts: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Every cell of the groups that have a reference; production values without one keep a row with a NULL bin."""
    keys = _keys(by)
    cells = meta.where("n_reference > 0").select(
        *keys, "lo", "hi", "n_reference", F.explode(F.sequence(F.lit(0), F.lit(bins + 1))).alias("bin"))
    full = null_safe_join(cells, counts, keys + ["bin"], "full")  # one pass over the counts
    return full.where("n_reference IS NOT NULL OR prod_count > 0").select(
        *keys, F.when(F.col("n_reference").isNotNull(), F.col("bin")).alias("bin"), "lo", "hi",
        F.coalesce("n_reference", F.lit(0)).cast("bigint").alias("n_reference"),
        F.coalesce("ref_count", F.lit(0)).cast("bigint").alias("ref_count"),
        F.coalesce("prod_count", F.lit(0)).cast("bigint").alias("prod_count"))


def bin_counts(reference: DataFrame, production: DataFrame, by: Sequence[str] = (), value: str = "value",
               bins: int = DEFAULTS.psi_bins) -> DataFrame:
    """E2 + C4: counts per (group, feature, slot) on both sides over the full grid.

    Slots: 0 underflow, 1..bins interior, bins+1 overflow. Missing cells are 0. NULL keys
    are groups like any other. Both sides are tagged and binned in one pass against the edge
    table, then aggregated with map-side combine. Production values of a group and feature without
    reference values are one row with a NULL bin and ``n_reference`` 0.
    """
    keys = _keys(by)
    base = bin_edges(reference, by, value)
    inner = [edge_at(F.lit(i), F.col("lo"), F.col("hi"), bins).alias(f"e{i}") for i in range(1, bins)]
    edges = broadcast_stored(base.select("*", *inner), 8 * (bins + 3) + 256, "edges")
    rows = _tagged(reference, production, [*keys, F.col(value).cast("double").alias("v")]).where(present_number("v"))
    slot = F.when(F.col("lo").isNull(), F.lit(bins + 2)).otherwise(
        bin_by_edges("v", F.col("lo"), F.col("hi"), [F.col(f"e{i}") for i in range(1, bins)]))
    counts = null_safe_join(rows, edges, keys, "left").groupBy(*keys, slot.alias("bin")).agg(
        F.count_if(F.col("_side") == 0).alias("ref_count"), F.count_if(F.col("_side") == 1).alias("prod_count"))
    return grid(edges.select(*keys, "lo", "hi", "n_reference"), counts, by, bins)


def bin_counts_wide(reference: DataFrame, production: DataFrame, features: Sequence[str], by: Sequence[str] = (),
                    bins: int = DEFAULTS.psi_bins) -> DataFrame:
    """E1 + E2 + C4 on wide tables (one column per feature): same output as :func:`bin_counts`.

    The reference range per (group, feature) is one small aggregation; its ``numpy.linspace`` edges are a
    stored table with a row per group, joined on the group (without groups: one row, attached as a
    subquery and not stored). Each row bins every feature in place into an int slot ``feature · (bins + 3) + bin``; one
    aggregation with map-side combine counts ``(group, side, slot)``, so at most
    ``features · (bins + 3) · 2`` cells per group leave each task.
    """
    edges = wide_edges(reference, features, by, bins)
    if by:
        edges = broadcast_stored(edges, 8 * len(features) * (bins + 3) + 256, "edges")
    rows = _tagged(reference, production, [*by, *[F.col(f).cast("double").alias(f) for f in features]])
    counts = wide_slots(rows, edges, features, by, bins, ref_count=F.count_if(F.col("_side") == 0),
                        prod_count=F.count_if(F.col("_side") == 1))
    return grid(wide_ranges(edges, features, by), counts, by, bins)


def wide_edges(reference: DataFrame, features: Sequence[str], by: Sequence[str] = (), bins: int = DEFAULTS.psi_bins) -> DataFrame:
    """E1, a row per group: ``<feature>__lo``, ``__hi``, ``__n`` and the inner edges ``__e1`` … of every feature."""
    stats = []
    for f in features:
        v = F.col(f).cast("double")
        ok = present_number(v)
        stats += [F.min(F.when(ok, v)).alias(f"{f}__lo0"), F.max(F.when(ok, v)).alias(f"{f}__hi0"),
                  F.count_if(ok).alias(f"{f}__n")]
    cols = []
    for f in features:
        lo, hi = outer_edges(F.col(f"{f}__lo0"), F.col(f"{f}__hi0"))
        cols += [lo.alias(f"{f}__lo"), hi.alias(f"{f}__hi"), F.col(f"{f}__n")]
    inner = [edge_at(F.lit(i), F.col(f"{f}__lo"), F.col(f"{f}__hi"), bins).alias(f"{f}__e{i}")
             for f in features for i in range(1, bins)]
    return reference.groupBy(*by).agg(*stats).select(*by, *cols).select("*", *inner)


def wide_ranges(edges: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The long form of :func:`wide_edges` without the inner edges: (by, feature, lo, hi, n_reference)."""
    return edges.select(*by, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__lo").alias("lo"), F.col(f"{f}__hi").alias("hi"),
                 F.col(f"{f}__n").alias("n_reference")) for f in features])).alias("m")).select(*by, "m.*")


def wide_slots(rows: DataFrame, edges: DataFrame, features: Sequence[str], by: Sequence[str] = (), bins: int = DEFAULTS.psi_bins,
               also: Sequence[str] = (), **counts) -> DataFrame:
    """(by, also, feature, bin) and the aggregates ``counts`` over the values of every slot that has some."""
    width = bins + 3
    slots = [F.when(present_number(f), F.lit(i * width) + F.when(F.col(f"{f}__lo").isNull(), F.lit(bins + 2)).otherwise(
        bin_by_edges(f, F.col(f"{f}__lo"), F.col(f"{f}__hi"), [F.col(f"{f}__e{k}") for k in range(1, bins)])))
        for i, f in enumerate(features)]
    extra = [c for c in rows.columns if c not in (*by, *also, *features)]
    per_slot = (null_safe_join(rows, edges, by, "left").select(*by, *also, *extra, F.explode(F.array(*slots)).alias("slot"))
                .where(F.col("slot").isNotNull()).groupBy(*by, *also, "slot").agg(*[a.alias(n) for n, a in counts.items()]))
    names = F.array(*[F.lit(f) for f in features])
    return per_slot.select(*by, *also, F.element_at(names, (F.col("slot") / width).cast("int") + 1).alias("feature"),
                           (F.col("slot") % width).alias("bin"), *counts)


def psi_from_counts(counts: DataFrame, by: Sequence[str] = (), bins: int = DEFAULTS.psi_bins,
                    alpha: float = DEFAULTS.psi_smoothing) -> DataFrame:
    """E3 from the (bins + 2) cells of each group."""
    keys = _keys(by)
    slots = float(bins + 2)
    totals = counts.groupBy(*keys).agg(
        F.first("n_reference").alias("n_reference"),
        F.sum("prod_count").alias("n_production"),
        F.collect_list(F.struct("ref_count", "prod_count")).alias("cells"),
    )
    term = F.aggregate(
        "cells", F.lit(0.0),
        lambda acc, c: acc + (
            ((c["prod_count"] + alpha) / (F.col("n_production") + alpha * slots))
            - ((c["ref_count"] + alpha) / (F.col("n_reference") + alpha * slots))
        ) * F.log(
            ((c["prod_count"] + alpha) / (F.col("n_production") + alpha * slots))
            / ((c["ref_count"] + alpha) / (F.col("n_reference") + alpha * slots))
        ),
    )
    return totals.select(
        *keys, "n_reference", F.col("n_production").cast("bigint").alias("n_production"),
        F.when((F.col("n_production") > 0) & (F.col("n_reference") > 0), term).alias("psi"),
    )


def verdicts(p: DataFrame, by: Sequence[str] = (), threshold: float = DEFAULTS.psi_threshold,
             min_samples: int = DEFAULTS.min_production_samples) -> DataFrame:
    """E4 + E6 from per-feature PSI rows; ``no_reference`` where only production has values."""
    alone = F.col("n_reference") == 0
    insufficient = F.col("n_production") < min_samples
    return p.select(
        *_keys(by), "n_reference", "n_production",
        F.when(~insufficient, F.col("psi")).alias("psi"),
        F.when(alone, "no_reference").when(insufficient, "insufficient").when(F.col("psi") > threshold, "DRIFT").otherwise("STABLE").alias("status"),
        F.when(~alone & ~insufficient, severity(F.col("psi"))).alias("severity"),
    )


def drift_report_wide(reference: DataFrame, production: DataFrame, features: Sequence[str], by: Sequence[str] = (),
                      bins: int = DEFAULTS.psi_bins, threshold: float = DEFAULTS.psi_threshold,
                      min_samples: int = DEFAULTS.min_production_samples) -> DataFrame:
    """E4 on wide tables (the fast path when features are columns)."""
    counts = bin_counts_wide(reference, production, features, by, bins)
    return verdicts(psi_from_counts(counts, by, bins), by, threshold, min_samples)


def psi_contributions(counts: DataFrame, by: Sequence[str] = (), bins: int = DEFAULTS.psi_bins,
                      alpha: float = DEFAULTS.psi_smoothing) -> DataFrame:
    """Per slot: smoothed shares and the PSI term ``(a − e)·ln(a/e)``."""
    from pyspark.sql import Window

    keys = _keys(by)
    w = Window.partitionBy(*keys)
    slots = float(bins + 2)
    n_ref = F.sum("ref_count").over(w)
    n_prod = F.sum("prod_count").over(w)
    e = (F.col("ref_count") + alpha) / (n_ref + alpha * slots)
    a = (F.col("prod_count") + alpha) / (n_prod + alpha * slots)
    return (
        counts.where(F.col("bin").isNotNull()).withColumn("n_production", n_prod)
        .withColumn("expected_share", e)
        .withColumn("actual_share", a)
        .withColumn("term", F.when(F.col("n_production") > 0,
                                   (F.col("actual_share") - F.col("expected_share"))
                                   * F.log(F.col("actual_share") / F.col("expected_share"))))
    )


def psi(reference: DataFrame, production: DataFrame, by: Sequence[str] = (), value: str = "value",
        bins: int = DEFAULTS.psi_bins, alpha: float = DEFAULTS.psi_smoothing) -> DataFrame:
    """PSI per (group, feature). NULL when production has no values (the reference raises)."""
    return psi_from_counts(bin_counts(reference, production, by, value, bins), by, bins, alpha)


def severity(psi_col) -> F.Column:
    """Documented bands: nominal < 0.10 ≤ moderate ≤ 0.20 < significant."""
    return (
        F.when(psi_col.isNull(), F.lit(None))
        .when(psi_col < 0.10, "nominal")
        .when(psi_col <= 0.20, "moderate")
        .otherwise("significant")
    )


def drift_report(reference: DataFrame, production: DataFrame, by: Sequence[str] = (), value: str = "value",
                 bins: int = DEFAULTS.psi_bins, threshold: float = DEFAULTS.psi_threshold,
                 min_samples: int = DEFAULTS.min_production_samples) -> DataFrame:
    """Per (group, feature): psi, ``DRIFT`` (psi > threshold) / ``STABLE`` / ``insufficient``."""
    return verdicts(psi(reference, production, by, value, bins), by, threshold, min_samples)


def model_health(report: DataFrame, by: Sequence[str] = (),
                 limit: int = DEFAULTS.drift_feature_limit) -> DataFrame:
    """E5: one verdict per group from a drift report.

    ``evaluated`` / ``skipped`` / ``drifting`` are sorted comma lists; drifting
    entries are ``feature:psi`` with psi at 4 decimals. A group without values on one side (A4) is
    ``unknown``. With no grouping the result is exactly one row, also when the report is empty.
    """
    used = F.col("status").isin("DRIFT", "STABLE")
    evaluated = F.array_sort(F.collect_list(F.when(used, F.col("feature"))))
    skipped = F.array_sort(F.collect_list(F.when(~used, F.col("feature"))))
    drifting = F.array_sort(F.collect_list(F.when(
        F.col("status") == "DRIFT",
        F.concat(F.col("feature"), F.lit(":"), F.format_string("%.4f", F.round(F.col("psi"), 4))))))
    grouped = report.groupBy(*by) if by else report
    agg = grouped.agg(
        evaluated.alias("evaluated"), skipped.alias("skipped"), drifting.alias("drifting"),
        F.count_if(F.col("status") == "DRIFT").alias("drifting_feature_count"),
        F.coalesce(F.sum("n_reference"), F.lit(0)).alias("n_ref"), F.coalesce(F.sum("n_production"), F.lit(0)).alias("n_prod"),
    )
    n_eval = F.size("evaluated")
    one_side = (F.col("n_ref") == 0) | (F.col("n_prod") == 0)
    return agg.select(
        *by,
        F.when(one_side, "unknown").when(n_eval == 0, "insufficient_data").otherwise("evaluated").alias("status"),
        F.col("drifting_feature_count").cast("bigint").alias("drifting_feature_count"),
        F.array_join("drifting", ",").alias("drifting_features"),
        F.array_join("evaluated", ",").alias("evaluated_features"),
        F.array_join("skipped", ",").alias("skipped_features"),
        ((n_eval > 0) & (F.col("drifting_feature_count") >= limit)).alias("retraining_recommended"),
    )


def with_unknown(groups: DataFrame, health: DataFrame, by: Sequence[str]) -> DataFrame:
    """A4 → E5: every group of a registry with its verdict; one that no table mentions is ``unknown``."""
    out = null_safe_join(groups.select(*by).distinct(), health, by, "left")
    return out.select(*by, F.coalesce("status", F.lit("unknown")).alias("status"),
                      F.coalesce("drifting_feature_count", F.lit(0)).cast("bigint").alias("drifting_feature_count"),
                      F.coalesce("retraining_recommended", F.lit(False)).alias("retraining_recommended"))


def psi_of(reference: DataFrame, production: DataFrame, value: str = "value",
           bins: int = DEFAULTS.psi_bins) -> float:
    """Scalar PSI of two one-column tables.

    Raises ``ValueError`` when either side has no non-missing value. Only the
    one-number result comes to the driver.
    """
    ref = reference.select(F.lit("x").alias("feature"), F.col(value).cast("double").alias("value"))
    prod = production.select(F.lit("x").alias("feature"), F.col(value).cast("double").alias("value"))
    row = psi(ref, prod, (), "value", bins).first()
    if row is None or row["psi"] is None:
        counts = (row["n_reference"], row["n_production"]) if row else (0, 0)
        raise ValueError("no PSI without values on both sides: %d reference, %d production" % counts)
    return float(row["psi"])


def rounded(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])
