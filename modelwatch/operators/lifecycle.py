"""Lifecycle decisions as table operators (G5, G6, H2, H3, L1–L5, A11, A13): one row per model family.

The reference decides for one model; here every family of a registry is decided
in the same job, by aggregations keyed on ``model_name`` and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.params import DEFAULTS, EXPERIMENT_NAME_PATTERN

LINEAGE_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("trigger", T.StringType()),
    T.StructField("parent_model", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])


def latest_experiment(models: DataFrame, pattern: str = EXPERIMENT_NAME_PATTERN) -> DataFrame:
    """Per family the greatest well-named version that has metadata."""
    ok = models.where(F.col("model_version").rlike(pattern) & F.col("has_metadata"))
    return ok.groupBy("model_name").agg(
        F.max_by(F.struct("model_version", "metrics", "feature_schema"), F.col("model_version")).alias("x")
    ).select("model_name", "x.model_version", "x.metrics", "x.feature_schema")


def previous_version(lineage: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Per family the current version, the lineage length, and the latest *different* version."""
    key = F.struct(*[F.col(c) for c in order])
    cur = lineage.groupBy("model_name").agg(
        F.max_by("model_version", key).alias("current_version"),
        F.count(F.lit(1)).cast("bigint").alias("lineage_rows"))
    prev = (lineage.join(cur.select("model_name", "current_version"), "model_name")
            .where(F.col("model_version").isNotNull() & (F.col("model_version") != "")
                   & (F.col("model_version") != F.col("current_version")))
            .groupBy("model_name").agg(F.max_by("model_version", key).alias("previous_version")))
    return cur.join(prev, "model_name", "left")


def schema_diff(prod: Column, challenger: Column) -> tuple[Column, Column, Column]:
    """H2: (added, removed, identical) of two feature lists compared as sets."""
    p = F.coalesce(prod, F.array().cast("array<string>"))
    c = F.coalesce(challenger, F.array().cast("array<string>"))
    added = F.array_sort(F.array_distinct(F.array_except(c, p)))
    removed = F.array_sort(F.array_distinct(F.array_except(p, c)))
    return added, removed, (F.size(added) == 0) & (F.size(removed) == 0)


def ordered_match(prod: Column, new: Column) -> Column:
    """H3: exact ordered equality; a missing list is the empty list."""
    empty = F.array().cast("array<string>")
    return F.coalesce(prod, empty) == F.coalesce(new, empty)


def promotion_gate(families: DataFrame, challengers: DataFrame, champions: DataFrame,
                   metric: str = DEFAULTS.selection_metric,
                   min_improvement: float = DEFAULTS.min_improvement) -> DataFrame:
    """L1 (with C5): champion / challenger decision per family, in the reference's order.

    no experiment → reject; no champion → promote (first deployment); removed
    features → reject; metric missing on either side → reject; promote iff
    Δ ≥ min_improvement and Δ > 0; else retain.
    """
    ch = challengers.select("model_name", F.col("model_version").alias("challenger_version"),
                            F.col("metrics").alias("ch_metrics"), F.col("feature_schema").alias("ch_schema"))
    cp = champions.select("model_name", F.col("model_version").alias("champion_version"),
                          F.col("metrics").alias("cp_metrics"), F.col("feature_schema").alias("cp_schema"))
    j = families.select("model_name").distinct().join(ch, "model_name", "left").join(cp, "model_name", "left")
    added, removed, _ = schema_diff(F.col("cp_schema"), F.col("ch_schema"))
    ch_m = F.col("ch_metrics")[metric]
    cp_m = F.col("cp_metrics")[metric]
    delta = ch_m - cp_m
    reason = (
        F.when(F.col("challenger_version").isNull(), "no_experiment")
        .when(F.col("champion_version").isNull(), "first_deployment")
        .when(F.size(removed) > 0, "removed_features")
        .when(ch_m.isNull() | cp_m.isNull(), "metric_missing")
        .when((delta >= min_improvement) & (delta > 0), "improved")
        .otherwise("not_improved")
    )
    decision = (F.when(reason.isin("first_deployment", "improved"), "promote")
                .when(reason == "not_improved", "retain").otherwise("reject"))
    return j.select(
        "model_name", "challenger_version", "champion_version",
        F.array_join(added, ",").alias("added_features"), F.array_join(removed, ",").alias("removed_features"),
        delta.alias("improvement"), reason.alias("reason"), decision.alias("decision"),
        F.col("ch_schema"), F.col("cp_schema"), F.col("ch_metrics"))


def promotion_check(gate: DataFrame) -> DataFrame:
    """L2: a promotion goes through only with an exact ordered schema match (or no production model);
    the parent is the production version."""
    allowed = F.col("champion_version").isNull() | ordered_match(F.col("cp_schema"), F.col("ch_schema"))
    return gate.select(
        "model_name", "challenger_version", F.col("champion_version").alias("parent_model"),
        (F.col("decision") == "promote").alias("gate_passed"),
        ((F.col("decision") == "promote") & allowed).alias("promoted"),
        F.when((F.col("decision") == "promote") & ~allowed, "schema_mismatch").alias("refusal"), "ch_metrics")


def rollback_target(health: DataFrame, lineage: DataFrame, bundles: DataFrame) -> DataFrame:
    """L4: per family, the version to restore: needs an unhealthy verdict, ≥ 2 lineage rows,
    a distinct earlier version, and that version's bundle."""
    prev = previous_version(lineage)
    have = bundles.select("model_name", F.col("model_version").alias("previous_version"),
                          F.lit(True).alias("bundle_exists")).distinct()
    j = health.select("model_name", "retraining_recommended").join(prev, "model_name", "left") \
        .join(have, ["model_name", "previous_version"], "left")
    reason = (
        F.when(~F.coalesce("retraining_recommended", F.lit(False)), "healthy")
        .when(F.coalesce("lineage_rows", F.lit(0)) < 2, "no_history")
        .when(F.col("previous_version").isNull(), "single_version")
        .when(F.col("bundle_exists").isNull(), "bundle_missing")
        .otherwise("rollback")
    )
    return j.select("model_name", "current_version", "previous_version",
                    F.coalesce("lineage_rows", F.lit(0)).cast("bigint").alias("lineage_rows"),
                    reason.alias("reason"), (reason == "rollback").alias("rolled_back"))


def cycle_decision(health: DataFrame, gate: DataFrame, rollback: DataFrame) -> DataFrame:
    """Healthy → rollback check only; unhealthy → retrain, compare, promote; no rollback after a promotion."""
    chk = promotion_check(gate).select("model_name", "promoted")
    j = (health.select("model_name", "retraining_recommended")
         .join(chk, "model_name", "left").join(rollback.select("model_name", "rolled_back"), "model_name", "left"))
    unhealthy = F.coalesce("retraining_recommended", F.lit(False))
    promoted = unhealthy & F.coalesce("promoted", F.lit(False))
    return j.select(
        "model_name", unhealthy.alias("retrained"), promoted.alias("promoted"),
        (~promoted & F.coalesce("rolled_back", F.lit(False))).alias("rolled_back"))


def lineage_record(promotions: DataFrame, lineage: DataFrame, ts: Column, dataset: Column,
                   trigger: str = "drift_retraining") -> DataFrame:
    """Lineage rows for the promotions of a run (append them to the lineage table).

    A family's rows are numbered on from its last ``seq``; the metrics are the challenger's.
    """
    last = lineage.groupBy("model_name").agg(F.max("seq").alias("_seq"))
    return promotions.where("promoted").join(last, "model_name", "left").select(
        "model_name", F.col("challenger_version").alias("model_version"), ts.alias("ts"),
        (F.coalesce("_seq", F.lit(0)) + 1).cast("bigint").alias("seq"), dataset.alias("dataset"),
        F.lit(trigger).alias("trigger"), "parent_model", F.col("ch_metrics").alias("metrics"))


def experiment_rows(leaderboard: DataFrame, model_name: Column, version: Column, feature_schema: list[str],
                    candidate: str = "candidate", metrics: tuple[str, ...] = ("roc_auc", "pr_auc")) -> DataFrame:
    """One ``model_versions`` row per trained candidate (metrics as a map, ordered feature schema)."""
    mp = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    return leaderboard.select(
        model_name.alias("model_name"), F.concat(version, F.lit("_"), F.col(candidate)).alias("model_version"),
        F.lit(True).alias("has_metadata"), mp.alias("metrics"),
        F.array(*[F.lit(f) for f in feature_schema]).alias("feature_schema"),
        F.col("is_winner").alias("is_winner"))
