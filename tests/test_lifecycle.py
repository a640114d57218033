"""Lifecycle decisions, outbox leases, traffic alerts: one row per branch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import lifecycle as lc
from modelwatch.operators import outbox as ob
from modelwatch.operators import traffic as tr

MV = "model_name string, model_version string, has_metadata boolean, metrics map<string,double>, feature_schema array<string>"
CP = "model_name string, model_version string, metrics map<string,double>, feature_schema array<string>"


def test_latest_experiment_needs_pattern_and_metadata(spark):
    mv = spark.createDataFrame([
        ("m", "churn_model_20240101_000000", True, {}, ["a"]),
        ("m", "churn_model_20240102_000000", False, {}, ["a"]),   # half-written
        ("m", "churn_model_20240103", True, {}, ["a"]),           # malformed
    ], MV)
    assert lc.latest_experiment(mv).collect()[0]["model_version"] == "churn_model_20240101_000000"


def test_promotion_gate_branches(spark):
    a, ab = ["f1", "f2"], ["f1", "f2", "f3"]
    mv = spark.createDataFrame([
        ("first", "churn_model_20240101_000000", True, {"pr_auc": 0.5}, a),
        ("removed", "churn_model_20240101_000000", True, {"pr_auc": 0.9}, ["f1"]),
        ("nometric", "churn_model_20240101_000000", True, {"roc_auc": 0.9}, a),
        ("better", "churn_model_20240101_000000", True, {"pr_auc": 0.8}, a),
        ("same", "churn_model_20240101_000000", True, {"pr_auc": 0.7}, a),
        ("added", "churn_model_20240101_000000", True, {"pr_auc": 0.9}, ab),
        ("none", "bad_name", True, {"pr_auc": 0.9}, a),
    ], MV)
    cp = spark.createDataFrame([(n, "churn_model_20230101_000000", {"pr_auc": 0.7}, a)
                                for n in ["removed", "nometric", "better", "same", "added", "none"]], CP)
    gate = lc.promotion_gate(mv, lc.latest_experiment(mv), cp)
    got = {r["model_name"]: (r["reason"], r["decision"]) for r in gate.collect()}
    assert got == {
        "first": ("first_deployment", "promote"), "removed": ("removed_features", "reject"),
        "nometric": ("metric_missing", "reject"), "better": ("improved", "promote"),
        "same": ("not_improved", "retain"), "added": ("improved", "promote"), "none": ("no_experiment", "reject"),
    }
    check = {r["model_name"]: (r["promoted"], r["refusal"]) for r in lc.promotion_check(gate).collect()}
    assert check["added"] == (False, "schema_mismatch")     # added features pass the gate, fail the ordered check
    assert check["better"] == (True, None) and check["first"] == (True, None)


def test_min_improvement_margin(spark):
    mv = spark.createDataFrame([("m", "churn_model_20240101_000000", True, {"pr_auc": 0.72}, ["a"])], MV)
    cp = spark.createDataFrame([("m", "old", {"pr_auc": 0.7}, ["a"])], CP)
    gate = lc.promotion_gate(mv, lc.latest_experiment(mv), cp, min_improvement=0.05)
    assert gate.collect()[0]["decision"] == "retain"


def test_previous_version_skips_repeats_and_rollback_reasons(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    lineage = spark.createDataFrame([
        ("m", "v1", t(1), 1), ("m", "v2", t(2), 2), ("m", "v2", t(3), 3),   # repeats of current
        ("single", "v1", t(1), 1), ("single", "v1", t(2), 2),
        ("short", "v1", t(1), 1),
        ("gone", "v1", t(1), 1), ("gone", "v2", t(2), 2),
    ], "model_name string, model_version string, ts timestamp, seq bigint")
    prev = {r["model_name"]: r["previous_version"] for r in lc.previous_version(lineage).collect()}
    assert prev == {"m": "v1", "single": None, "short": None, "gone": "v1"}
    health = spark.createDataFrame([("m", True), ("single", True), ("short", True), ("gone", True), ("ok", False)],
                                   "model_name string, retraining_recommended boolean")
    bundles = spark.createDataFrame([("m", "v1")], "model_name string, model_version string")
    rb = {r["model_name"]: r["reason"] for r in lc.rollback_target(health, lineage, bundles).collect()}
    assert rb == {"m": "rollback", "single": "single_version", "short": "no_history", "gone": "bundle_missing",
                  "ok": "healthy"}


OUT = "id bigint, created_at timestamp, event_type string, payload string, processed_at timestamp, claimed_at timestamp, attempts int"


def _outbox(spark, n=10, attempts=0):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(seconds=i), "e", "{}", None, None, attempts)
                                  for i in range(n)], OUT)


def test_claims_are_disjoint_and_ordered(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    first, after = ob.claim_batch(_outbox(spark), now, limit=4)
    second, _ = ob.claim_batch(after, now + F.expr("INTERVAL 1 SECOND"), limit=4)
    a = sorted(r["id"] for r in first.collect())
    b = sorted(r["id"] for r in second.collect())
    assert a == [0, 1, 2, 3] and b == [4, 5, 6, 7]
    assert all(r["attempts"] == 1 for r in first.collect())


def test_exhausted_never_claimed_and_settle(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    claimed, _ = ob.claim_batch(_outbox(spark, attempts=5), now)
    assert claimed.count() == 0
    assert ob.dead_letters(_outbox(spark, attempts=5)).count() == 10
    claimed, after = ob.claim_batch(_outbox(spark, 4), now)
    results = claimed.select("id", (F.col("id") % 2 == 0).alias("ok"))
    settled = {r["id"]: r for r in ob.settle(after, results, now).collect()}
    assert settled[0]["processed_at"] is not None and settled[0]["claimed_at"] is not None
    assert settled[1]["processed_at"] is None and settled[1]["claimed_at"] is None   # released
    again, _ = ob.claim_batch(ob.settle(after, results, now), now)
    assert sorted(r["id"] for r in again.collect()) == [1, 3]                         # processed not repeated
    empty, _ = ob.claim_batch(_outbox(spark, 0), now)
    assert empty.count() == 0


def test_histogram_quantile(spark):
    # 100 observations: 50 in (0, 0.1], 50 in (0.1, 0.25]
    cums = [0, 0, 0, 0, 50, 100, 100, 100, 100, 100, 100]
    df = spark.createDataFrame([(cums,)], "c array<bigint>")
    p95 = df.select(tr.histogram_quantile(0.95, F.col("c"), [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2, 5]))
    assert p95.collect()[0][0] == pytest.approx(0.1 + 0.15 * (95 - 50) / 50)


def test_sustained_islands_break_on_gap(spark):
    hrs = [0, 1, 2, 4, 5, 9]
    rows = [(dt.datetime(2024, 1, 1, h), h != 5) for h in hrs]
    w = spark.createDataFrame(rows, "window_start timestamp, alert boolean").withColumn("series", F.lit("s"))
    runs = sorted((r["windows"], r["fired"]) for r in tr.sustained(w, ["series"], "window_start", F.col("alert"),
                                                                     3600, 7200).collect())
    assert runs == [(1, False), (1, False), (3, True)]


def test_sustained_on_sliding_windows(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, m), m not in (3, 14)) for m in range(20)]
    w = spark.createDataFrame(rows, "window_start timestamp, alert boolean").withColumn("series", F.lit("s"))
    runs = tr.sustained(w, ["series"], "window_start", F.col("alert"), 300, 600, slide_seconds=60)
    got = sorted((r["windows"], r["fired"], r["run_end"].minute) for r in runs.collect())
    assert got == [(3, False, 7), (5, False, 24), (10, True, 18)]


def test_lineage_rows_go_on_from_the_last(spark):
    a = ["f1"]
    mv = spark.createDataFrame([("m", "churn_model_20240101_000000", True, {"pr_auc": 0.8}, a),
                                ("n", "churn_model_20240101_000000", True, {"pr_auc": 0.5}, a)], MV)
    gate = lc.promotion_gate(mv, lc.latest_experiment(mv), spark.createDataFrame([("m", "v0", {"pr_auc": 0.7}, a)], CP))
    lineage = spark.createDataFrame([("m", "v0", 4)], "model_name string, model_version string, seq bigint")
    rows = {r["model_name"]: r for r in lc.lineage_record(lc.promotion_check(gate), lineage, F.lit("2024-01-01").cast("timestamp"),
                                                          F.lit("set")).collect()}
    assert (rows["m"]["seq"], rows["m"]["parent_model"], rows["m"]["metrics"], rows["m"]["dataset"]) == (5, "v0", {"pr_auc": 0.8}, "set")
    assert rows["n"]["seq"] == 1 and rows["n"]["parent_model"] is None
