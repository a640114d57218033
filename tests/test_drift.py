"""PSI and health: numeric invariants and a NumPy brute force of the same rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import drift


def _np_psi(expected, actual, bins=10):
    """Brute force written from the rule: NumPy edges, under/overflow slots, +0.5 smoothing."""
    e = np.asarray([x for x in expected if x is not None and not np.isnan(x)], float)
    a = np.asarray([x for x in actual if x is not None and not np.isnan(x)], float)
    ce, edges = np.histogram(e, bins=bins)
    ca, _ = np.histogram(a, bins=edges)
    ce = np.r_[0, ce, 0].astype(float)
    ca = np.r_[(a < edges[0]).sum(), ca, (a > edges[-1]).sum()].astype(float)
    pe = (ce + 0.5) / (ce.sum() + 0.5 * len(ce))
    pa = (ca + 0.5) / (ca.sum() + 0.5 * len(ca))
    return float(np.sum((pa - pe) * np.log(pa / pe)))


def _df(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "value double")


def test_identical_is_zero(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(0, 1, 1000).tolist()
    assert abs(drift.psi_of(_df(spark, x), _df(spark, x))) < 1e-9


def test_shift_detected_and_matches_numpy(spark):
    rng = np.random.default_rng(42)
    x, y = rng.normal(0, 1, 1000).tolist(), rng.normal(3, 1, 1000).tolist()
    got = drift.psi_of(_df(spark, x), _df(spark, y))
    assert got > 0.2
    assert got == pytest.approx(_np_psi(x, y), abs=1e-9)


@pytest.mark.parametrize("bins", [5, 10, 20, 50])
def test_bins_nonnegative_and_exact(spark, bins):
    rng = np.random.default_rng(7)
    x, y = rng.normal(0, 1, 500).tolist(), rng.normal(0.3, 1.2, 500).tolist()
    got = drift.psi_of(_df(spark, x), _df(spark, y), bins=bins)
    assert got >= 0
    assert got == pytest.approx(_np_psi(x, y, bins), abs=1e-9)


def test_values_on_floating_edges(spark):
    # every value of a 0.00..0.10 grid sits on an edge of linspace(0, 0.1, 11)
    grid = [round(i / 100, 2) for i in range(11)]
    x = grid * 30
    y = grid[3:] * 40 + [0.3, 0.6, 0.7]
    assert drift.psi_of(_df(spark, x), _df(spark, y)) == pytest.approx(_np_psi(x, y), abs=1e-12)


def test_out_of_range_mass_counts(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 1000).tolist()
    y = rng.normal(0, 1, 700).tolist() + [999999.0] * 300
    assert drift.psi_of(_df(spark, x), _df(spark, y)) > 0.2


def test_constant_column_is_zero(spark):
    assert drift.psi_of(_df(spark, [5.0] * 100), _df(spark, [5.0] * 100)) == pytest.approx(0.0, abs=1e-12)


def test_sparse_bins_small(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 4900).tolist() + rng.normal(8, 0.1, 100).tolist()
    y = rng.normal(0, 1, 4900).tolist() + rng.normal(8, 0.1, 100).tolist()
    assert drift.psi_of(_df(spark, x), _df(spark, y)) < 0.1


def test_empty_or_all_nan_side_raises(spark):
    with pytest.raises(ValueError):
        drift.psi_of(_df(spark, [1.0, 2.0]), _df(spark, [None, float("nan")]))
    with pytest.raises(ValueError):
        drift.psi_of(_df(spark, [float("nan")]), _df(spark, [1.0]))


def _long(spark, rows):
    return spark.createDataFrame(rows, "feature string, value double")


def test_health_verdicts(spark):
    rng = np.random.default_rng(42)
    ref = [("a", float(v)) for v in rng.normal(70, 20, 2000)] + [("b", float(v)) for v in rng.normal(2000, 800, 2000)]
    small = [("a", 70.0)] * 5 + [("b", 2000.0)] * 5
    stable = [("a", float(v)) for v in rng.normal(70, 20, 500)] + [("b", float(v)) for v in rng.normal(2000, 800, 500)]
    shifted = [("a", float(v) + 200) for v in rng.normal(70, 20, 500)] + [("b", float(v) + 5000) for v in rng.normal(2000, 800, 500)]

    def verdict(prod):
        r = drift.model_health(drift.drift_report(_long(spark, ref), _long(spark, prod))).collect()
        assert len(r) == 1
        return r[0]

    v = verdict(small)
    assert v["status"] == "insufficient_data" and not v["retraining_recommended"]
    assert v["skipped_features"] == "a,b"
    v = verdict(stable)
    assert v["status"] == "evaluated" and not v["retraining_recommended"] and v["evaluated_features"] == "a,b"
    v = verdict(shifted)
    assert v["retraining_recommended"] and v["drifting_feature_count"] == 2


def test_wide_and_long_paths_agree(spark):
    rng = np.random.default_rng(5)
    ref = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(0, 1, (300, 2))], "x double, y double")
    prod = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(0.5, 1, (300, 2))], "x double, y double")
    wide = drift.drift_report_wide(ref, prod, ["x", "y"]).orderBy("feature").collect()
    lref = ref.unpivot([], ["x", "y"], "feature", "value")
    lprod = prod.unpivot([], ["x", "y"], "feature", "value")
    long = drift.drift_report(lref, lprod).orderBy("feature").collect()
    assert [(r["feature"], round(r["psi"], 12), r["status"]) for r in wide] == \
           [(r["feature"], round(r["psi"], 12), r["status"]) for r in long]


def test_null_groups_and_groups_without_a_reference(spark):
    rows = lambda g, n, mu: [(g, float(v)) for v in np.random.default_rng(len(str(g))).normal(mu, 1, n)]
    ref = spark.createDataFrame(rows(None, 200, 0) + rows("a", 200, 0) + rows("old", 50, 0), "g string, x double")
    prod = spark.createDataFrame(rows(None, 100, 0) + rows("a", 100, 5) + rows("new", 30, 0), "g string, x double")
    for report in (drift.drift_report_wide(ref, prod, ["x"], ["g"]),
                   drift.drift_report(ref.unpivot("g", ["x"], "feature", "value"), prod.unpivot("g", ["x"], "feature", "value"), ["g"])):
        got = {r["g"]: r for r in report.collect()}
        assert got[None]["n_reference"] == 200 and got[None]["n_production"] == 100 and got[None]["status"] == "STABLE"
        assert got["a"]["status"] == "DRIFT" and got["old"]["status"] == "insufficient"
        assert (got["new"]["status"], got["new"]["n_production"], got["new"]["psi"]) == ("no_reference", 30, None)
        health = {r["g"]: r["status"] for r in drift.model_health(report, ["g"]).collect()}
        assert health == {None: "evaluated", "a": "evaluated", "old": "unknown", "new": "unknown"}
    known = spark.createDataFrame([("a",), ("never",)], "g string")
    verdict = {r["g"]: r["status"] for r in drift.with_unknown(known, drift.model_health(report, ["g"]), ["g"]).collect()}
    assert verdict == {"a": "evaluated", "never": "unknown"}
