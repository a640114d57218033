"""Quality, calibration and ordered-sum operators against hand values and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import calibration as cal
from modelwatch.operators import ordered, quality


def test_missing_ratios(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (float("nan"), "c")], "x double, s string")
    got = {r["column_name"]: r["missing_ratio"] for r in quality.missing_ratios(df).collect()}
    assert got == {"x": round(2 / 3, 6), "s": round(1 / 3, 6)}


def test_iqr_extremes_counted(spark):
    rng = np.random.default_rng(0)
    vals = [float(v) for v in rng.normal(50, 5, 200)] + [500.0, -500.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = quality.iqr_outliers(df).collect()[0]
    q1, q3 = np.percentile(vals, [25, 75])
    assert r["lower_bound"] == round(q1 - 1.5 * (q3 - q1), 4)
    assert r["outlier_count"] >= 2
    assert r["outlier_ratio"] == round(r["outlier_count"] / len(vals), 6)


def test_category_changes(spark):
    ref = spark.createDataFrame([("A",), ("B",), ("C",)], "c string")
    prod = spark.createDataFrame([("A",), ("B",), ("D",)], "c string")
    got = {(r["category"], r["change"]) for r in quality.category_changes(prod, ref).collect()}
    assert got == {("D", "new"), ("C", "missing")}
    s = quality.category_summary(prod, ref).collect()[0]
    assert (s["production_cardinality"], s["reference_cardinality"], s["new_count"], s["missing_count"]) == (3, 3, 1, 1)


def test_schema_drift_columns(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    c = spark.createDataFrame([(1, 2)], "a int, c int")
    assert quality.schema_drift(a, c) == (["b"], ["c"])


def _p(spark, ps, labels=None):
    if labels is None:
        return spark.createDataFrame([(float(p),) for p in ps], "probability double")
    return spark.createDataFrame([(float(p), int(y)) for p, y in zip(ps, labels)], "probability double, label int")


def test_ece_overconfident(spark):
    ps = [0.9] * 100
    ys = [1, 0] * 50
    e = cal.ece(_p(spark, ps, ys)).collect()[0]["ece"]
    assert e > 0.3 and e == pytest.approx(0.4, abs=1e-12)


def test_ece_probability_one_in_no_bin(spark):
    e = cal.ece(_p(spark, [1.0, 0.05], [1, 0])).collect()[0]
    # p = 1.0 is outside every bin but counts in N
    assert e["n_labelled"] == 2 and e["ece"] == pytest.approx(0.05 / 2)


def test_entropy_bounds(spark):
    decisive = cal.entropy(_p(spark, [0.001, 0.999] * 10)).collect()[0][0]
    uncertain = cal.entropy(_p(spark, [0.5, 0.49, 0.51] * 10)).collect()[0][0]
    assert decisive < 0.2 and uncertain > 0.9


def _np_gini(p):
    p = np.sort(np.asarray(p, float))
    n = len(p)
    return 2 * np.sum(np.cumsum(p)) / (n * np.sum(p)) - (n + 1) / n


def test_gini_values(spark):
    assert ordered.gini_spread(_p(spark, [0.9] * 20)).collect()[0]["gini"] == pytest.approx(_np_gini([0.9] * 20), abs=1e-12)
    two = [0.1] * 50 + [0.9] * 50
    assert ordered.gini_spread(_p(spark, two)).collect()[0]["gini"] == pytest.approx(-0.4, abs=1e-12)
    rng = np.random.default_rng(3)
    r = np.round(rng.random(500), 2).tolist()
    assert ordered.gini_spread(_p(spark, r)).collect()[0]["gini"] == pytest.approx(_np_gini(r), abs=1e-12)


def test_gini_empty_is_zero(spark):
    assert ordered.gini_spread(_p(spark, [])).collect()[0]["gini"] == 0.0


def _brute_auc(p, y):
    pos = [a for a, b in zip(p, y) if b == 1]
    neg = [a for a, b in zip(p, y) if b != 1]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ap(p, y):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(p, y) if a >= t and b == 1)
        k = sum(1 for a in p if a >= t)
        r = tp / P
        ap += (r - prev_r) * (tp / k)
        prev_r = r
    return ap


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random(300), 1).tolist()
    y = [int(rng.random() < q) for q in p]
    r = ordered.ranking_metrics(_p(spark, p, y)).collect()[0]
    assert r["roc_auc"] == pytest.approx(_brute_auc(p, y), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(_brute_ap(p, y), abs=1e-12)


def test_ranking_one_class_and_all_equal(spark):
    r = ordered.ranking_metrics(_p(spark, [0.2, 0.4], [1, 1])).collect()[0]
    assert r["roc_auc"] is None and r["pr_auc"] == pytest.approx(1.0)
    r = ordered.ranking_metrics(_p(spark, [0.5] * 4, [1, 0, 1, 0])).collect()[0]
    assert r["roc_auc"] == pytest.approx(0.5) and r["pr_auc"] == pytest.approx(0.5)


def test_temporal_split_matches_sort(spark):
    rows = [(f"C{i:03d}", int(t)) for i, t in enumerate(np.random.default_rng(2).integers(0, 5, 103))]
    df = spark.createDataFrame(rows, "customer_id string, tenure_months bigint")
    got = {r["customer_id"]: r["split"] for r in ordered.temporal_split(df).collect()}
    srt = sorted(rows, key=lambda r: (r[1], r[0]))
    k = int(0.8 * len(rows))
    want = {cid: ("train" if i < k else "test") for i, (cid, _) in enumerate(srt)}
    assert got == want


@pytest.mark.parametrize("fraction", [0.0, 0.37, 0.8, 1.0])
def test_temporal_split_keeps_every_row(spark, fraction):
    rng = np.random.default_rng(3)
    rows = [(None if i % 9 == 0 else f"customer-{i % 40:06d}", None if rng.random() < 0.15 else int(rng.choice([1, 1, 1, 2, 7])), i)
            for i in range(211)]
    df = spark.createDataFrame(rows, "customer_id string, tenure_months bigint, i int")
    got = ordered.temporal_split(df, fraction=fraction).collect()
    assert sorted(r["i"] for r in got) == list(range(211))
    k = int(fraction * 211)
    train = [r for r in got if r["split"] == "train"]
    assert len(train) == k
    place = lambda r: (r["tenure_months"] is None, r["tenure_months"] or 0, r["customer_id"] is None, r["customer_id"] or "")
    rest = [r for r in got if r["split"] == "test"]
    assert not train or not rest or max(map(place, train)) <= min(map(place, rest))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(v)) for g, n in (("a", 301), (None, 40), ("one", 1)) for v in np.round(rng.exponential(1, n), 1)]
    df = spark.createDataFrame(rows + [("a", None), ("a", float("nan"))], "g string, v double")
    got = {r["g"]: r for r in ordered.quantiles(df, "v", {"low": 0.05, "mid": 0.5, "high": 0.95}, ["g"]).collect()}
    for g in ("a", None, "one"):
        want = np.quantile([v for h, v in rows if h == g], [0.05, 0.5, 0.95])
        assert [got[g][c] for c in ("low", "mid", "high")] == pytest.approx(list(want))
    whole = ordered.quantiles(df, "v", {"mid": 0.5}).collect()
    assert whole[0]["mid"] == pytest.approx(np.median([v for _, v in rows]))


def test_ranking_with_bunched_scores_and_null_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(None if i % 3 else "g", float(min(1, abs(rng.normal(0, 1e-6)))), int(rng.random() < 0.4)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, probability double, label int")
    got = {r["g"]: r for r in ordered.ranking_metrics(df, by=["g"]).collect()}
    for g in (None, "g"):
        p, y = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        assert got[g]["roc_auc"] == pytest.approx(_brute_auc(p, y), abs=1e-12)
        assert got[g]["pr_auc"] == pytest.approx(_brute_ap(p, y), abs=1e-12)


def test_class_balance_alert(spark):
    r = cal.class_balance(_p(spark, [0.9] * 8 + [0.1] * 2), reference_rate=0.5).collect()[0]
    assert r["predicted_positive_rate"] == pytest.approx(0.8) and r["shift_alert"]


def test_permutation_attribution_telescopes_and_matches_linear(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from modelwatch.operators import attribution as at

    rng = np.random.default_rng(4)
    rows = [(f"r{i}", float(a), float(b), float(a + b + rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))]
    df = spark.createDataFrame(rows, "id string, a double, b double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LogisticRegression(labelCol="y")]).fit(df)
    bg = df.limit(1)                      # one background row: every sample uses it
    imp, per = at.permutation_attribution(df.limit(20), bg, model, "id", ["a", "b"], repeats=3, output="logit")
    got = {(r["id"], r["feature"]): r["impact"] for r in imp.collect()}
    coef = model.stages[-1].coefficients
    b0 = bg.collect()[0]
    for r in df.limit(20).collect():
        assert got[(r["id"], "a")] == pytest.approx(coef[0] * (r["a"] - b0["a"]), abs=1e-9)
        assert got[(r["id"], "b")] == pytest.approx(coef[1] * (r["b"] - b0["b"]), abs=1e-9)
    # probabilities: base + sum of impacts = f(x) exactly
    imp, per = at.permutation_attribution(df.limit(20), df.limit(50), model, "id", ["a", "b"], repeats=5)
    sums = {r["id"]: r["s"] for r in imp.groupBy("id").agg(F.sum("impact").alias("s")).collect()}
    for r in per.collect():
        assert r["base_value"] + sums[r["id"]] == pytest.approx(r["prediction"], abs=1e-12)


def test_permutation_attribution_scores_each_coalition_once(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from modelwatch.operators import attribution as at

    df = spark.createDataFrame([(f"r{i}", float(i % 5), float(i % 3), float(i % 2)) for i in range(60)], "id string, a double, b double, y double")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression(labelCol="y")]).fit(df)
    scored = []

    class Model:
        def transform(self, rows):
            scored.append(rows.count())
            return fitted.transform(rows)

    imp, per = at.permutation_attribution(df.limit(20), df.limit(7), Model(), "id", ["a", "b"], repeats=4)
    assert sorted(scored) == [7, 20, 80]                    # background rows, rows, and the one coalition between per sample
    assert imp.count() == 40 and per.count() == 20
    for out in (imp, per):                                   # read back: nothing is scored again
        assert "UDF" not in out._jdf.queryExecution().executedPlan().toString()
    one = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), LogisticRegression(labelCol="y")]).fit(df)
    imp, per = at.permutation_attribution(df.limit(5), df.limit(1), one, "id", ["a"], repeats=2)
    whole = {r["id"]: r for r in per.collect()}
    assert len(whole) == 5
    for r in imp.collect():
        assert r["impact"] == pytest.approx(whole[r["id"]]["prediction"] - whole[r["id"]]["base_value"], abs=1e-12)


def test_the_calibration_report_is_its_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(p), int(y) if y >= 0 else None) for g, p, y in zip(
        rng.choice(["a", "b", None], 600), np.round(rng.beta(0.6, 0.6, 600), 2), rng.integers(-1, 2, 600))]
    rows += [("one", 0.9, 1)] * 5 + [("zero", 0.0, None)] * 3 + [("a", float("nan"), 1), ("b", None, 0), ("b", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, probability double, label int")
    valid = df.where("probability IS NOT NULL AND NOT isnan(probability)")
    parts = [cal.confidence_summary(df, by=["g"]), cal.entropy(df, by=["g"]), cal.ece(valid, by=["g"]).drop("n_labelled"),
             ordered.gini_spread(df, by=["g"]), cal.class_balance(df, by=["g"]).drop("predicted_negative_rate")]
    want: dict = {}
    for part in parts:
        for r in part.collect():
            want.setdefault(r["g"], {}).update(r.asDict())
    got = {r["g"]: r.asDict() for r in cal.calibration_report(df, by=["g"]).collect()}
    assert got.keys() == want.keys() == {"a", "b", None, "one", "zero"}
    for g, r in got.items():
        assert r["sample_size"] == sum(1 for x in rows if x[0] == g and x[1] is not None and x[1] == x[1])
        for c, v in r.items():
            if c not in ("g", "sample_size"):
                assert v == pytest.approx(want[g].get(c), abs=1e-9), (g, c)
    whole, summary = cal.calibration_report(df).first(), cal.confidence_summary(df).first()
    assert whole["median_confidence"] == pytest.approx(summary["median_confidence"]) and whole["sample_size"] == len(rows) - 2
    plain = cal.calibration_report(df, label=None, by=["g"])
    assert "ece" not in plain.columns and plain.count() == 5
    assert cal.calibration_report(df.limit(0)).first()["sample_size"] == 0
