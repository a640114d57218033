"""Scoring and attribution queries (S1–S6, T1–T5, T12, G3, G4, G8) with DuckDB twins where linear."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from modelwatch.operators import attribution as at
from modelwatch.operators import evaluate as ev
from modelwatch.operators import features as fe
from modelwatch.operators import jobs
from modelwatch.operators import train as tr
from modelwatch.operators.common import null_safe_join
from modelwatch.operators.contracts import ColumnSpec, Contract
from modelwatch.operators.events import decide
from modelwatch.operators.lifecycle import LINEAGE_SCHEMA
from modelwatch.operators.ordered import ranking_metrics
from modelwatch.params import DEFAULTS
from modelwatch.plans.contract_queries import _CHARGES_SQL
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.session import scratch_path
from modelwatch.sources import bindings as b
from modelwatch.sources.tables import read_or_empty

NUMERIC = ["tenure_months", "monthly_charges", "total_charges", "balance"]
CATEGORICAL = ["segment"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# Fixed values of the binding: a linear churn scorer over the built features
# (log-odds per unit; charges and balance in thousands).
INTERCEPT = 0.4
COEFFICIENTS = [
    ("tenure_months", -0.02),
    ("monthly_charges", 0.003),
    ("total_charges_k", -0.001),
    ("balance_k", -0.05),
]


def _features(spark, sf_dir):
    feats = fe.build_features(b.customer_contract(spark, sf_dir), "total_charges", None, ["country"])
    return feats.select("customer_id", "tenure_months", "monthly_charges", "churn_value", "segment",
                        (F.col("total_charges") / 1000.0).alias("total_charges_k"),
                        (F.col("balance") / 1000.0).alias("balance_k"))


_SCORED_FEATURES = ["tenure_months", "monthly_charges", "total_charges_k", "balance_k"]


_FEAT_SQL = """SELECT customer_id, CAST(tenure_months AS DOUBLE) AS tenure_months, monthly_charges,
       CASE WHEN regexp_matches(total_charges, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
            THEN CAST(trim(total_charges) AS DOUBLE) ELSE 0.0::DOUBLE END / 1000.0::DOUBLE AS total_charges_k,
       balance / 1000.0::DOUBLE AS balance_k
  FROM customer_contract"""
_COEF_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {c}::DOUBLE)" for f, c in COEFFICIENTS) + ") t(feature, beta)"
_LONG_SQL = " UNION ALL ".join(f"SELECT customer_id, '{f}' AS feature, {f} AS value FROM feats" for f in _SCORED_FEATURES)
_BG_SQL = "SELECT * FROM feats ORDER BY md5('42' || customer_id), customer_id LIMIT 100"
_ML_CTES = [("feats", _FEAT_SQL), ("coef", _COEF_SQL), ("long", _LONG_SQL), ("bg", _BG_SQL),
            ("bg_long", _LONG_SQL.replace("FROM feats", "FROM bg")),
            ("means", "SELECT feature, avg(value) AS bg_mean FROM bg_long WHERE value IS NOT NULL GROUP BY feature"),
            ("imp", """SELECT l.customer_id, l.feature, c.beta * (l.value - m.bg_mean) AS impact
                       FROM long l JOIN coef c USING (feature) JOIN means m USING (feature)""")]


@query("score_linear", with_bindings(
    f"""SELECT customer_id, round(logit, 8) AS logit, round(1 / (1 + exp(-logit)), 6) AS probability
        FROM (SELECT l.customer_id, {INTERCEPT}::DOUBLE + sum(c.beta * l.value) AS logit
              FROM long l JOIN coef c USING (feature) GROUP BY l.customer_id)""",
    "customer_contract", extra=_ML_CTES[:3]))
def score_linear(spark, sf_dir):
    """S3: linear scorer within each row, sigmoid of the logit."""
    out = tr.linear_score(_features(spark, sf_dir), dict(COEFFICIENTS), INTERCEPT, "customer_id")
    # the logit has at most 8 exact decimals: round there, not at a tie
    return out.select("customer_id", F.round("logit", 8).alias("logit"), F.round("probability", 6).alias("probability"))


@query("background_sample", with_bindings(
    "SELECT customer_id, tenure_months, round(monthly_charges, 6) AS monthly_charges FROM bg",
    "customer_contract", extra=_ML_CTES[:4]))
def background_sample(spark, sf_dir):
    """G8 + S6: 100 background rows, deterministic by ``md5(seed || id)``."""
    bg = at.background_sample(_features(spark, sf_dir), "customer_id")
    return bg.select("customer_id", F.col("tenure_months").cast("double").alias("tenure_months"),
                     F.round("monthly_charges", 6).alias("monthly_charges"))


def _attr(spark, sf_dir, only_background: bool = False):
    feats = _features(spark, sf_dir)
    background = at.background_sample(feats, "customer_id")
    return at.linear_attribution(background if only_background else feats, background, dict(COEFFICIENTS), INTERCEPT, "customer_id")


@query("attribution_linear", with_bindings(
    "SELECT customer_id, feature, round(impact, 6) AS impact FROM imp", "customer_contract", extra=_ML_CTES))
def attribution_linear(spark, sf_dir):
    """S4 (linear mode): per customer and feature the exact Shapley impact in log-odds."""
    impacts = at.impacts_long(_attr(spark, sf_dir), "customer_id", _SCORED_FEATURES)
    return impacts.select("customer_id", "feature", F.round("impact", 6).alias("impact"))


@query("attribution_check", with_bindings(
    f"""SELECT customer_id, round(base + s, 6) AS logit, round(base, 6) AS base_value
        FROM (SELECT customer_id, sum(impact) AS s FROM imp GROUP BY customer_id)
        JOIN (SELECT {INTERCEPT}::DOUBLE + sum(c.beta * m.bg_mean) AS base FROM coef c JOIN means m USING (feature)) ON TRUE""",
    "customer_contract", extra=_ML_CTES))
def attribution_check(spark, sf_dir):
    """Base value and base + Σ impact (equal to the model logit) per customer."""
    return _attr(spark, sf_dir).select("customer_id", F.round("logit", 6).alias("logit"), F.round("base_value", 6).alias("base_value"))


@query("top_drivers", with_bindings(
    """SELECT customer_id, side, CAST(rank AS INTEGER) AS rank, feature, impact FROM (
         SELECT customer_id, feature, impact, CASE WHEN impact > 0 THEN 'positive' ELSE 'negative' END AS side,
                row_number() OVER (PARTITION BY customer_id, impact > 0 ORDER BY abs(impact) DESC, feature) AS rank
         FROM (SELECT customer_id, feature, round(impact, 6) AS impact FROM imp) WHERE impact <> 0)
       WHERE rank <= 5""", "customer_contract", extra=_ML_CTES))
def top_drivers(spark, sf_dir):
    """Top 5 positive and top 5 negative drivers per customer by |impact|."""
    return at.top_drivers(_attr(spark, sf_dir), "customer_id", _SCORED_FEATURES)


@query("global_importance", with_bindings(
    """SELECT feature, round(m, 6) AS mean_abs_impact,
              CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank,
              CAST(count(*) OVER () AS BIGINT) AS total_features, count(*) OVER () > 50 AS truncated
       FROM (SELECT i.feature, avg(abs(i.impact)) AS m FROM imp i JOIN bg USING (customer_id) GROUP BY i.feature)""",
    "customer_contract", extra=_ML_CTES))
def global_importance(spark, sf_dir):
    """S5 + G4: mean |impact| over the background rows per feature (top 50, clamped 1..200)."""
    return at.global_importance(_attr(spark, sf_dir, only_background=True), _SCORED_FEATURES, 50)


# Fixed values of the binding: the training run's contract, name and time.
TRAINING = jobs.TrainingSpec(
    model_name="churn", key="customer_id", target="churn_value", order="tenure_months", charges="total_charges",
    numeric=NUMERIC, categorical=CATEGORICAL,
    contract=Contract({
        "customer_id": ColumnSpec("str"), "country": ColumnSpec("str"), "segment": ColumnSpec("str", allowed=tuple(SEGMENTS)),
        "tenure_months": ColumnSpec("int"), "monthly_charges": ColumnSpec("float"), "total_charges": ColumnSpec("float"),
        "balance": ColumnSpec("float"), "churn_value": ColumnSpec("int", allowed=(0, 1))}))
VERSION, CREATED_AT = "churn_model_20240201_000000", "2024-02-01 00:00:00"
_CANDIDATES = ["gradient_boosting", "logistic_regression", "random_forest"]
_runs: dict[tuple[str, str], str] = {}


def _trained(spark, sf_dir) -> str:
    """The job root of the one training run of this session and data: later queries load what it stored.

    The raw table is written first, as ingestion would; families without order history have 0.0 charges, and a few rows
    break the contract (an unknown segment, a missing balance) and end in quarantine.
    """
    seen = (spark.sparkContext.applicationId, sf_dir)
    if seen not in _runs:
        root = scratch_path(spark, f"jobs/{uuid.uuid4().hex}")
        _raw(spark, sf_dir).write.parquet(f"{root}/raw")
        jobs.training_run(spark, root, TRAINING, VERSION, CREATED_AT, f"{root}/raw", f"{root}/retraining")
        _runs[seen] = root
    return _runs[seen]


def _raw(spark, sf_dir):
    cc = b.customer_contract(spark, sf_dir).fillna({"monthly_charges": 0.0})
    k = F.substring("customer_id", 2, 64).cast("bigint")
    return (cc.withColumn("segment", F.when(k % 97 == 0, "UNKNOWN").otherwise(F.col("segment")))
            .withColumn("balance", F.when(k % 101 != 0, F.col("balance"))))


_GOOD_SQL = """SELECT * REPLACE (coalesce(monthly_charges, 0.0::DOUBLE) AS monthly_charges) FROM customer_contract
               WHERE CAST(substr(customer_id, 2) AS BIGINT) % 97 <> 0 AND CAST(substr(customer_id, 2) AS BIGINT) % 101 <> 0"""
_JOB_CTES = [("good", _GOOD_SQL),
             ("js", """SELECT *, CASE WHEN row_number() OVER (ORDER BY tenure_months, customer_id)
                                        <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM good""")]


@query("train_candidates", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', true, true)" for c in _CANDIDATES)
       + ") t(candidate, metrics_valid, ranked)")
def train_candidates(spark, sf_dir):
    """The leaderboard of the training run: every candidate with valid metrics and its own rank."""
    board = spark.read.parquet(f"{_trained(spark, sf_dir)}/leaderboard")
    valid = F.lit(True)
    for m in ("roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1"):
        valid = valid & (F.col(m) >= 0) & (F.col(m) <= 1)
    ahead = board.select(F.col("pr_auc").alias("other"), F.col("candidate").alias("name"))
    better = (board.join(ahead, (F.col("other") > F.col("pr_auc")) | ((F.col("other") == F.col("pr_auc")) & (F.col("name") < F.col("candidate"))), "left")
              .groupBy("candidate").agg(F.count("name").alias("better")))  # three candidates
    return board.join(better, "candidate").select(
        "candidate", valid.alias("metrics_valid"),
        ((F.col("rank") == F.col("better") + 1) & (F.col("is_winner") == (F.col("rank") == 1))).alias("ranked"))


@query("training_quarantine", with_bindings(
    """SELECT customer_id, 'segment' AS column_name, 'isin' AS check_name FROM customer_contract
       WHERE CAST(substr(customer_id, 2) AS BIGINT) % 97 = 0
       UNION ALL
       SELECT customer_id, 'balance', 'not_nullable' FROM customer_contract WHERE CAST(substr(customer_id, 2) AS BIGINT) % 101 = 0""",
    "customer_contract"))
def training_quarantine(spark, sf_dir):
    """B6 in the job: the rows kept out of the run, with the checks they break."""
    return spark.read.parquet(f"{_trained(spark, sf_dir)}/quarantine").select("customer_id", "column_name", "check_name")


@query("reference_snapshot", with_bindings(
    f"""SELECT tenure_months, round(monthly_charges, 6) AS monthly_charges, round({_CHARGES_SQL}, 6) AS total_charges,
               round(balance, 6) AS balance, segment FROM js WHERE split = 'train'""", "customer_contract", extra=_JOB_CTES))
def reference_snapshot(spark, sf_dir):
    """A3: the features the winner was fitted on, read back from the version's folder."""
    ref = spark.read.parquet(f"{_trained(spark, sf_dir)}/reference/model_version={VERSION}")
    return ref.select("tenure_months", *[F.round(c, 6).alias(c) for c in NUMERIC[1:]], "segment")


@query("experiment_rows", "SELECT 'churn' AS model_name, * FROM (VALUES " + ", ".join(
    f"('{VERSION}_{c}', 'pr_auc,roc_auc', '{','.join([*NUMERIC, *CATEGORICAL])}')" for c in _CANDIDATES)
       + ") t(model_version, metric_names, feature_schema)")
def experiment_rows(spark, sf_dir):
    """The experiment rows the run wrote, one per candidate."""
    rows = spark.read.parquet(f"{_trained(spark, sf_dir)}/experiments")
    return rows.select("model_name", "model_version", F.array_join(F.array_sort(F.map_keys("metrics")), ",").alias("metric_names"),
                       F.array_join("feature_schema", ",").alias("feature_schema"))


@query("lineage_rows", f"""SELECT 'churn' AS model_name, CAST(1 AS BIGINT) AS seq, 'training' AS "trigger", '{CREATED_AT}' AS ts,
                                  true AS is_winner, true AS has_metrics, true AS from_raw""")
def lineage_rows(spark, sf_dir):
    """L3 + A11: the winner's lineage row, read back and checked against the leaderboard."""
    root = _trained(spark, sf_dir)
    winner = spark.read.parquet(f"{root}/leaderboard").where("is_winner").select(
        F.concat(F.lit(f"{VERSION}_"), "candidate").alias("model_version"), F.lit(True).alias("won"))
    rows = read_or_empty(spark, f"{root}/lineage", LINEAGE_SCHEMA)
    return rows.join(winner, "model_version", "left").select(
        "model_name", "seq", "trigger", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.coalesce("won", F.lit(False)).alias("is_winner"), (F.size("metrics") == 2).alias("has_metrics"),
        F.col("dataset").endswith("/raw").alias("from_raw"))


def _scored(spark, sf_dir):
    """The customers scored with the stored model, once per session."""
    root = _trained(spark, sf_dir)
    rows = fe.build_features(_raw(spark, sf_dir).fillna({"balance": 0.0}), "total_charges", "churn_value", ["country"])
    return jobs.scoring_run(spark, root, TRAINING, VERSION, rows)


@query("batch_score", with_bindings(
    """SELECT CAST(row_number() OVER (ORDER BY customer_id) - 1 AS BIGINT) AS index,
              'batch-' || CAST(row_number() OVER (ORDER BY customer_id) - 1 AS VARCHAR) AS request_id, customer_id,
              true AS in_range, true AS decided FROM customer_contract""", "customer_contract"))
def batch_score(spark, sf_dir):
    """S1 + S2 + B14 + G7: the stored winner scores every customer, numbered in id order; decisions follow p >= 0.5."""
    p = F.col("raw_probability")
    return _scored(spark, sf_dir).select(
        "index", "request_id", "customer_id", p.between(0, 1).alias("in_range"),
        ((F.col("prediction") == decide("raw_probability")) & (F.col("probability") == F.round(p, 4))).alias("decided"))


def _test_scores(spark, sf_dir):
    root = _trained(spark, sf_dir)
    test = spark.read.parquet(f"{root}/prepared/model_version={VERSION}").where("split = 'test'")
    return tr.score(PipelineModel.load(f"{root}/models/{VERSION}"), test, keep=["customer_id", "churn_value"])


@query("acceptance_model", "SELECT CAST(0 AS BIGINT) AS bad_scores, true AS auc_valid, true AS consistent")
def acceptance_model(spark, sf_dir):
    """The stored winner's test scores: all in [0, 1], and accepted exactly if the ROC-AUC is above the floor."""
    out = ev.acceptance(_test_scores(spark, sf_dir), label="churn_value")
    return out.select("bad_scores", F.col("roc_auc").between(0, 1).alias("auc_valid"),
                      (F.col("accepted") == (F.col("roc_auc") > DEFAULTS.roc_auc_floor)).alias("consistent"))


@query("ranking_model", with_bindings(
    """SELECT CAST(count(*) FILTER (WHERE churn_value = 1) AS BIGINT) AS positives,
              CAST(count(*) FILTER (WHERE churn_value = 0) AS BIGINT) AS negatives, true AS valid, true AS as_stored
       FROM js WHERE split = 'test'""", "customer_contract", extra=_JOB_CTES))
def ranking_model(spark, sf_dir):
    """T9 + T10 of the reloaded winner on the test split: the same figures as at training time."""
    m = ranking_metrics(_test_scores(spark, sf_dir), label="churn_value")
    stored = spark.read.parquet(f"{_trained(spark, sf_dir)}/leaderboard").where("is_winner").select(
        F.col("roc_auc").alias("roc0"), F.col("pr_auc").alias("pr0"))
    return null_safe_join(m, stored, []).select(
        "positives", "negatives", (F.col("roc_auc").between(0, 1) & F.col("pr_auc").between(0, 1)).alias("valid"),
        ((F.abs(F.col("roc_auc") - F.col("roc0")) < 1e-9) & (F.abs(F.col("pr_auc") - F.col("pr0")) < 1e-9)).alias("as_stored"))


@query("attribution_permutation", with_bindings(
    "SELECT customer_id, feature, true AS adds_up FROM js, (VALUES " + ", ".join(f"('{f}')" for f in [*NUMERIC, *CATEGORICAL])
    + ") f(feature)", "customer_contract", extra=_JOB_CTES))
def attribution_permutation(spark, sf_dir):
    """S4 (any model): permutation Shapley impacts of the stored winner for every prepared customer, 8 samples
    each against the 100-row background; a row's impacts add up to prediction less base value."""
    root = _trained(spark, sf_dir)
    data = spark.read.parquet(f"{root}/prepared/model_version={VERSION}")
    background = at.background_sample(data.where("split = 'train'"), "customer_id")
    model = PipelineModel.load(f"{root}/models/{VERSION}")
    feats = [*NUMERIC, *CATEGORICAL]
    impacts, per_row = at.permutation_attribution(data, background, model, "customer_id", feats, repeats=8)
    sums = impacts.groupBy("customer_id").agg(F.sum("impact").alias("total"))
    ok = per_row.join(sums, "customer_id").select(
        "customer_id", (F.abs(F.col("base_value") + F.col("total") - F.col("prediction")) < 1e-9).alias("adds_up"))
    return impacts.select("customer_id", "feature").join(ok, "customer_id")
