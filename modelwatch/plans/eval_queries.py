"""Evaluation (T6–T12), tenure split (G1) and event-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.operators import evaluate as ev
from modelwatch.operators import events as evt
from modelwatch.operators.ordered import ranking_metrics, temporal_split as _split
from modelwatch.plans.monitor_queries import _LABELLED, _LATEST, _labelled, _round_all
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.sources import bindings as b

_TS = "yyyy-MM-dd HH:mm:ss"
_DTS = "'%Y-%m-%d %H:%M:%S'"
_LAB = dict(extra=[("latest", _LATEST), ("labelled", _LABELLED),
                   ("lab", "SELECT * FROM labelled WHERE label IS NOT NULL")])


def _ts(c: str):
    return F.date_format(c, _TS)


# ------------------------------------------------------------------ evaluation

@query("classification_metrics", with_bindings(
    """SELECT model_version, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
              CAST(tn AS BIGINT) AS tn,
              round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy,
              round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
              round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
              round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
       FROM (SELECT model_version,
                    count(*) FILTER (WHERE probability > 0.5 AND label = 1) AS tp,
                    count(*) FILTER (WHERE probability > 0.5 AND label <> 1) AS fp,
                    count(*) FILTER (WHERE probability <= 0.5 AND label = 1) AS fn,
                    count(*) FILTER (WHERE probability <= 0.5 AND label <> 1) AS tn
             FROM lab GROUP BY model_version)""",
    "prediction_events", "feedback", **_LAB))
def classification_metrics(spark, sf_dir):
    """T8 per model version at the model's own 0.5 cut (p > 0.5)."""
    return _round_all(ev.classification_metrics(_labelled(spark, sf_dir), by=["model_version"]))


_AUC_SQL = """SELECT model_version,
       round((sum(ar) FILTER (WHERE label = 1) - P * (P + 1) / 2.0) / (P * N), 6) AS roc_auc,
       CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives
  FROM (SELECT model_version, label,
               rank() OVER (PARTITION BY model_version ORDER BY probability)
               + (count(*) OVER (PARTITION BY model_version, probability) - 1) / 2.0 AS ar,
               count(*) FILTER (WHERE label = 1) OVER (PARTITION BY model_version) AS P,
               count(*) FILTER (WHERE label <> 1) OVER (PARTITION BY model_version) AS N
        FROM {src})
  GROUP BY model_version, P, N"""

_AP_SQL = """SELECT model_version, round(sum(pos * tp / k) / sum(pos), 6) AS pr_auc
  FROM (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS k
        FROM (SELECT model_version, probability, count(*) FILTER (WHERE label = 1) AS pos,
                     count(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY model_version, probability)
        WINDOW w AS (PARTITION BY model_version ORDER BY probability DESC ROWS UNBOUNDED PRECEDING))
  GROUP BY model_version"""


@query("roc_auc", with_bindings(_AUC_SQL.format(src="lab"), "prediction_events", "feedback", **_LAB))
def roc_auc(spark, sf_dir):
    """Tie-correct ROC-AUC per model version (bucketed prefix sums)."""
    m = ranking_metrics(_labelled(spark, sf_dir), by=["model_version"])
    return _round_all(m.select("model_version", "roc_auc", "positives", "negatives"))


@query("average_precision", with_bindings(_AP_SQL.format(src="lab"), "prediction_events", "feedback", **_LAB))
def average_precision(spark, sf_dir):
    """Average precision (step sum over descending distinct scores) per model version."""
    m = ranking_metrics(_labelled(spark, sf_dir), by=["model_version"])
    return _round_all(m.select("model_version", "pr_auc"))


@query("ranking_documents", with_bindings(
    f"""SELECT a.model_version, a.roc_auc, p.pr_auc FROM ({_AUC_SQL.format(src='dl')}) a
        JOIN ({_AP_SQL.format(src='dl')}) p USING (model_version)""",
    "document_scores", extra=[("dl", "SELECT * FROM document_scores WHERE label IS NOT NULL")]))
def ranking_documents(spark, sf_dir):
    """T9 + T10 of the document scores against the quality labels, per language."""
    m = ranking_metrics(b.document_scores(spark, sf_dir), by=["model_version"])
    return _round_all(m.select("model_version", "roc_auc", "pr_auc"))


@query("leaderboard", with_bindings(
    f"""SELECT model_version, roc_auc, pr_auc,
               CAST(row_number() OVER (ORDER BY pr_auc DESC NULLS LAST, model_version) AS INTEGER) AS rank,
               row_number() OVER (ORDER BY pr_auc DESC NULLS LAST, model_version) = 1 AS is_winner
        FROM ({_AUC_SQL.format(src='lab')}) a JOIN ({_AP_SQL.format(src='lab')}) p USING (model_version)""",
    "prediction_events", "feedback", **_LAB))
def leaderboard(spark, sf_dir):
    """Candidates (model versions) ranked by PR-AUC; ties by name."""
    m = ranking_metrics(_labelled(spark, sf_dir), by=["model_version"])
    m = _round_all(m.select("model_version", "roc_auc", "pr_auc"))
    out = ev.leaderboard(m, "model_version", "pr_auc")
    return out.withColumn("rank", F.col("rank").cast("int"))


@query("acceptance", with_bindings(
    f"""SELECT s.model_version, CAST(s.bad AS BIGINT) AS bad_scores, a.roc_auc,
               s.bad = 0 AND coalesce(a.auc_raw > 0.55, false) AS accepted
        FROM (SELECT model_version, count(*) FILTER (WHERE probability IS NULL OR isnan(probability)
                     OR probability < 0 OR probability > 1) AS bad FROM labelled GROUP BY model_version) s
        LEFT JOIN (SELECT *, roc_auc AS auc_raw FROM ({_AUC_SQL.format(src='lab')})) a USING (model_version)""",
    "prediction_events", "feedback", **_LAB))
def acceptance(spark, sf_dir):
    """T12 per model version: scores within [0, 1] and ROC-AUC above the floor."""
    out = ev.acceptance(_labelled(spark, sf_dir), by=["model_version"])
    return out.select("model_version", "bad_scores", F.round("roc_auc", 6).alias("roc_auc"), "accepted")


@query("target_distribution", with_bindings(
    "SELECT churn_value, CAST(count(*) AS BIGINT) AS rows FROM customer_contract GROUP BY churn_value",
    "customer_contract"))
def target_distribution(spark, sf_dir):
    """T6 on the customer contract."""
    return ev.target_distribution(b.customer_contract(spark, sf_dir), "churn_value")


_SPLIT_CTE = [("sp", """SELECT *, CASE WHEN row_number() OVER (ORDER BY tenure_months, customer_id)
                                         <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
                       FROM customer_contract""")]


@query("temporal_split", with_bindings(
    "SELECT customer_id, tenure_months, split FROM sp", "customer_contract", extra=_SPLIT_CTE))
def temporal_split(spark, sf_dir):
    """G1: the first 80 % by tenure (ties by customer id) train, the rest test."""
    return _split(b.customer_contract(spark, sf_dir)).select("customer_id", "tenure_months", "split")


@query("split_summary", with_bindings(
    """SELECT s.split, s.column_name, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
              CAST(count(value) AS BIGINT) AS n, any_value(r.range_min) AS range_min, any_value(r.range_max) AS range_max
       FROM (SELECT split, 'tenure_months' AS column_name, CAST(tenure_months AS DOUBLE) AS value FROM sp
             UNION ALL SELECT split, 'monthly_charges', monthly_charges FROM sp
             UNION ALL SELECT split, 'balance', balance FROM sp) s
       JOIN (SELECT split, min(tenure_months) AS range_min, max(tenure_months) AS range_max FROM sp GROUP BY split) r
         USING (split)
       GROUP BY s.split, s.column_name""", "customer_contract", extra=_SPLIT_CTE))
def split_summary(spark, sf_dir):
    """Train / test summary of three numerics and the tenure range."""
    sp = _split(b.customer_contract(spark, sf_dir))
    return _round_all(ev.split_summary(sp, "split", ["tenure_months", "monthly_charges", "balance"], "tenure_months"))


# ---------------------------------------------------------------- event table

@query("attach_labels", with_bindings(
    f"""SELECT request_id, model_version, label, strftime(labeled_at, {_DTS}) AS labeled_at FROM labelled""",
    "prediction_events", "feedback", extra=[("latest", _LATEST), ("labelled", _LABELLED)]))
def attach_labels(spark, sf_dir):
    """Latest valid label per request id attached to every event."""
    out = _labelled(spark, sf_dir)
    return out.select("request_id", "model_version", "label", _ts("labeled_at").alias("labeled_at"))


@query("feedback_outcome", with_bindings(
    """SELECT CASE WHEN f.label NOT IN (0, 1) OR f.label IS NULL THEN 'invalid'
                   WHEN e.request_id IS NOT NULL THEN 'recorded' ELSE 'unknown' END AS outcome,
              CAST(count(*) AS BIGINT) AS submissions
       FROM feedback f LEFT JOIN (SELECT DISTINCT request_id FROM prediction_events) e USING (request_id)
       GROUP BY 1""", "prediction_events", "feedback"))
def feedback_outcome(spark, sf_dir):
    """Label submissions that matched an event, matched none, or were invalid."""
    return evt.feedback_outcome(b.feedback(spark, sf_dir), b.prediction_events(spark, sf_dir))


@query("labelled_events", with_bindings(
    f"""SELECT request_id, strftime(created_at, {_DTS}) AS created_at, label FROM labelled WHERE label IS NOT NULL""",
    "prediction_events", "feedback", extra=[("latest", _LATEST), ("labelled", _LABELLED)]))
def labelled_events(spark, sf_dir):
    """Events with ground truth, oldest first."""
    out = evt.labelled_events(_labelled(spark, sf_dir))
    return out.select("request_id", _ts("created_at").alias("created_at"), "label")


@query("recent_events", with_bindings(
    f"""SELECT request_id, strftime(created_at, {_DTS}) AS created_at, probability
        FROM (SELECT * FROM prediction_events ORDER BY created_at DESC, request_id DESC LIMIT 100)""",
    "prediction_events"))
def recent_events(spark, sf_dir):
    """A5 with a limit: the newest 100 events (a top-k read), returned oldest first."""
    out = evt.recent_events(b.prediction_events(spark, sf_dir), 100)
    return out.select("request_id", _ts("created_at").alias("created_at"), "probability")


@query("flatten_events", with_bindings(
    f"""SELECT feature_k AS k, feature_value AS value, request_id, strftime(created_at, {_DTS}) AS timestamp,
               probability AS prediction_probability, prediction, round(latency_seconds, 6) AS latency_seconds,
               model_version
        FROM prediction_events""", "prediction_events"))
def flatten_events(spark, sf_dir):
    """A5: the features document as columns plus the renamed event fields."""
    pe = b.prediction_events(spark, sf_dir)
    keys = evt.document_keys(pe)
    out = evt.flatten_events(pe, keys)
    return out.withColumn("timestamp", _ts("timestamp")).withColumn("latency_seconds", F.round("latency_seconds", 6))


# Fixed values of the binding: contract columns dropped by redaction in production rows.
_REDACTED = ["customer_id", "country"]


@query("retraining_union", with_bindings(
    """SELECT * FROM customer_contract WHERE tenure_months >= 12
       UNION ALL
       SELECT NULL AS customer_id, NULL AS country, segment, tenure_months, monthly_charges, total_charges, balance,
              label AS churn_value
       FROM (SELECT *, CASE WHEN balance >= 0 THEN churn_value END AS label FROM customer_contract WHERE tenure_months < 12)
       WHERE label IS NOT NULL""", "customer_contract"))
def retraining_union(spark, sf_dir):
    """H1: long-standing customers as the base plus labelled, redacted newer customers."""
    cc = b.customer_contract(spark, sf_dir)
    base = cc.where("tenure_months >= 12")
    prod = (cc.where("tenure_months < 12").drop(*_REDACTED)
            .withColumn("churn_value", F.when(F.col("balance") >= 0, F.col("churn_value"))))
    return evt.retraining_union(base, prod, "churn_value")


@query("number_batch", with_bindings(
    """SELECT CAST(row_number() OVER (ORDER BY created_at, event_id) - 1 AS BIGINT) AS index,
              'batch-' || CAST(row_number() OVER (ORDER BY created_at, event_id) - 1 AS VARCHAR) AS request_id,
              round(probability, 4) AS probability, event_id, model_version
       FROM prediction_events""", "prediction_events"))
def number_batch(spark, sf_dir):
    """Numbered batch output in event order (no single-task window)."""
    pe = b.prediction_events(spark, sf_dir).select("event_id", "created_at", "model_version", "probability", "request_id")
    out = evt.number_batch(pe, ["created_at", "event_id"])
    return out.select("index", "request_id", "probability", "event_id", "model_version")


@query("outbox_records", with_bindings(
    f"""SELECT 'prediction_made' AS event_type, request_id, strftime(created_at, {_DTS}) AS created_at, model_version,
               probability, prediction, CAST(NULL AS INTEGER) AS label FROM prediction_events
        UNION ALL
        SELECT 'prediction_labeled', request_id, strftime(labeled_at, {_DTS}), NULL, NULL, NULL, label FROM feedback""",
    "prediction_events", "feedback"))
def outbox_records(spark, sf_dir):
    """One outbox record per prediction and per label submission, its payload parsed back."""
    out = evt.outbox_records(b.prediction_events(spark, sf_dir), b.feedback(spark, sf_dir))
    body = F.from_json("payload", "request_id string, model_version string, probability double, prediction int, label int")
    return out.select("event_type", _ts("created_at").alias("created_at"), body.alias("p")).select("event_type", "created_at", "p.*")


@query("label_rejects", with_bindings(
    f"""SELECT request_id, label, strftime(labeled_at, {_DTS}) AS labeled_at FROM feedback WHERE label IS NULL OR label NOT IN (0, 1)""",
    "feedback"))
def label_rejects(spark, sf_dir):
    """Label submissions outside {0, 1}."""
    return evt.rejected_labels(b.feedback(spark, sf_dir)).select("request_id", "label", _ts("labeled_at").alias("labeled_at"))
