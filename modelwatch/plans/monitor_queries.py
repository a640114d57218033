"""Quality (D1–D8) and calibration (F1–F9) queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.operators import calibration as cal
from modelwatch.operators import quality as q
from modelwatch.operators.common import r6
from modelwatch.operators.events import attach_labels
from modelwatch.operators.ordered import gini_spread as _gini
from modelwatch.params import CONFIDENCE_BUCKETS
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.sources import bindings as b

# customer_contract columns by kind (the by-column ``segment`` excluded)
_NUM = ["tenure_months", "monthly_charges", "balance", "churn_value"]
_DBL = {"monthly_charges", "balance"}
_STR = ["customer_id", "country", "total_charges"]
_ALL = ["customer_id", "country", "tenure_months", "monthly_charges", "total_charges", "balance", "churn_value"]


def _round_all(df, keep=()):
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in keep:
            out.append(r6(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- quality (D)

def _miss_union() -> str:
    parts = []
    for c in _ALL:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in _DBL else "")
        parts.append(f"SELECT segment, '{c}' AS column_name, CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM customer_contract")
    return " UNION ALL ".join(parts)


@query("missing_ratios", with_bindings(
    "SELECT segment, column_name, round(avg(m), 6) AS missing_ratio FROM miss GROUP BY segment, column_name",
    "customer_contract", extra=[("miss", _miss_union())]))
def missing_ratios(spark, sf_dir):
    """D1 per customer segment."""
    return q.missing_ratios(b.customer_contract(spark, sf_dir), ["segment"])


def _num_long(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT segment, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {src}" for c in _NUM)


_IQR_CTES = [
    ("prod", "SELECT * FROM customer_contract WHERE churn_value = 1"),
    ("ref_long", _num_long("customer_contract")),
    ("prod_long", _num_long("prod")),
    ("bounds", """SELECT segment, column_name,
                         quantile_cont(value, 0.25) - 1.5::DOUBLE * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
                         quantile_cont(value, 0.75) + 1.5::DOUBLE * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi
                  FROM ref_long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY segment, column_name"""),
    ("outl", """SELECT b.segment, b.column_name, any_value(b.lo) AS lo, any_value(b.hi) AS hi,
                       count(p.value) FILTER (WHERE p.value < b.lo OR p.value > b.hi) AS n_out,
                       count(p.value) AS n
                FROM bounds b LEFT JOIN prod_long p
                  ON p.segment = b.segment AND p.column_name = b.column_name
                 AND p.value IS NOT NULL AND NOT isnan(p.value)
                GROUP BY b.segment, b.column_name"""),
]


@query("iqr_outliers", with_bindings(
    """SELECT segment, column_name, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
              CAST(n_out AS BIGINT) AS outlier_count, round(n_out / greatest(n, 1), 6) AS outlier_ratio FROM outl""",
    "customer_contract", extra=_IQR_CTES))
def iqr_outliers(spark, sf_dir):
    """D2 + D3: churned customers against IQR bounds of the whole base, per segment."""
    cc = b.customer_contract(spark, sf_dir)
    return q.iqr_outliers(cc.where("churn_value = 1"), cc, ["segment"], _NUM, digits=6)


def _str_long(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT segment, '{c}' AS column_name, {c} AS category FROM {src} WHERE {c} IS NOT NULL" for c in _STR)


_CAT_CTES = [
    ("p", _str_long("(SELECT * FROM customer_contract WHERE churn_value = 1)")),
    ("r", _str_long("(SELECT * FROM customer_contract WHERE churn_value = 0)")),
    ("cats", """SELECT coalesce(p.segment, r.segment) AS segment, coalesce(p.column_name, r.column_name) AS column_name,
                       coalesce(p.category, r.category) AS category, p.category IS NOT NULL AS in_prod, r.category IS NOT NULL AS in_ref
                FROM p FULL OUTER JOIN r ON p.segment = r.segment AND p.column_name = r.column_name AND p.category = r.category"""),
]


@query("category_change", with_bindings(
    """SELECT segment, column_name,
              CAST(count(*) FILTER (WHERE in_prod) AS BIGINT) AS production_cardinality,
              CAST(count(*) FILTER (WHERE in_ref) AS BIGINT) AS reference_cardinality,
              CAST(count(*) FILTER (WHERE NOT in_ref) AS BIGINT) AS new_count,
              CAST(count(*) FILTER (WHERE NOT in_prod) AS BIGINT) AS missing_count
       FROM cats GROUP BY segment, column_name""", "customer_contract", extra=_CAT_CTES))
def category_change(spark, sf_dir):
    """D4 summary: churned against retained customers, per segment and text column."""
    cc = b.customer_contract(spark, sf_dir)
    return q.category_summary(cc.where("churn_value = 1"), cc.where("churn_value = 0"), ["segment"], _STR)


@query("category_change_values", with_bindings(
    """SELECT segment, column_name, category, CASE WHEN NOT in_ref THEN 'new' ELSE 'missing' END AS change
       FROM cats WHERE NOT in_ref OR NOT in_prod""", "customer_contract", extra=_CAT_CTES))
def category_change_values(spark, sf_dir):
    """D4 long form: every new / missing category (no list folded into one row)."""
    cc = b.customer_contract(spark, sf_dir)
    return q.category_changes(cc.where("churn_value = 1"), cc.where("churn_value = 0"), ["segment"], _STR)


# Fixed values of the binding: the recorded payload schema.
PAYLOAD_KEYS = ["k", "score", "value"]


@query("schema_drift", with_bindings(
    """SELECT model_version,
              coalesce(array_to_string(list_sort(list_filter(seen, lambda x: NOT list_contains(['k', 'score', 'value'], x))), ','), '') AS new_columns,
              coalesce(array_to_string(list_sort(list_filter(['k', 'score', 'value'], lambda x: NOT list_contains(seen, x))), ','), '') AS missing_columns
       FROM (SELECT model_version, list(DISTINCT key) AS seen
             FROM (SELECT model_version, unnest(json_keys(CASE WHEN json_valid(payload) THEN payload ELSE '{}' END)) AS key FROM json_payloads) GROUP BY model_version)""",
    "json_payloads"))
def schema_drift(spark, sf_dir):
    """D5 over JSON documents: keys beyond / short of the recorded schema, per model version."""
    return q.key_drift(b.json_payloads(spark, sf_dir), "payload", PAYLOAD_KEYS, ["model_version"])


def _quality_sql() -> str:
    miss = " UNION ALL ".join(
        f"SELECT segment, '{c}' AS column_name, CASE WHEN {c} IS NULL" + (f" OR isnan({c})" if c in _DBL else "")
        + " THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM prod" for c in _ALL)
    body = """SELECT n.segment, CAST(n.sample_size AS BIGINT) AS sample_size, round(coalesce(m.am, 0), 6) AS avg_missing,
                     round(coalesce(o.ao, 0), 6) AS avg_outlier,
                     round(1 - least(1, coalesce(m.am, 0) * 10 + coalesce(o.ao, 0) * 5), 4) AS quality_score
              FROM (SELECT segment, count(*) AS sample_size FROM prod GROUP BY segment) n
              LEFT JOIN (SELECT segment, avg(r) AS am FROM (SELECT segment, column_name, round(avg(m), 6) AS r FROM miss GROUP BY ALL) GROUP BY segment) m USING (segment)
              LEFT JOIN (SELECT segment, avg(round(n_out / greatest(n, 1), 6)) AS ao FROM outl GROUP BY segment) o USING (segment)"""
    return with_bindings(body, "customer_contract", extra=_IQR_CTES + [("miss", miss)])


@query("quality_report", _quality_sql())
def quality_report(spark, sf_dir):
    """D6–D8 per segment: churned customers against the whole base."""
    cc = b.customer_contract(spark, sf_dir)
    prod = cc.where("churn_value = 1").select("segment", *_ALL)
    return q.quality_report(prod, cc, ["segment"]).select(
        "segment", "sample_size", "avg_missing", "avg_outlier", "quality_score")


# ------------------------------------------------------------- calibration (F)

def _pe(spark, sf_dir):
    return b.prediction_events(spark, sf_dir)


@query("prediction_report", with_bindings(
    """SELECT model_version, count(*) AS total_predictions, round(avg(probability), 6) AS avg_probability,
              round(stddev_samp(probability), 6) AS std_probability, round(min(probability), 6) AS min_probability,
              round(max(probability), 6) AS max_probability,
              round(avg(CASE WHEN probability > 0.7 THEN 1.0 ELSE 0.0 END), 6) AS high_risk_ratio,
              round(avg(CASE WHEN probability < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS low_risk_ratio
       FROM prediction_events GROUP BY model_version""", "prediction_events"))
def prediction_report(spark, sf_dir):
    """F1 per model version."""
    return _round_all(cal.prediction_report(_pe(spark, sf_dir), by=["model_version"]))


@query("confidence_summary", with_bindings(
    """SELECT model_version, round(avg(c), 6) AS mean_confidence, round(quantile_cont(c, 0.5), 6) AS median_confidence,
              round(stddev_pop(c), 6) AS std_confidence, round(quantile_cont(c, 0.05), 6) AS p5_confidence,
              round(quantile_cont(c, 0.95), 6) AS p95_confidence,
              round(avg(CASE WHEN c < 0.6 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_ratio,
              round(avg(CASE WHEN c > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS high_confidence_ratio
       FROM (SELECT model_version, greatest(probability, 1 - probability) AS c FROM prediction_events)
       GROUP BY model_version""", "prediction_events"))
def confidence_summary(spark, sf_dir):
    """F3 per model version."""
    return _round_all(cal.confidence_summary(_pe(spark, sf_dir), by=["model_version"]))


def _hist_sql() -> str:
    parts = [f"SELECT model_version, '{bkt}' AS le, CAST(count(*) FILTER (WHERE c <= {bkt}) AS BIGINT) AS cumulative_count FROM cc GROUP BY model_version"
             for bkt in CONFIDENCE_BUCKETS]
    parts.append("SELECT model_version, '+Inf' AS le, CAST(count(*) AS BIGINT) FROM cc GROUP BY model_version")
    return with_bindings(" UNION ALL ".join(parts), "prediction_events", extra=[
        ("cc", "SELECT model_version, greatest(probability, 1 - probability) AS c FROM prediction_events")])


@query("confidence_histogram", _hist_sql())
def confidence_histogram(spark, sf_dir):
    """cumulative confidence buckets per model version."""
    return cal.confidence_histogram(_pe(spark, sf_dir), by=["model_version"])


@query("entropy", with_bindings(
    """SELECT model_version, round(avg(-p * log2(p) - (1 - p) * log2(1 - p)), 6) AS prediction_entropy
       FROM (SELECT model_version, least(greatest(probability, 1e-10), 1 - 1e-10) AS p FROM prediction_events)
       GROUP BY model_version""", "prediction_events"))
def entropy(spark, sf_dir):
    """F5 per model version."""
    return _round_all(cal.entropy(_pe(spark, sf_dir), by=["model_version"]))


_GINI_SQL = """SELECT model_version,
       round(2 * sum(cs) / (count(*) * sum(probability)) - (count(*) + 1) / count(*), 6) AS gini
  FROM (SELECT model_version, probability,
               sum(probability) OVER (PARTITION BY model_version ORDER BY probability ROWS UNBOUNDED PRECEDING) AS cs
        FROM {src})
  GROUP BY model_version"""


@query("gini_spread", with_bindings(_GINI_SQL.format(src="prediction_events"), "prediction_events"))
def gini_spread(spark, sf_dir):
    """F6 per model version (bucketed prefix sums, no global window)."""
    return _round_all(_gini(_pe(spark, sf_dir), "probability", ["model_version"]))


@query("gini_documents", with_bindings(_GINI_SQL.format(src="document_scores"), "document_scores"))
def gini_documents(spark, sf_dir):
    """F6 over the document scores (continuous scores, few ties)."""
    return _round_all(_gini(b.document_scores(spark, sf_dir), "probability", ["model_version"]))


@query("class_balance", with_bindings(
    """SELECT model_version, round(pr, 6) AS predicted_positive_rate, round(1 - pr, 6) AS predicted_negative_rate,
              round(ref, 6) AS reference_positive_rate, round(abs(pr - ref), 6) AS class_balance_shift,
              abs(pr - ref) > 0.1 AS shift_alert
       FROM (SELECT model_version, avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END) AS pr FROM prediction_events GROUP BY model_version)
       JOIN (SELECT avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END) AS ref FROM prediction_events) ON TRUE""",
    "prediction_events"))
def class_balance(spark, sf_dir):
    """F7 + F9: per model version against the positive rate of all versions together."""
    pe = _pe(spark, sf_dir)
    overall = pe.agg(F.avg((F.col("probability") >= 0.5).cast("double")).alias("ref"))
    per = cal.class_balance(pe, by=["model_version"])
    # one-row aggregate joined on a constant key
    j = per.withColumn("_k", F.lit(0)).join(overall.withColumn("_k", F.lit(0)), "_k").drop("_k")
    out = (j.withColumn("reference_positive_rate", F.col("ref"))
           .withColumn("class_balance_shift", F.abs(F.col("predicted_positive_rate") - F.col("ref")))
           .withColumn("shift_alert", F.col("class_balance_shift") > 0.1).drop("ref"))
    return _round_all(out)


def _labelled(spark, sf_dir):
    return attach_labels(_pe(spark, sf_dir), b.feedback(spark, sf_dir))


_LATEST = """SELECT request_id, arg_max(label, (labeled_at, label)) AS label, max(labeled_at) AS labeled_at
             FROM feedback WHERE label IN (0, 1) GROUP BY request_id"""
_LABELLED = """SELECT e.*, l.label, l.labeled_at FROM prediction_events e LEFT JOIN latest l USING (request_id)"""

_BIN_EXPR = ("CASE WHEN probability >= 0 AND probability < 1 THEN "
             "len(list_filter(list_transform(range(1, 10), lambda i: i * (1.0::DOUBLE / 10)), lambda e: e <= probability)) END")


@query("reliability_bins", with_bindings(
    f"""SELECT model_version, CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS count,
               round(avg(probability), 6) AS avg_confidence, round(avg(label), 6) AS avg_accuracy,
               round(abs(avg(probability) - avg(label)), 6) AS calibration_gap
        FROM (SELECT model_version, probability, label, {_BIN_EXPR} AS bin FROM labelled WHERE label IS NOT NULL)
        WHERE bin IS NOT NULL GROUP BY model_version, bin""",
    "prediction_events", "feedback", extra=[("latest", _LATEST), ("labelled", _LABELLED)]))
def reliability_bins(spark, sf_dir):
    """F2 bins per model version over events with attached ground truth."""
    out = cal.reliability_bins(_labelled(spark, sf_dir), by=["model_version"])
    return _round_all(out.select("model_version", F.col("bin").cast("int").alias("bin"),
                                 F.col("count").cast("bigint").alias("count"),
                                 "avg_confidence", "avg_accuracy", "calibration_gap"))


_ECE_SQL = f"""SELECT n.model_version, CAST(n.n AS BIGINT) AS n_labelled, round(coalesce(w.w, 0) / n.n, 6) AS ece
    FROM (SELECT model_version, count(*) AS n FROM {{src}} WHERE label IS NOT NULL GROUP BY model_version) n
    LEFT JOIN (SELECT model_version, sum(gap * cnt) AS w FROM (
        SELECT model_version, bin, count(*) AS cnt, abs(avg(probability) - avg(label)) AS gap
        FROM (SELECT model_version, probability, label, {_BIN_EXPR} AS bin FROM {{src}} WHERE label IS NOT NULL)
        WHERE bin IS NOT NULL GROUP BY model_version, bin) GROUP BY model_version) w USING (model_version)"""


@query("ece", with_bindings(_ECE_SQL.format(src="labelled"), "prediction_events", "feedback",
                            extra=[("latest", _LATEST), ("labelled", _LABELLED)]))
def ece(spark, sf_dir):
    """F2 ECE per model version."""
    return _round_all(cal.ece(_labelled(spark, sf_dir), by=["model_version"]))


@query("ece_documents", with_bindings(_ECE_SQL.format(src="document_scores"), "document_scores"))
def ece_documents(spark, sf_dir):
    """F2 ECE of the document scores against the quality labels, per language."""
    return _round_all(cal.ece(b.document_scores(spark, sf_dir), by=["model_version"]))


@query("calibration_report", with_bindings(
    f"""SELECT m.model_version, CAST(m.sample_size AS BIGINT) AS sample_size, round(m.mean_confidence, 6) AS mean_confidence,
               round(m.median_confidence, 6) AS median_confidence, round(m.std_confidence, 6) AS std_confidence,
               round(m.low_confidence_ratio, 6) AS low_confidence_ratio, round(m.high_confidence_ratio, 6) AS high_confidence_ratio,
               round(m.prediction_entropy, 6) AS prediction_entropy, round(m.predicted_positive_rate, 6) AS predicted_positive_rate,
               g.gini, e.ece
        FROM (SELECT model_version, count(*) AS sample_size, avg(c) AS mean_confidence, quantile_cont(c, 0.5) AS median_confidence,
                     stddev_pop(c) AS std_confidence, avg(CASE WHEN c < 0.6 THEN 1.0 ELSE 0.0 END) AS low_confidence_ratio,
                     avg(CASE WHEN c > 0.9 THEN 1.0 ELSE 0.0 END) AS high_confidence_ratio,
                     avg(-pc * log2(pc) - (1 - pc) * log2(1 - pc)) AS prediction_entropy,
                     avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END) AS predicted_positive_rate
              FROM (SELECT *, greatest(probability, 1 - probability) AS c,
                           least(greatest(probability, 1e-10), 1 - 1e-10) AS pc FROM labelled) GROUP BY model_version) m
        JOIN ({_GINI_SQL.format(src="labelled")}) g USING (model_version)
        JOIN ({_ECE_SQL.format(src="labelled")}) e USING (model_version)""",
    "prediction_events", "feedback", extra=[("latest", _LATEST), ("labelled", _LABELLED)]))
def calibration_report(spark, sf_dir):
    """F8 per model version, ECE from the attached labels."""
    out = cal.calibration_report(_labelled(spark, sf_dir), by=["model_version"])
    return _round_all(out.withColumn("sample_size", F.col("sample_size").cast("bigint")))
