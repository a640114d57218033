"""Reports and dashboard (A9, A10) and the synthetic customer table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from modelwatch.functions.numeric import to_number
from modelwatch.operators import calibration as cal
from modelwatch.operators import contracts as ct
from modelwatch.operators import drift
from modelwatch.operators import features as fe
from modelwatch.operators import quality as q
from modelwatch.operators import reports as rp
from modelwatch.params import DEFAULTS
from modelwatch.plans.drift_queries import psi_ctes, report_ctes
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.session import scratch_path
from modelwatch.sources import bindings as b
from modelwatch.sources import synthetic as syn
from modelwatch.sources.tables import table

_TS = "yyyy-MM-dd HH:mm:ss"
_EARLIER = "2024-01-31 00:00:00"


def _reports(spark, sf_dir):
    now = F.lit(b.NOW).cast("timestamp")
    earlier = F.lit(_EARLIER).cast("timestamp")
    ref = b.lineitem_wide(spark, sf_dir, "reference")
    prod = b.lineitem_wide(spark, sf_dir, "production_biased")
    health = drift.model_health(drift.drift_report_wide(ref, prod, list(b.LINEITEM_FEATURES)))
    cc = b.customer_contract(spark, sf_dir)
    quality = q.quality_report(cc.where("churn_value = 1"), cc, ["segment"])
    pred = cal.prediction_report(b.prediction_events(spark, sf_dir), by=["model_version"])
    # one health computation reported at two times (the later one must win on the dashboard)
    twice = health.withColumn("_ts", F.explode(F.array(earlier, now)))
    return (rp.as_reports(twice, "health", F.col("_ts"), exclude=["_ts"])
            .unionByName(rp.as_reports(quality, "data_quality", earlier, ["segment"]))
            .unionByName(rp.as_reports(pred, "prediction", now, ["model_version"])))


def _written(spark, sf_dir):
    """The reports written to the report table and read back."""
    return rp.write_reports(_reports(spark, sf_dir), scratch_path(spark, f"reports/{uuid.uuid4().hex}"), "2024-02-01")


def _fields(body: str):
    """The body's headline count and its main figure, whichever fields the kind has."""
    field = lambda name: F.get_json_object(body, f"$.{name}")
    headline = F.coalesce(*[field(n) for n in ("drifting_feature_count", "sample_size", "total_predictions")]).cast("bigint")
    return headline.alias("headline"), F.round(field("max_probability").cast("double"), 6).alias("figure")


_REPORT_CTES = psi_ctes("reference_rows", "production_biased", []) + report_ctes() + [
    ("rep", f"""SELECT 'health' AS kind, 'all' AS scope, t.ts, (SELECT count(*) FILTER (WHERE status = 'DRIFT') FROM report) AS headline,
                       CAST(NULL AS DOUBLE) AS figure
                FROM (VALUES ('{_EARLIER}'), ('{b.NOW}')) t(ts)
                UNION ALL SELECT 'data_quality', segment, '{_EARLIER}', count(*), NULL FROM customer_contract WHERE churn_value = 1 GROUP BY segment
                UNION ALL SELECT 'prediction', model_version, '{b.NOW}', count(*), round(max(probability), 6)
                          FROM prediction_events WHERE probability IS NOT NULL GROUP BY model_version""")]
_REPORT_TABLES = ("reference_rows", "production_biased", "customer_contract", "prediction_events")


@query("dashboard", with_bindings(
    """SELECT k.kind, r.scope, r.kind IS NOT NULL AS present, r.ts AS latest_ts, CAST(coalesce(r.n, 0) AS BIGINT) AS reports,
              CAST(r.headline AS BIGINT) AS headline, r.figure
       FROM (VALUES ('health'), ('data_quality'), ('calibration'), ('prediction')) k(kind)
       LEFT JOIN (SELECT kind, scope, max(ts) AS ts, count(*) AS n, arg_max(headline, ts) AS headline, arg_max_null(figure, ts) AS figure
                  FROM rep GROUP BY kind, scope) r USING (kind)""", *_REPORT_TABLES, extra=_REPORT_CTES))
def dashboard(spark, sf_dir):
    """A10 over the written reports: the latest per kind and scope (calibration has none and shows as absent)."""
    d = rp.dashboard(spark, _written(spark, sf_dir))
    return d.select("kind", "scope", "present", F.date_format("latest_ts", _TS).alias("latest_ts"), "reports", *_fields("latest_body"))


@query("report_rows", with_bindings("SELECT kind, scope, ts, CAST(headline AS BIGINT) AS headline, figure FROM rep",
                                    *_REPORT_TABLES, extra=_REPORT_CTES))
def report_rows(spark, sf_dir):
    """The report rows read back from their table, with fields of the parsed bodies."""
    return _written(spark, sf_dir).select("kind", "scope", F.date_format("ts", _TS).alias("ts"), *_fields("body"))


def _draw(name: str) -> str:
    d = syn.draws()[name]
    h = f"substr(md5('{DEFAULTS.seed}|{name}|' || CAST(c_custkey AS VARCHAR)), 1, {syn.DIGITS})"
    return f"({d.low} + CAST('0x' || {h} AS BIGINT) % {d.high - d.low + 1})"


def _synthetic_sql() -> str:
    """The generated table in DuckDB: the same hash draws, written as SQL."""
    pick = lambda n: f"""[{', '.join("'" + v + "'" for v in syn.CATEGORIES[n])}][{_draw(n)}] AS "{n}\""""
    total = f"({_draw('Monthly Cents')} * {_draw('Tenure Months')} + {_draw('Extra Cents')})"
    churned = f"({_draw('Churn')} < {syn.CHURNED_OF_100})"
    return f"""SELECT 'SYN-' || CAST(c_custkey AS VARCHAR) AS "CustomerID", n_name AS "Country", 'S' || {_draw('State')} AS "State",
        'City ' || {_draw('City')} AS "City", CAST({_draw('Zip Code')} AS VARCHAR) AS "Zip Code",
        {_draw('Latitude')} / 1000.0::DOUBLE AS "Latitude", {_draw('Longitude')} / 1000.0::DOUBLE AS "Longitude",
        {', '.join(pick(n) for n in syn.CATEGORIES)}, {_draw('Tenure Months')} AS "Tenure Months",
        {_draw('Monthly Cents')} / 100.0::DOUBLE AS "Monthly Charges",
        CASE WHEN {_draw('Tenure Months')} > 0 THEN {total} / 100.0::DOUBLE END AS "Total Charges",
        CASE WHEN {churned} THEN 'Yes' ELSE 'No' END AS "Churn Label", CAST({churned} AS BIGINT) AS "Churn Value",
        {_draw('Churn Score')} AS "Churn Score", {_draw('CLTV')} AS "CLTV",
        CASE WHEN {churned} AND {_draw('Churn Score')} > 50 THEN 'Moved' END AS "Churn Reason"
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""


def _synthetic(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    keys = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    return syn.synthetic_customers(keys, "c_custkey", "n_name")


@query("synthetic_customers", _synthetic_sql())
def synthetic_customers(spark, sf_dir):
    """The raw contract generated for every customer key (deterministic per key); charges read back as numbers."""
    df = _synthetic(spark, sf_dir).drop("Count", "Lat Long")
    return df.withColumn("Total Charges", to_number("Total Charges"))


# Fixed values of the binding: the contract that the generated table is held to.
_RAW_CONTRACT = ct.Contract({
    **{n: ct.ColumnSpec("str", allowed=tuple(v)) for n, v in syn.CATEGORIES.items()},
    "Tenure Months": ct.ColumnSpec("int"), "Monthly Charges": ct.ColumnSpec("float"), "Total Charges": ct.ColumnSpec("float"),
    "Churn Value": ct.ColumnSpec("int", allowed=(0, 1)), "Churn Reason": ct.ColumnSpec("str", allowed=("Unknown", "Moved"))})


@query("synthetic_summary", f"""
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum("Churn Value") AS BIGINT) AS churned, CAST(count(*) FILTER (WHERE "Total Charges" IS NULL) AS BIGINT) AS coerced,
           CAST(0 AS BIGINT) AS violating, CAST(count(*) FILTER (WHERE "Churn Reason" IS NULL) AS BIGINT) AS unknown_reason,
           CAST(round(sum(coalesce("Total Charges", 0) * 100)) AS BIGINT) AS total_cents
    FROM ({_synthetic_sql()})""")
def synthetic_summary(spark, sf_dir):
    """A12 through B1–B6: blank charges counted (B2), cleaned with the reason filled (B3), held to the contract."""
    raw = _synthetic(spark, sf_dir)
    blank = fe.coerced("Total Charges").alias("blank")
    clean = fe.preclean(raw.withColumn("blank", blank), "Total Charges", "Churn Reason")
    checked = clean.withColumn("bad", F.size(ct.violations(clean, _RAW_CONTRACT)) > 0)
    return checked.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.sum("Churn Value").alias("churned"),
        F.count_if("blank").cast("bigint").alias("coerced"), F.count_if("bad").cast("bigint").alias("violating"),
        F.count_if(F.col("Churn Reason") == "Unknown").cast("bigint").alias("unknown_reason"),
        F.round(F.sum(F.col("Total Charges") * 100)).cast("bigint").alias("total_cents"))
