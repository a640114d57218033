"""Contract, feature and privacy queries (B1–B12, C3, T13) with their DuckDB twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from modelwatch.functions.hashing import subject_key
from modelwatch.functions.numeric import NUMERIC_TEXT
from modelwatch.operators import contracts as ct
from modelwatch.operators import features as fe
from modelwatch.operators import privacy as pv
from modelwatch.plans.monitor_queries import _round_all
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.sources import bindings as b

# Fixed values of the binding: the raw-contract declaration of customer_contract.
CUSTOMER_CONTRACT = ct.Contract({
    "customer_id": ct.ColumnSpec("str"),
    "country": ct.ColumnSpec("str"),
    "segment": ct.ColumnSpec("str"),
    "gender": ct.ColumnSpec("str"),
    "tenure_months": ct.ColumnSpec("int"),
    "monthly_charges": ct.ColumnSpec("float"),
    "total_charges": ct.ColumnSpec("float"),
    "balance": ct.ColumnSpec("float"),
    "churn_value": ct.ColumnSpec("int", allowed=(0, 1)),
    "churn_reason": ct.ColumnSpec("str", required=False, nullable=True),
})
FEATURE_SCHEMA = ["tenure_months", "monthly_charges", "total_charges", "balance", "segment", "country"]
PAYLOAD_TYPES = {"k": "int", "value": "float"}
RECORDED_TYPES = {"tenure_months": "float", "monthly_charges": "int", "total_charges": "float",
                  "balance": "int", "segment": "str"}

_INT = r"^\s*[+-]?\d+\s*$"
_NUM_SQL = NUMERIC_TEXT.replace("'", "''")


def _cc(spark, sf_dir):
    return b.customer_contract(spark, sf_dir)


# -------------------------------------------------------------------- contracts

@query("contract_violations", with_bindings(
    f"""SELECT 'monthly_charges' AS column_name, 'not_nullable' AS check_name, CAST(count(*) AS BIGINT) AS failures
          FROM customer_contract WHERE monthly_charges IS NULL HAVING count(*) > 0
        UNION ALL
        SELECT 'total_charges', 'dtype', CAST(count(*) AS BIGINT) FROM customer_contract
          WHERE total_charges IS NOT NULL AND NOT regexp_matches(total_charges, '{_NUM_SQL}') HAVING count(*) > 0
        UNION ALL
        SELECT 'churn_value', 'isin', CAST(count(*) AS BIGINT) FROM customer_contract
          WHERE tenure_months % 17 = 3 HAVING count(*) > 0
        UNION ALL
        SELECT 'churn_value', 'not_nullable', CAST(count(*) AS BIGINT) FROM customer_contract
          WHERE tenure_months % 17 = 5 HAVING count(*) > 0
        UNION ALL
        SELECT 'tenure_months', 'dtype', CAST(count(*) AS BIGINT) FROM customer_contract
          WHERE tenure_months % 19 = 2 HAVING count(*) > 0
        UNION ALL
        SELECT 'gender', 'column_in_dataframe', CAST(NULL AS BIGINT)""", "customer_contract"))
def contract_violations(spark, sf_dir):
    """Every failed check of the declared contract, by column and check (some targets and tenures are spoilt for it;
    a whole tenure with an empty fraction is no failure)."""
    cc = _cc(spark, sf_dir)
    m = F.col("tenure_months")
    spoilt = cc.withColumn("churn_value", F.when(m % 17 == 3, 2).when(m % 17 != 5, F.col("churn_value"))) \
        .withColumn("tenure_months", F.when(m % 19 == 2, F.concat(m.cast("string"), F.lit(".5")))
                    .when(m % 19 == 4, F.concat(m.cast("string"), F.lit(".0"))).otherwise(m.cast("string")))
    return ct.violation_counts(spoilt, CUSTOMER_CONTRACT)


@query("target_domain", with_bindings(
    """SELECT target, CAST(count(*) AS BIGINT) AS rows
       FROM (SELECT CASE WHEN tenure_months % 17 = 3 THEN 2 WHEN tenure_months % 17 <> 5 THEN churn_value END AS target
             FROM customer_contract)
       WHERE target IS NULL OR target NOT IN (0, 1) GROUP BY target""", "customer_contract"))
def target_domain(spark, sf_dir):
    """Rows whose target is outside {0, 1} (NULL included), by value; some targets are spoilt for it."""
    spoilt = F.when(F.col("tenure_months") % 17 == 3, 2).when(F.col("tenure_months") % 17 != 5, F.col("churn_value"))
    rows = ct.target_violations(_cc(spark, sf_dir).select(spoilt.cast("int").alias("target")), "target")
    return rows.groupBy("target").agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


_INTEGRAL = r"^\s*[+-]?\d+(\.0*)?\s*$"


@query("payload_contract", with_bindings(
    f"""SELECT event_id, unknown_fields, missing_fields, bad_types, NOT ok AS parse_error,
               ok AND unknown_fields = '' AND missing_fields = '' AND bad_types = '' AS valid
        FROM (SELECT event_id, json_valid(payload) AS ok,
                coalesce(array_to_string(list_sort(list_filter(json_keys(p), lambda x: NOT list_contains(['k', 'value'], x))), ','), '') AS unknown_fields,
                CASE WHEN json_valid(payload) THEN coalesce(array_to_string(list_sort(list_filter(['k', 'value'], lambda x: NOT list_contains(json_keys(p), x))), ','), '') ELSE '' END AS missing_fields,
                concat_ws(',',
                  CASE WHEN list_contains(json_keys(p), 'k')
                        AND NOT coalesce(regexp_matches(json_extract_string(p, '$.k'), '{_INTEGRAL}'), false) THEN 'k' END,
                  CASE WHEN list_contains(json_keys(p), 'value')
                        AND NOT coalesce(regexp_matches(json_extract_string(p, '$.value'), '{_NUM_SQL}'), false) THEN 'value' END) AS bad_types
              FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload ELSE '{{}}' END AS p FROM json_payloads))""", "json_payloads"))
def payload_contract(spark, sf_dir):
    """Each payload against the recorded field types: unknown, missing, mistyped fields, and text that is no JSON."""
    out = ct.payload_check(b.json_payloads(spark, sf_dir), "payload", PAYLOAD_TYPES)
    return out.select("event_id", "unknown_fields", "missing_fields", "bad_types", "parse_error", "valid")


def _infer_sql() -> str:
    parts = []
    for c in ["customer_id", "country", "segment", "tenure_months", "monthly_charges", "total_charges", "balance",
              "churn_value"]:
        s = f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS column_name,
            CASE WHEN count({s}) = 0 THEN 'str'
                 WHEN count(*) FILTER (WHERE {s} IS NOT NULL AND lower(trim({s})) NOT IN ('true', 'false')) = 0 THEN 'bool'
                 WHEN count(*) FILTER (WHERE {s} IS NOT NULL AND NOT regexp_matches({s}, '{_INT}')) = 0 THEN 'int'
                 WHEN count(*) FILTER (WHERE {s} IS NOT NULL AND NOT regexp_matches({s}, '{_NUM_SQL}')) = 0 THEN 'float'
                 ELSE 'str' END AS inferred_type FROM customer_contract""")
    return with_bindings(" UNION ALL ".join(parts), "customer_contract")


@query("infer_types", _infer_sql())
def infer_types(spark, sf_dir):
    """B9 on the contract read as text (as from CSV): the narrowest type every value fits."""
    cc = _cc(spark, sf_dir)
    text = cc.select(*[F.col(c).cast("string").alias(c) for c in cc.columns])
    return ct.infer_text_types(text)



_RECORDED = {"tenure_months": "int", "monthly_charges": "float"}
_TYPED = ["customer_id", "tenure_months", "monthly_charges", "total_charges", "senior", "nothing"]


def _feature_types_sql() -> str:
    def kind(c: str) -> str:
        s = f"CAST({c} AS VARCHAR)"
        return f"""CASE WHEN count({s}) = 0 THEN 'float'
            WHEN count(*) FILTER (WHERE lower(trim({s})) NOT IN ('true', 'false')) = 0 THEN CASE WHEN count({s}) < count(*) THEN 'str' ELSE 'bool' END
            WHEN count(*) FILTER (WHERE NOT regexp_matches({s}, '{_INT}')) = 0 THEN CASE WHEN count({s}) < count(*) THEN 'float' ELSE 'int' END
            WHEN count(*) FILTER (WHERE NOT regexp_matches({s}, '{_NUM_SQL}')) = 0 THEN 'float' ELSE 'str' END"""

    sample = """SELECT customer_id, CASE WHEN tenure_months > 0 THEN tenure_months END AS tenure_months, monthly_charges,
                       total_charges, churn_value = 1 AS senior, NULL AS nothing FROM customer_contract ORDER BY customer_id LIMIT 512"""
    rows = " UNION ALL ".join(f"SELECT 'sample' AS origin, '{c}' AS column_name, {kind(c)} AS inferred_type FROM ({sample})" for c in _TYPED)
    fixed = " UNION ALL ".join(
        f"SELECT '{origin}', '{c}', '{_RECORDED.get(c, 'str') if origin == 'recorded' else 'str'}'"
        for origin in ("recorded", "no_sample", "column_missing") for c in _TYPED)
    return f"{rows} UNION ALL {fixed}"


@query("feature_types", with_bindings(_feature_types_sql(), "customer_contract"))
def feature_types(spark, sf_dir):
    """B9's order: recorded types, the reference's first 512 rows (read as text), all ``str``."""
    cc = _cc(spark, sf_dir)
    known = cc.select("customer_id", F.when(F.col("tenure_months") > 0, F.col("tenure_months")).alias("tenure_months"), "monthly_charges",
                      "total_charges", (F.col("churn_value") == 1).alias("senior"), F.lit(None).alias("nothing"))
    first = known.orderBy("customer_id").limit(ct.TYPE_SAMPLE_ROWS)
    sample = first.select(*[F.col(c).cast("string").alias(c) for c in _TYPED])
    found = {"recorded": ct.feature_types(_TYPED, _RECORDED, sample), "sample": ct.feature_types(_TYPED, None, sample),
             "no_sample": ct.feature_types(_TYPED), "column_missing": ct.feature_types(_TYPED, None, sample.drop("senior"))}
    return spark.createDataFrame([(o, c, t) for o, types in found.items() for c, t in types.items()],
                                 "origin string, column_name string, inferred_type string")

@query("cast_recorded_types", with_bindings(
    f"""SELECT customer_id,
               coalesce(CAST(tenure_months AS DOUBLE), 0.0::DOUBLE) AS tenure_months,
               CAST(trunc(coalesce(monthly_charges, 0.0::DOUBLE)) AS BIGINT) AS monthly_charges,
               CASE WHEN regexp_matches(total_charges, '{_NUM_SQL}') THEN CAST(trim(total_charges) AS DOUBLE) ELSE 0.0::DOUBLE END AS total_charges,
               CAST(trunc(coalesce(balance, 0.0::DOUBLE)) AS BIGINT) AS balance,
               segment
        FROM customer_contract""", "customer_contract"))
def cast_recorded_types(spark, sf_dir):
    """Cast to the recorded types; unparseable numbers become 0."""
    cc = _cc(spark, sf_dir).select("customer_id", *RECORDED_TYPES)
    return _round_all(ct.cast_recorded_types(cc, RECORDED_TYPES))


@query("bundle_check", with_bindings(
    """SELECT model_name, model_version,
              concat_ws(',', CASE WHEN feature_count IS NOT NULL AND feature_count <> len(feature_schema) THEN 'feature_count_mismatch' END,
                        CASE WHEN NOT has_metadata THEN 'metadata_missing' END) AS reasons,
              has_metadata AND NOT coalesce(feature_count <> len(feature_schema), false) AS valid
       FROM model_versions""", "model_versions"))
def bundle_check(spark, sf_dir):
    """Metadata of every experiment: there, feature schema non-empty with non-empty names, count as recorded."""
    out = ct.bundle_check(b.model_versions(spark, sf_dir))
    return out.select("model_name", "model_version", F.array_join("reasons", ",").alias("reasons"),
                      (F.size("reasons") == 0).alias("valid"))


# --------------------------------------------------------------------- features

_CHARGES_SQL = f"CASE WHEN regexp_matches(total_charges, '{_NUM_SQL}') THEN CAST(trim(total_charges) AS DOUBLE) ELSE 0.0::DOUBLE END"


@query("build_features", with_bindings(
    f"""SELECT country, segment, tenure_months, round(monthly_charges, 6) AS monthly_charges,
               round({_CHARGES_SQL}, 6) AS total_charges, round(balance, 6) AS balance
        FROM customer_contract""", "customer_contract"))
def build_features(spark, sf_dir):
    """B1: charges text → number (bad → 0.0), target and id dropped, input order kept."""
    return _round_all(fe.build_features(_cc(spark, sf_dir), "total_charges", "churn_value", ["customer_id"]))


@query("coerced_count", with_bindings(
    f"""SELECT segment, CAST(count(*) FILTER (WHERE total_charges IS NULL
              OR NOT regexp_matches(total_charges, '{_NUM_SQL}')) AS BIGINT) AS coerced
        FROM customer_contract GROUP BY segment""", "customer_contract"))
def coerced_count(spark, sf_dir):
    """B2: coerced charge values per segment."""
    return fe.coerced_count(_cc(spark, sf_dir), "total_charges", ["segment"])


@query("preclean", with_bindings(
    f"""SELECT customer_id, round({_CHARGES_SQL}, 6) AS total_charges, churn_value FROM customer_contract""",
    "customer_contract"))
def preclean(spark, sf_dir):
    """Blank charges → NULL → number → 0.0 before the contract check."""
    out = fe.preclean(_cc(spark, sf_dir).select("customer_id", "total_charges", "churn_value"), "total_charges")
    return _round_all(out)


@query("scoring_contract", with_bindings(
    f"""SELECT tenure_months, round(monthly_charges, 6) AS monthly_charges, round({_CHARGES_SQL}, 6) AS total_charges,
               round(balance, 6) AS balance, segment, country FROM customer_contract""", "customer_contract"))
def scoring_contract(spark, sf_dir):
    """Built features selected in the recorded order (extras dropped)."""
    feats = fe.build_features(_cc(spark, sf_dir), "total_charges", "churn_value", ["customer_id"])
    return _round_all(ct.scoring_contract(feats, FEATURE_SCHEMA, "churn_value"))


# ---------------------------------------------------------------------- privacy

def _hmac_sql(expr: str, salt: str = b.SUBJECT_SALT) -> str:
    key = salt.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    ipad = bytes(x ^ 0x36 for x in key).hex()
    opad = bytes(x ^ 0x5C for x in key).hex()
    return (f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode(trim({expr})))))")


@query("subject_keys", with_bindings(
    f"""SELECT subject_id, CASE WHEN trim(subject_id) = '' THEN NULL ELSE {_hmac_sql('subject_id')} END AS subject_key
        FROM (SELECT DISTINCT subject_id FROM prediction_events WHERE subject_id IS NOT NULL)""", "prediction_events"))
def subject_keys(spark, sf_dir):
    """Keyed pseudonym (HMAC-SHA256) of every subject id."""
    ids = b.prediction_events(spark, sf_dir).select("subject_id").where(F.col("subject_id").isNotNull()).distinct()
    return ids.select("subject_id", subject_key("subject_id", b.SUBJECT_SALT).alias("subject_key"))


@query("subject_keys_padded", f"""
    SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE {_hmac_sql("CASE event_id % 3 WHEN 0 THEN chr(65279) || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END")} END AS subject_key
    FROM events""")
def subject_keys_padded(spark, sf_dir):
    """B12 at the edges: a byte-order mark stays part of the id, other white space around it does not, blank ids have no key."""
    from modelwatch.sources.tables import table
    m, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    raw = F.when(m == 0, F.concat(F.lit("\ufeff"), user)).when(m == 1, F.concat(F.lit("\u2003\t"), user, F.lit("\x1f\xa0"))) \
        .otherwise(F.lit(" \n\u3000"))
    return table(spark, sf_dir, "events").select("event_id", subject_key(raw, b.SUBJECT_SALT).alias("subject_key"))


def _erase_list(spark, sf_dir):
    """Subjects asking for erasure: users with a high-value signup (derived from ``events``)."""
    from modelwatch.sources.tables import table
    ev = table(spark, sf_dir, "events")
    return ev.where((F.col("event_type") == "signup") & (F.col("value") > 200)).select(
        F.col("user_id").cast("string").alias("subject_id")).distinct()


_ERASE_SQL = with_bindings(
    f"""SELECT e.model_version,
               CAST(count(*) FILTER (WHERE x.k IS NULL) AS BIGINT) AS remaining,
               CAST(count(*) FILTER (WHERE x.k IS NOT NULL) AS BIGINT) AS erased
        FROM (SELECT model_version, {_hmac_sql('subject_id')} AS k FROM prediction_events) e
        LEFT JOIN (SELECT DISTINCT {_hmac_sql('CAST(user_id AS VARCHAR)')} AS k FROM events
                   WHERE event_type = 'signup' AND value > 200) x ON e.k = x.k
        GROUP BY e.model_version""", "prediction_events")


@query("erase_subjects", _ERASE_SQL)
def erase_subjects(spark, sf_dir):
    """Events left and erased per model version after erasing the requested subjects."""
    pe = pv.with_subject_key(b.prediction_events(spark, sf_dir), "subject_id", b.SUBJECT_SALT)
    remaining, _ = pv.erase_subjects(pe, _erase_list(spark, sf_dir), b.SUBJECT_SALT)
    left = remaining.groupBy("model_version").agg(F.count(F.lit(1)).alias("remaining"))
    total = pe.groupBy("model_version").agg(F.count(F.lit(1)).alias("total"))
    return total.join(left, "model_version", "left").select(
        "model_version", F.coalesce("remaining", F.lit(0)).cast("bigint").alias("remaining"),
        (F.col("total") - F.coalesce("remaining", F.lit(0))).cast("bigint").alias("erased"))


@query("erase_report", with_bindings(
    f"""SELECT x.subject_id, x.subject_key, CAST(count(e.k) AS BIGINT) AS erased
        FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject_id, {_hmac_sql('CAST(user_id AS VARCHAR)')} AS subject_key
              FROM events WHERE event_type = 'signup' AND value > 200) x
        LEFT JOIN (SELECT {_hmac_sql('subject_id')} AS k FROM prediction_events) e ON e.k = x.subject_key
        GROUP BY x.subject_id, x.subject_key""", "prediction_events"))
def erase_report(spark, sf_dir):
    """Per requested subject, how many stored events the erasure removes."""
    pe = pv.with_subject_key(b.prediction_events(spark, sf_dir), "subject_id", b.SUBJECT_SALT)
    _, report = pv.erase_subjects(pe, _erase_list(spark, sf_dir), b.SUBJECT_SALT)
    return report


_DOCUMENT = ["CustomerID", "Country", "Segment", "Tenure Months", "Balance", "State"]


@query("redact", with_bindings(
    """SELECT md5(customer_id) AS customer_id_hash,
              concat_ws('|', CASE WHEN tenure_months > 0 THEN 'Balance=' || CAST(CAST(round(balance * 100) AS BIGINT) AS VARCHAR) END,
                        'Segment=' || segment, 'Tenure Months=' || CAST(tenure_months AS VARCHAR)) AS document
       FROM customer_contract""", "customer_contract"))
def redact(spark, sf_dir):
    """The contract as a feature document (newcomers without a balance), sensitive keys stripped before storage."""
    cc = _cc(spark, sf_dir)
    values = [F.col("customer_id"), F.col("country"), F.col("segment"), F.col("tenure_months").cast("string"),
              F.when(F.col("tenure_months") > 0, F.round(F.col("balance") * 100).cast("bigint").cast("string")), F.lit("ST")]
    doc = F.map_filter(F.create_map(*[x for k, v in zip(_DOCUMENT, values) for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    docs = pv.redact_document(cc.select(F.md5("customer_id").alias("customer_id_hash"), doc.alias("doc")), "doc")
    entries = F.transform(F.array_sort(F.map_keys("doc")), lambda k: F.concat(k, F.lit("="), F.col("doc")[k]))
    return docs.select("customer_id_hash", F.array_join(entries, "|").alias("document"))
