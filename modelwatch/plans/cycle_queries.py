"""Retraining table and lifecycle cycles that act (A1, A4, A8, H1, L1–L5) with their DuckDB twins.

Binding: customers of 63 months and more are the raw table; newer ones are production, scored without id and country, and labelled over
time: those with a balance of 0 or more on a day of 2024-01 by their number, and one in 25 again, with the other label, in February.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.operators import cycle, jobs, retraining
from modelwatch.operators.common import stored
from modelwatch.operators.contracts import ColumnSpec, Contract
from modelwatch.params import DEFAULTS
from modelwatch.plans.drift_queries import psi_ctes
from modelwatch.plans.ml_queries import NUMERIC, TRAINING
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.session import scratch_path
from modelwatch.sources import bindings as b
from modelwatch.sources.tables import LABELED_AT, PART, read_training_table

FIRST_LABELS = "2024-01-11 00:00:00"    # what the first run sees
_NUMBER_SQL = "CAST(substr(customer_id, 2) AS BIGINT)"
#: Redacted columns may be missing from retraining rows.
SPEC = replace(TRAINING, contract=Contract({n: ColumnSpec(c.type, c.required, n in ("customer_id", "country"), c.allowed)
                                            for n, c in TRAINING.contract.columns.items()}))


_contracts: dict[tuple[str, str], DataFrame] = {}


def _customers(spark, sf_dir):
    """The customers, built from the order history once per session and data: base, production and labels are parts of them."""
    seen = (spark.sparkContext.applicationId, sf_dir)
    if seen not in _contracts:
        _contracts[seen] = stored(b.customer_contract(spark, sf_dir).fillna({"monthly_charges": 0.0}), "customers")
    return _contracts[seen]


def _base(spark, sf_dir):
    return _customers(spark, sf_dir).where("tenure_months >= 63")


def _production(spark, sf_dir):
    new = _customers(spark, sf_dir).where("tenure_months < 63")
    return new.select(F.concat(F.lit("req-"), "customer_id").alias("request_id"), "segment", "tenure_months", "monthly_charges", "total_charges", "balance")


def _labels(spark, sf_dir):
    new = _customers(spark, sf_dir).where("tenure_months < 63 AND balance >= 0").withColumn("k", F.substring("customer_id", 2, 64).cast("bigint"))
    day = F.lit("2024-01-01 12:00:00").cast("timestamp")
    first = new.select("customer_id", F.col("churn_value").cast("int").alias("label"),
                       (day + F.make_interval(days=(F.col("k") % 20).cast("int"))).alias("labeled_at"))
    again = new.where("k % 25 = 1").select("customer_id", (1 - F.col("churn_value")).cast("int").alias("label"),
                                           (day + F.make_interval(days=(F.col("k") % 20 + 31).cast("int"))).alias("labeled_at"))
    return first.unionByName(again).withColumn("request_id", F.concat(F.lit("req-"), "customer_id")).drop("customer_id")


def _early(labels):
    return labels.where(F.col("labeled_at") < F.lit(FIRST_LABELS).cast("timestamp"))


_CC_SQL = "SELECT * REPLACE (coalesce(monthly_charges, 0.0::DOUBLE) AS monthly_charges) FROM customer_contract"
_CTES = [
    ("cc", _CC_SQL),
    ("base", "SELECT * FROM cc WHERE tenure_months >= 63"),
    ("newer", f"SELECT *, {_NUMBER_SQL} AS k FROM cc WHERE tenure_months < 63"),
    ("lab", """SELECT customer_id, k, CAST(churn_value AS INTEGER) AS label, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(k % 20 AS INTEGER)) AS lt
               FROM newer WHERE balance >= 0
               UNION ALL SELECT customer_id, k, CAST(1 - churn_value AS INTEGER), TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(k % 20 + 31 AS INTEGER))
               FROM newer WHERE balance >= 0 AND k % 25 = 1"""),
    ("latest", "SELECT customer_id, arg_max(label, lt) AS label, max(lt) AS lt FROM lab GROUP BY customer_id"),
    ("early", f"SELECT customer_id, arg_max(label, lt) AS label, max(lt) AS lt FROM lab WHERE lt < TIMESTAMP '{FIRST_LABELS}' GROUP BY customer_id"),
]
_ROW_SQL = "CAST(NULL AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS country, segment, tenure_months, monthly_charges, total_charges, balance"


@query("retraining_table", with_bindings(
    f"""SELECT customer_id, country, segment, tenure_months, round(monthly_charges, 6) AS monthly_charges, total_charges, balance,
               CAST(churn_value AS INTEGER) AS churn_value, 'base' AS added_by FROM base
        UNION ALL
        SELECT {_ROW_SQL.replace('monthly_charges', 'round(monthly_charges, 6)')}, l.label,
               CASE WHEN EXISTS (SELECT 1 FROM early e WHERE e.customer_id = l.customer_id AND e.lt = l.lt) THEN 'first' ELSE 'second' END
        FROM newer JOIN latest l USING (customer_id)""", "customer_contract", extra=_CTES))
def retraining_table(spark, sf_dir):
    """A8 + H1: the table after two runs, the second of which adds only what was labelled since the first; corrected labels count once.
    ``added_by`` is the run whose row counts."""
    path = scratch_path(spark, f"jobs/{uuid.uuid4().hex}/retraining")
    base, production, labels = _base(spark, sf_dir), _production(spark, sf_dir), _labels(spark, sf_dir)
    retraining.extend(spark, path, base, production, _early(labels), "churn_value", "first")
    retraining.extend(spark, path, base, production, labels, "churn_value", "second")
    rows, _ = read_training_table(spark, f"{path}/none", path)
    stored = spark.read.parquet(path)
    # a production row is known by its values here, as the training table does not carry request ids
    shared = ["segment", "tenure_months", "monthly_charges", "total_charges", "balance"]
    by = (stored.where(F.col(PART) != "base").groupBy(*shared).agg(F.max_by(PART, F.struct(LABELED_AT, PART)).alias("added_by")))
    joined = rows.alias("r").join(by.alias("p"), F.col("r.customer_id").isNull() & F.expr(
        " AND ".join(f"r.{c} <=> p.{c}" for c in shared)), "left")
    return joined.select("r.customer_id", "r.country", "r.segment", "r.tenure_months", F.round("r.monthly_charges", 6).alias("monthly_charges"),
                         "r.total_charges", "r.balance", F.col("r.churn_value").cast("int").alias("churn_value"),
                         F.coalesce("p.added_by", F.lit("base")).alias("added_by"))


@query("retraining_parts", with_bindings(
    """SELECT 'base' AS part, count(*) AS rows, CAST(sum(churn_value) AS BIGINT) AS positives FROM base
       UNION ALL SELECT 'first', count(*), CAST(sum(label) AS BIGINT) FROM early
       UNION ALL SELECT 'second', count(*), CAST(sum(l.label) AS BIGINT) FROM latest l LEFT JOIN early e ON e.customer_id = l.customer_id AND e.lt = l.lt
                 WHERE e.customer_id IS NULL""", "customer_contract", extra=_CTES))
def retraining_parts(spark, sf_dir):
    """What each run wrote; the second is replayed and replaces its own part."""
    path = scratch_path(spark, f"jobs/{uuid.uuid4().hex}/retraining")
    base, production, labels = _base(spark, sf_dir), _production(spark, sf_dir), _labels(spark, sf_dir)
    retraining.extend(spark, path, base, production, _early(labels), "churn_value", "first")
    for _ in range(2):
        retraining.extend(spark, path, base, production, labels, "churn_value", "second")
    return spark.read.parquet(path).groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), F.sum("churn_value").cast("bigint").alias("positives"))


VERSIONS = ["churn_model_20240101_000000", "churn_model_20240115_000000", "churn_model_20240301_000000"]
_cycles: dict[tuple[str, str], str] = {}


def _shifted(production, charges: int):
    """Production of the cycles: balances, in the second one also charges, far from anything trained on."""
    return production.withColumn("monthly_charges", F.col("monthly_charges") + charges).withColumn("balance", F.col("balance") + 50_000)


def _run_cycles(spark, sf_dir) -> str:
    """A job root after a first training, a cycle whose challenger is the first to serve, and one whose challenger is not good enough
    (no improvement reaches 10), each cycle run twice."""
    seen = (spark.sparkContext.applicationId, sf_dir)
    if seen not in _cycles:
        root = scratch_path(spark, f"jobs/{uuid.uuid4().hex}")
        raw = f"{root}/raw"
        _base(spark, sf_dir).write.parquet(raw)
        fast = ["logistic_regression"]
        jobs.training_run(spark, root, SPEC, VERSIONS[0], "2024-01-01 00:00:00", raw, f"{root}/retraining", which=fast)
        production, labels = _production(spark, sf_dir), _labels(spark, sf_dir)
        for _ in range(2):
            cycle.run_cycle(spark, root, SPEC, VERSIONS[1], "2024-01-15 00:00:00", raw, _shifted(production, 0), _early(labels), which=fast)
        for _ in range(2):
            cycle.run_cycle(spark, root, SPEC, VERSIONS[2], "2024-03-01 00:00:00", raw, _shifted(production, 500), labels, which=fast,
                            min_improvement=10.0)
        _cycles[seen] = root
    return _cycles[seen]


def _verdict_ctes() -> list[tuple[str, str]]:
    """Both cycles' verdicts: reference is the train part (the first 80 % by tenure) of what the serving model was fitted on."""
    charges = "coalesce(TRY_CAST(trim(total_charges) AS DOUBLE), 0.0::DOUBLE)"
    cols = ["tenure_months", "monthly_charges", "balance"]

    def long(source: str, run: int) -> str:
        parts = [f"SELECT {run} AS run, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in cols]
        parts.append(f"SELECT {run} AS run, 'total_charges' AS feature, {charges} AS value FROM {source}")
        return " UNION ALL ".join(parts)

    split = "row_number() OVER (ORDER BY tenure_months, customer_id) <= floor(0.8 * count(*) OVER ())"
    both = f"SELECT * FROM base UNION ALL BY NAME SELECT {_ROW_SQL}, l.label AS churn_value FROM shift1 JOIN early l USING (customer_id)"
    ctes = [("shift1", "SELECT * REPLACE (balance + 50000 AS balance) FROM newer"),
            ("fit1", f"SELECT * FROM (SELECT *, {split} AS fitted FROM base) WHERE fitted"),
            ("fit2", f"SELECT * FROM (SELECT *, {split} AS fitted FROM ({both})) WHERE fitted"),
            ("shift", "SELECT * REPLACE (monthly_charges + 500 AS monthly_charges, balance + 50000 AS balance) FROM newer"),
            ("c_ref", f"{long('fit1', 1)} UNION ALL {long('fit2', 2)}"), ("c_prod", f"{long('shift1', 1)} UNION ALL {long('shift', 2)}")]
    ctes += psi_ctes("c_ref", "c_prod", ["run"])
    used = f"n_production >= {DEFAULTS.min_production_samples}"
    ctes.append(("verdict", f"""SELECT run, count(*) FILTER (WHERE {used}) > 0 AND count(*) FILTER (WHERE {used} AND psi > {DEFAULTS.psi_threshold})
                                  >= {DEFAULTS.drift_feature_limit} AS retrain FROM psi GROUP BY run"""))
    ctes.append(("v", "SELECT bool_or(retrain) FILTER (WHERE run = 1) AS one, bool_or(retrain) FILTER (WHERE run = 2) AS two FROM verdict"))
    return ctes


@query("lifecycle_cycles", with_bindings(
    f"""SELECT '{VERSIONS[1]}' AS cycle, one AS retrained, one AS promoted, false AS rolled_back,
               CASE WHEN one THEN (SELECT count(*) FROM early) END AS rows_added, CASE WHEN one THEN 'first_deployment' END AS reason FROM v
        UNION ALL
        SELECT '{VERSIONS[2]}', two, two AND NOT one, one AND two, CASE WHEN two THEN
                 (SELECT count(*) FROM latest l LEFT JOIN early e ON one AND e.customer_id = l.customer_id AND e.lt = l.lt WHERE e.customer_id IS NULL) END,
               CASE WHEN two THEN CASE WHEN one THEN 'not_improved' ELSE 'first_deployment' END END FROM v""",
    "customer_contract", extra=_CTES + _verdict_ctes()))
def lifecycle_cycles(spark, sf_dir):
    """What two cycles did, from their step logs."""
    log = f"{_run_cycles(spark, sf_dir)}/cycle_log"
    rows = None
    for version in VERSIONS[1:]:
        part = spark.read.parquet(f"{log}/cycle={version}/step=outcome").select(
            F.lit(version).alias("cycle"), "retrained", "promoted", "rolled_back")
        rows = part if rows is None else rows.unionByName(part)
    read = lambda step, schema: spark.read.schema(schema).option("basePath", log).parquet(f"{log}/cycle=*/step={step}")
    added = read("retraining", "rows_added bigint, cycle string").select("cycle", "rows_added")
    gate = read("gate", "reason string, cycle string").select("cycle", "reason")
    return rows.join(added, "cycle", "left").join(gate, "cycle", "left").select(
        "cycle", "retrained", "promoted", "rolled_back", "rows_added", "reason")


@query("lifecycle_registry", with_bindings(
    f"""SELECT CAST(1 AS BIGINT) AS seq, 'promote' AS action, '{VERSIONS[1]}_logistic_regression' AS model_version, CAST(2 AS BIGINT) AS lineage_rows,
               'drift_retraining' AS "trigger", true AS from_table FROM v WHERE one
        UNION ALL SELECT CAST(2 AS BIGINT), 'rollback', '{VERSIONS[0]}_logistic_regression', CAST(2 AS BIGINT), 'training', false FROM v WHERE one AND two
        UNION ALL SELECT CAST(1 AS BIGINT), 'promote', '{VERSIONS[2]}_logistic_regression', CAST(2 AS BIGINT), 'drift_retraining', true FROM v WHERE two AND NOT one""",
    "customer_contract", extra=_CTES + _verdict_ctes()))
def lifecycle_registry(spark, sf_dir):
    """The registry after two cycles (each replayed), with the lineage row of every version that served."""
    root = _run_cycles(spark, sf_dir)
    lineage = spark.read.parquet(f"{root}/lineage")
    total = lineage.agg(F.count(F.lit(1)).alias("lineage_rows")).scalar()
    kinds = lineage.select("model_version", "trigger", F.col("dataset").endswith("/retraining").alias("from_table"))
    return cycle.registry(spark, root).join(kinds, "model_version", "left").select(
        "seq", "action", "model_version", total.alias("lineage_rows"), "trigger", "from_table")
