"""Lifecycle (G5, G6, H2, H3, L1–L5) and outbox (I2–I5) queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.operators import lifecycle as lc
from modelwatch.operators import outbox as ob
from modelwatch.operators.common import stored
from modelwatch.plans.drift_queries import family_health, family_health_ctes
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.sources import bindings as b

_DTS = "'%Y-%m-%d %H:%M:%S'"
_TS = "yyyy-MM-dd HH:mm:ss"


# ---------------------------------------------------------------- lifecycle

_LATEST_SQL = r"""SELECT model_name, max(model_version) AS model_version,
                         arg_max_null(pr_auc, model_version) AS pr_auc, arg_max_null(feature_schema, model_version) AS feature_schema
                  FROM model_versions
                  WHERE regexp_matches(model_version, '^churn_model_\d{8}_\d{6}$') AND has_metadata
                  GROUP BY model_name"""


@query("latest_experiment", with_bindings("SELECT model_name, model_version FROM latest", "model_versions",
                                          extra=[("latest", _LATEST_SQL)]))
def latest_experiment(spark, sf_dir):
    """Per family the newest complete, well-named experiment."""
    return lc.latest_experiment(b.model_versions(spark, sf_dir)).select("model_name", "model_version")


_PREV_CTES = [
    ("cur", """SELECT model_name, arg_max(model_version, (ts, seq)) AS current_version, count(*) AS lineage_rows
               FROM lineage GROUP BY model_name"""),
    ("prev", """SELECT l.model_name, arg_max(l.model_version, (l.ts, l.seq)) AS previous_version
                FROM lineage l JOIN cur c ON l.model_name = c.model_name
                WHERE l.model_version IS NOT NULL AND l.model_version <> '' AND l.model_version <> c.current_version
                GROUP BY l.model_name"""),
]


@query("previous_version", with_bindings(
    """SELECT c.model_name, c.current_version, CAST(c.lineage_rows AS BIGINT) AS lineage_rows, p.previous_version
       FROM cur c LEFT JOIN prev p USING (model_name)""", "lineage", extra=_PREV_CTES))
def previous_version(spark, sf_dir):
    """The latest version different from the current one, walking back past repeats."""
    return lc.previous_version(b.lineage(spark, sf_dir)).select(
        "model_name", "current_version", "lineage_rows", "previous_version")


_GATE_CTES = [
    ("latest", _LATEST_SQL),
    ("fam", "SELECT DISTINCT model_name FROM model_versions"),
    ("g", """SELECT f.model_name, l.model_version AS challenger_version, c.model_version AS champion_version,
                    l.pr_auc AS ch_m, c.pr_auc AS cp_m, l.feature_schema AS ch_schema, c.feature_schema AS cp_schema,
                    list_sort(list_distinct(list_filter(coalesce(l.feature_schema, []), lambda x: NOT list_contains(coalesce(c.feature_schema, []), x)))) AS added,
                    list_sort(list_distinct(list_filter(coalesce(c.feature_schema, []), lambda x: NOT list_contains(coalesce(l.feature_schema, []), x)))) AS removed
             FROM fam f LEFT JOIN latest l USING (model_name) LEFT JOIN production_models c USING (model_name)"""),
    ("gate", """SELECT *, CASE WHEN challenger_version IS NULL THEN 'no_experiment'
                               WHEN champion_version IS NULL THEN 'first_deployment'
                               WHEN len(removed) > 0 THEN 'removed_features'
                               WHEN ch_m IS NULL OR cp_m IS NULL THEN 'metric_missing'
                               WHEN ch_m - cp_m >= 0 AND ch_m - cp_m > 0 THEN 'improved'
                               ELSE 'not_improved' END AS reason
                FROM g"""),
]


@query("schema_diff", with_bindings(
    """SELECT model_name, array_to_string(added, ',') AS added_features, array_to_string(removed, ',') AS removed_features,
              len(added) = 0 AND len(removed) = 0 AS is_identical
       FROM g WHERE challenger_version IS NOT NULL AND champion_version IS NOT NULL""",
    "model_versions", "production_models", extra=_GATE_CTES[:3]))
def schema_diff(spark, sf_dir):
    """H2: added / removed features (as sets) between the serving model and the latest experiment."""
    ch = lc.latest_experiment(b.model_versions(spark, sf_dir))
    cp = b.production_models(spark, sf_dir)
    j = ch.select("model_name", F.col("feature_schema").alias("ch")).join(
        cp.select("model_name", F.col("feature_schema").alias("cp")), "model_name")
    added, removed, same = lc.schema_diff(F.col("cp"), F.col("ch"))
    return j.select("model_name", F.array_join(added, ",").alias("added_features"),
                    F.array_join(removed, ",").alias("removed_features"), same.alias("is_identical"))


@query("ordered_match", with_bindings(
    """SELECT model_name, coalesce(cp_schema, []) = coalesce(ch_schema, []) AS schemas_match
       FROM g WHERE challenger_version IS NOT NULL AND champion_version IS NOT NULL""",
    "model_versions", "production_models", extra=_GATE_CTES[:3]))
def ordered_match(spark, sf_dir):
    """H3: exact ordered feature-schema equality between serving model and latest experiment."""
    ch = lc.latest_experiment(b.model_versions(spark, sf_dir))
    cp = b.production_models(spark, sf_dir)
    j = ch.select("model_name", F.col("feature_schema").alias("ch")).join(
        cp.select("model_name", F.col("feature_schema").alias("cp")), "model_name")
    return j.select("model_name", lc.ordered_match(F.col("cp"), F.col("ch")).alias("schemas_match"))


def _gate(spark, sf_dir):
    mv = b.model_versions(spark, sf_dir)
    return lc.promotion_gate(mv, lc.latest_experiment(mv), b.production_models(spark, sf_dir))


@query("promotion_gate", with_bindings(
    """SELECT model_name, challenger_version, champion_version,
              array_to_string(added, ',') AS added_features, array_to_string(removed, ',') AS removed_features,
              round(ch_m - cp_m, 6) AS improvement, reason,
              CASE WHEN reason IN ('first_deployment', 'improved') THEN 'promote'
                   WHEN reason = 'not_improved' THEN 'retain' ELSE 'reject' END AS decision
       FROM gate""", "model_versions", "production_models", extra=_GATE_CTES))
def promotion_gate(spark, sf_dir):
    """L1 (C5 inside): champion / challenger decision and reason per model family."""
    g = _gate(spark, sf_dir)
    return g.select("model_name", "challenger_version", "champion_version",
                    F.coalesce("added_features", F.lit("")).alias("added_features"),
                    F.coalesce("removed_features", F.lit("")).alias("removed_features"),
                    F.round("improvement", 6).alias("improvement"), "reason", "decision")


_CHECK_SQL = """SELECT model_name, challenger_version, champion_version AS parent_model,
                       reason IN ('first_deployment', 'improved') AS gate_passed,
                       reason IN ('first_deployment', 'improved')
                         AND (champion_version IS NULL OR coalesce(cp_schema, []) = coalesce(ch_schema, [])) AS promoted,
                       CASE WHEN reason IN ('first_deployment', 'improved') AND NOT
                              (champion_version IS NULL OR coalesce(cp_schema, []) = coalesce(ch_schema, []))
                            THEN 'schema_mismatch' END AS refusal
                FROM gate"""


@query("promotion_check", with_bindings(_CHECK_SQL, "model_versions", "production_models", extra=_GATE_CTES))
def promotion_check(spark, sf_dir):
    """L2: promotions pass only with an exact ordered schema match; the parent is the serving version."""
    return lc.promotion_check(_gate(spark, sf_dir)).drop("ch_metrics")


def _bundles(spark, sf_dir):
    """Bundles that still exist: versions recorded by a finished (drift-triggered) run."""
    return b.lineage(spark, sf_dir).where(F.col("trigger") == "drift").select("model_name", "model_version")


_ROLLBACK_CTES = _PREV_CTES + family_health_ctes() + [
    ("bundles", "SELECT DISTINCT model_name, model_version FROM lineage WHERE trigger = 'drift'"),
    ("rb", """SELECT h.model_name, c.current_version, p.previous_version, CAST(coalesce(c.lineage_rows, 0) AS BIGINT) AS lineage_rows,
                     CASE WHEN NOT coalesce(h.retraining_recommended, false) THEN 'healthy'
                          WHEN coalesce(c.lineage_rows, 0) < 2 THEN 'no_history'
                          WHEN p.previous_version IS NULL THEN 'single_version'
                          WHEN bu.model_version IS NULL THEN 'bundle_missing'
                          ELSE 'rollback' END AS reason
              FROM health h LEFT JOIN cur c USING (model_name) LEFT JOIN prev p USING (model_name)
              LEFT JOIN bundles bu ON bu.model_name = h.model_name AND bu.model_version = p.previous_version"""),
]


@query("rollback_target", with_bindings(
    "SELECT model_name, current_version, previous_version, lineage_rows, reason, reason = 'rollback' AS rolled_back FROM rb",
    "lineage", "family_reference", "family_production", extra=_ROLLBACK_CTES))
def rollback_target(spark, sf_dir):
    """L4: per family the version a rollback restores, or why there is none."""
    return lc.rollback_target(family_health(spark, sf_dir), b.lineage(spark, sf_dir), _bundles(spark, sf_dir))


@query("cycle_decision", with_bindings(
    f"""SELECT h.model_name, coalesce(h.retraining_recommended, false) AS retrained,
               coalesce(h.retraining_recommended, false) AND coalesce(k.promoted, false) AS promoted,
               NOT (coalesce(h.retraining_recommended, false) AND coalesce(k.promoted, false))
                 AND coalesce(rb.reason = 'rollback', false) AS rolled_back
        FROM health h LEFT JOIN ({_CHECK_SQL}) k USING (model_name) LEFT JOIN rb USING (model_name)""",
    "lineage", "family_reference", "family_production", "model_versions", "production_models",
    extra=_GATE_CTES + _ROLLBACK_CTES))
def cycle_decision(spark, sf_dir):
    """Per family what one lifecycle cycle does: retrain, promote, roll back."""
    health = stored(family_health(spark, sf_dir), "family-health")
    rb = lc.rollback_target(health, b.lineage(spark, sf_dir), _bundles(spark, sf_dir))
    return lc.cycle_decision(health, _gate(spark, sf_dir), rb)


# ------------------------------------------------------------------- outbox

def _now():
    return F.lit(b.NOW).cast("timestamp")


_CLAIMABLE = f"""SELECT *, row_number() OVER (ORDER BY created_at, id) AS pos FROM outbox
                 WHERE processed_at IS NULL AND attempts < 5
                   AND (claimed_at IS NULL OR claimed_at < TIMESTAMP '{b.NOW}' - INTERVAL 60 SECOND)"""


@query("claim_batch", with_bindings(
    f"""SELECT id, CAST(attempts + 1 AS INTEGER) AS attempts, '{b.NOW}' AS claimed_at FROM cl WHERE pos <= 50""",
    "outbox", extra=[("cl", _CLAIMABLE)]))
def claim_batch(spark, sf_dir):
    """The oldest 50 claimable outbox rows get a lease and one more attempt."""
    claimed, _ = ob.claim_batch(b.outbox(spark, sf_dir), _now())
    return claimed.select("id", "attempts", F.date_format("claimed_at", _TS).alias("claimed_at"))


@query("claim_rounds", with_bindings(
    "SELECT CASE WHEN pos <= 50 THEN 1 ELSE 2 END AS round, id FROM cl WHERE pos <= 100",
    "outbox", extra=[("cl", _CLAIMABLE)]))
def claim_rounds(spark, sf_dir):
    """I3 twice (a second worker one second later): the two claims are disjoint."""
    now = _now()
    first, after = ob.claim_batch(b.outbox(spark, sf_dir), now)
    second, _ = ob.claim_batch(after, now + F.expr("INTERVAL 1 SECOND"))
    return first.select(F.lit(1).alias("round"), "id").unionByName(second.select(F.lit(2).alias("round"), "id"))


@query("settle_claims", with_bindings(
    f"""SELECT id, id % 2 = 0 AS processed, id % 2 = 0 AS lease_held FROM cl WHERE pos <= 50""",
    "outbox", extra=[("cl", _CLAIMABLE)]))
def settle_claims(spark, sf_dir):
    """I4: a claimed batch settles: even ids delivered (processed), odd ids failed (lease released)."""
    now = _now()
    claimed, after = ob.claim_batch(b.outbox(spark, sf_dir), now)
    results = claimed.select("id", (F.col("id") % 2 == 0).alias("ok"))
    settled = ob.settle(after, results, now)
    return settled.join(claimed.select("id"), "id", "left_semi").select(
        "id", F.col("processed_at").isNotNull().alias("processed"), F.col("claimed_at").isNotNull().alias("lease_held"))


@query("dead_letters", with_bindings(
    "SELECT id, event_type, attempts FROM outbox WHERE processed_at IS NULL AND attempts >= 5", "outbox"))
def dead_letters(spark, sf_dir):
    """Unprocessed rows whose attempts are exhausted (never claimed again)."""
    return ob.dead_letters(b.outbox(spark, sf_dir)).select("id", "event_type", "attempts")


@query("outbox_backlog", with_bindings(
    f"""SELECT event_type, CASE WHEN processed_at IS NOT NULL THEN 'processed'
                                WHEN attempts >= 5 THEN 'exhausted'
                                WHEN claimed_at IS NOT NULL AND claimed_at >= TIMESTAMP '{b.NOW}' - INTERVAL 60 SECOND THEN 'leased'
                                ELSE 'claimable' END AS state,
               CAST(count(*) AS BIGINT) AS rows
        FROM outbox GROUP BY ALL""", "outbox"))
def outbox_backlog(spark, sf_dir):
    """Outbox state per event type at the fixed ``now``."""
    return ob.backlog(b.outbox(spark, sf_dir), _now())
