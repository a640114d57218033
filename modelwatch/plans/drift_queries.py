"""Drift and health queries (E1–E6, C4) and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from modelwatch.operators import drift
from modelwatch.operators.common import r6
from modelwatch.operators.health_table import HealthTable
from modelwatch.params import DEFAULTS
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.session import scratch_path
from modelwatch.sources.bindings import DRIFT_SPLIT, LINEITEM_FEATURES, family_lineitems, lineitem_wide, lineitem_wide_of
from modelwatch.sources.tables import table



def psi_ctes(ref: str, prod: str, by: list[str], bins: int = DEFAULTS.psi_bins,
             alpha: float = DEFAULTS.psi_smoothing) -> list[tuple[str, str]]:
    """DuckDB CTEs computing per-group PSI cells by explicit edge lists."""
    keys = ", ".join(by + ["feature"])
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in by + ["feature"])
    slots = bins + 2
    return [
        ("r", f"SELECT {keys}, value FROM {ref} WHERE value IS NOT NULL AND NOT isnan(value)"),
        ("p", f"SELECT {keys}, value FROM {prod} WHERE value IS NOT NULL AND NOT isnan(value)"),
        ("mm", f"SELECT {keys}, min(value) AS lo0, max(value) AS hi0, count(*) AS n_reference FROM r GROUP BY {keys}"),
        ("ed", f"""SELECT {keys}, n_reference, lo, hi,
                   list_transform(range(0, {bins + 1}), lambda i: CASE WHEN i = {bins} THEN hi
                                  ELSE i * ((hi - lo) / {bins}::DOUBLE) + lo END) AS edges
                   FROM (SELECT {keys}, n_reference,
                                CASE WHEN lo0 = hi0 THEN lo0 - 0.5::DOUBLE ELSE lo0 END AS lo,
                                CASE WHEN lo0 = hi0 THEN hi0 + 0.5::DOUBLE ELSE hi0 END AS hi FROM mm)"""),
        ("rc", f"""SELECT {', '.join('a.' + k for k in by + ['feature'])},
                   CASE WHEN a.value < b.lo THEN 0 WHEN a.value > b.hi THEN {bins + 1} WHEN a.value = b.hi THEN {bins}
                        ELSE len(list_filter(b.edges, lambda x: x <= a.value)) END AS bin, count(*) AS c
                   FROM r a JOIN ed b ON {on} GROUP BY ALL"""),
        ("pc", f"""SELECT {', '.join('a.' + k for k in by + ['feature'])},
                   CASE WHEN a.value < b.lo THEN 0 WHEN a.value > b.hi THEN {bins + 1} WHEN a.value = b.hi THEN {bins}
                        ELSE len(list_filter(b.edges, lambda x: x <= a.value)) END AS bin, count(*) AS c
                   FROM p a JOIN ed b ON {on} GROUP BY ALL"""),
        ("cells", f"""SELECT {', '.join('g.' + k for k in by + ['feature'])}, g.bin, g.n_reference,
                      coalesce(rc.c, 0) AS ref_count, coalesce(pc.c, 0) AS prod_count
                      FROM (SELECT {keys}, n_reference, t.range AS bin FROM ed CROSS JOIN range(0, {slots}) t) g
                      LEFT JOIN rc ON {' AND '.join(f'g.{k} IS NOT DISTINCT FROM rc.{k}' for k in by + ['feature'])} AND g.bin = rc.bin
                      LEFT JOIN pc ON {' AND '.join(f'g.{k} IS NOT DISTINCT FROM pc.{k}' for k in by + ['feature'])} AND g.bin = pc.bin"""),
        ("tot", f"SELECT {keys}, CAST(sum(prod_count) AS BIGINT) AS n_production FROM cells GROUP BY {keys}"),
        ("shares", f"""SELECT c.*, t.n_production,
                       (c.ref_count + {alpha}::DOUBLE) / (c.n_reference + {alpha * slots}::DOUBLE) AS e,
                       (c.prod_count + {alpha}::DOUBLE) / (t.n_production + {alpha * slots}::DOUBLE) AS a
                       FROM cells c JOIN tot t ON {' AND '.join(f'c.{k} IS NOT DISTINCT FROM t.{k}' for k in by + ['feature'])}"""),
        ("psi", f"""SELECT {keys}, CAST(any_value(n_reference) AS BIGINT) AS n_reference,
                    CAST(any_value(n_production) AS BIGINT) AS n_production,
                    CASE WHEN any_value(n_production) > 0 THEN sum((a - e) * ln(a / e)) END AS psi
                    FROM shares GROUP BY {keys}
                    UNION ALL
                    SELECT {', '.join('a.' + k for k in by + ['feature'])}, 0, count(*), CAST(NULL AS DOUBLE)
                    FROM p a LEFT JOIN ed b ON {on} WHERE b.n_reference IS NULL
                    GROUP BY {', '.join('a.' + k for k in by + ['feature'])}"""),
    ]


def report_ctes(threshold: float = DEFAULTS.psi_threshold, min_samples: int = DEFAULTS.min_production_samples):
    return [("report", f"""SELECT *, CASE WHEN n_reference = 0 THEN 'no_reference'
                                          WHEN n_production < {min_samples} THEN 'insufficient'
                                          WHEN psi > {threshold} THEN 'DRIFT' ELSE 'STABLE' END AS status,
                                     CASE WHEN n_reference = 0 OR n_production < {min_samples} THEN NULL
                                          WHEN psi < 0.10 THEN 'nominal' WHEN psi <= 0.20 THEN 'moderate'
                                          ELSE 'significant' END AS severity
                              FROM psi""")]


def _report_sql(prod: str, by: list[str]) -> str:
    keys = ", ".join(by + ["feature"])
    body = f"""SELECT {keys}, n_reference, n_production,
                      round(CASE WHEN status IN ('DRIFT', 'STABLE') THEN psi END, 6) AS psi, status, severity
               FROM report"""
    return with_bindings(body, "reference_rows", prod,
                         extra=psi_ctes("reference_rows", prod, by) + report_ctes())


def family_health_ctes() -> list[tuple[str, str]]:
    """CTEs up to ``health``: the E5 verdict of every customer's model family, from its own lineitems."""
    return psi_ctes("family_reference", "family_production", ["model_name"]) + report_ctes() + [
        ("health", f"""SELECT f.model_name, coalesce(h.status, 'unknown') AS status,
                              CAST(coalesce(h.drifting, 0) AS BIGINT) AS drifting_feature_count,
                              coalesce(h.used > 0 AND h.drifting >= {DEFAULTS.drift_feature_limit}, false) AS retraining_recommended
                       FROM (SELECT CAST(c_custkey AS VARCHAR) AS model_name FROM customer) f
                       LEFT JOIN (SELECT model_name, count(*) FILTER (WHERE status IN ('DRIFT', 'STABLE')) AS used,
                                         count(*) FILTER (WHERE status = 'DRIFT') AS drifting,
                                         CASE WHEN sum(n_reference) = 0 OR sum(n_production) = 0 THEN 'unknown'
                                              WHEN count(*) FILTER (WHERE status IN ('DRIFT', 'STABLE')) = 0 THEN 'insufficient_data'
                                              ELSE 'evaluated' END AS status
                                  FROM report GROUP BY model_name) h USING (model_name)""")]


def family_health(spark, sf_dir):
    """E5 per model family (one per customer) with ``unknown`` where a side is missing (A4)."""
    wide = family_lineitems(spark, sf_dir)
    ref, prod = wide.where("is_reference"), wide.where("NOT is_reference")
    report = drift.drift_report_wide(ref, prod, list(LINEITEM_FEATURES), ["model_name"])
    families = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("model_name"))
    return drift.with_unknown(families, drift.model_health(report, ["model_name"]), ["model_name"])


def _health_sql(prod: str, by: list[str]) -> str:
    sel = ", ".join(by) + ", " if by else ""
    grp = f"GROUP BY {', '.join(by)}" if by else ""
    body = f"""SELECT {sel}
          CASE WHEN sum(n_reference) = 0 OR sum(n_production) = 0 THEN 'unknown'
               WHEN count(*) FILTER (WHERE status IN ('DRIFT', 'STABLE')) = 0 THEN 'insufficient_data' ELSE 'evaluated' END AS status,
          CAST(count(*) FILTER (WHERE status = 'DRIFT') AS BIGINT) AS drifting_feature_count,
          coalesce(array_to_string(list_sort(list(feature || ':' || printf('%.4f', round(psi, 4))) FILTER (WHERE status = 'DRIFT')), ','), '') AS drifting_features,
          coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE status IN ('DRIFT', 'STABLE'))), ','), '') AS evaluated_features,
          coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE status NOT IN ('DRIFT', 'STABLE'))), ','), '') AS skipped_features,
          count(*) FILTER (WHERE status IN ('DRIFT', 'STABLE')) > 0
              AND count(*) FILTER (WHERE status = 'DRIFT') >= {DEFAULTS.drift_feature_limit} AS retraining_recommended
        FROM report {grp}"""
    return with_bindings(body, "reference_rows", prod,
                         extra=psi_ctes("reference_rows", prod, by) + report_ctes())


def _report(spark, sf_dir, prod_side: str, by: list[str]):
    ref = lineitem_wide(spark, sf_dir, "reference")
    prod = lineitem_wide(spark, sf_dir, prod_side)
    rep = drift.drift_report_wide(ref, prod, list(LINEITEM_FEATURES), by)
    return rep.select(*by, "feature", "n_reference", "n_production", r6("psi").alias("psi"), "status", "severity")


@query("psi_report", _report_sql("production_rows", []))
def psi_report(spark, sf_dir):
    """Flagship: PSI per lineitem measure, reference before the split date against production after."""
    return _report(spark, sf_dir, "production", [])


@query("psi_report_biased", _report_sql("production_biased", []))
def psi_report_biased(spark, sf_dir):
    return _report(spark, sf_dir, "production_biased", [])


@query("psi_by_segment", _report_sql("production_biased", ["segment"]))
def psi_by_segment(spark, sf_dir):
    return _report(spark, sf_dir, "production_biased", ["segment"])


_BINS_SQL = with_bindings(
    """SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(ref_count AS BIGINT) AS ref_count,
              CAST(prod_count AS BIGINT) AS prod_count,
              round(e, 6) AS expected_share, round(a, 6) AS actual_share,
              round((a - e) * ln(a / e), 6) AS term
       FROM shares""",
    "reference_rows", "production_biased",
    extra=psi_ctes("reference_rows", "production_biased", []),
)


@query("psi_bins", _BINS_SQL)
def psi_bins(spark, sf_dir):
    ref = lineitem_wide(spark, sf_dir, "reference")
    prod = lineitem_wide(spark, sf_dir, "production_biased")
    cells = drift.psi_contributions(drift.bin_counts_wide(ref, prod, list(LINEITEM_FEATURES)))
    return cells.select(
        "feature", F.col("bin").cast("int").alias("bin"), "ref_count", "prod_count",
        r6("expected_share").alias("expected_share"), r6("actual_share").alias("actual_share"),
        r6("term").alias("term"),
    )


def _health(spark, sf_dir, prod_side: str, by: list[str]):
    ref = lineitem_wide(spark, sf_dir, "reference")
    prod = lineitem_wide(spark, sf_dir, prod_side)
    return drift.model_health(drift.drift_report_wide(ref, prod, list(LINEITEM_FEATURES), by), by)


@query("model_health", _health_sql("production_biased", []))
def model_health(spark, sf_dir):
    """E5 over the biased production slice: a retrain verdict."""
    return _health(spark, sf_dir, "production_biased", [])


@query("model_health_by_segment", _health_sql("production_rows", ["segment"]))
def model_health_by_segment(spark, sf_dir):
    return _health(spark, sf_dir, "production", ["segment"])


@query("model_health_insufficient", _health_sql("production_recent", ["segment"]))
def model_health_insufficient(spark, sf_dir):
    """Per-segment health over the recent window only: thin slices come out ``insufficient``."""
    return _health(spark, sf_dir, "production_recent", ["segment"])


@query("model_health_by_family", with_bindings(
    "SELECT model_name, status, drifting_feature_count, retraining_recommended FROM health",
    "family_reference", "family_production", extra=family_health_ctes()))
def model_health_by_family(spark, sf_dir):
    """A4 → E5: the verdict of every family, ``unknown`` for those without reference or production rows."""
    return family_health(spark, sf_dir)


#: The first of the two runs of the incremental queries sees what was shipped before this time, in the middle of a month.
_FIRST_RUN = "2001-02-14 12:00:00"


def _health_table(spark, sf_dir) -> HealthTable:
    """A health table by month after two runs: up to the middle of a month, then over everything, which reads that month and later ones."""
    li = table(spark, sf_dir, "lineitem").withColumn("period", F.trunc("l_shipdate", "month"))
    state = HealthTable(spark, scratch_path(spark, f"health/{uuid.uuid4().hex}"), list(LINEITEM_FEATURES), ["segment"])
    state.set_reference(lineitem_wide(spark, sf_dir, "reference"))
    early = li.where(F.col("l_shipdate") < F.lit(_FIRST_RUN).cast("timestamp"))
    state.extend(lineitem_wide_of(early, "production", "period"), "period")
    state.extend(lineitem_wide_of(li, "production", "period"), "period")
    return state


@query("psi_incremental", _report_sql("production_rows", ["segment"]))
def psi_incremental(spark, sf_dir):
    """E2–E4 from stored counts that two runs extended: the figures of a report over all rows."""
    rep = _health_table(spark, sf_dir).report()
    return rep.select("segment", "feature", "n_reference", "n_production", r6("psi").alias("psi"), "status", "severity")


@query("health_periods", with_bindings(
    f"""SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS period, feature, count(*) AS n
        FROM (SELECT l_shipdate, unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS feature,
                     unnest([l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[]) AS value
              FROM lineitem WHERE l_shipdate >= TIMESTAMP '{DRIFT_SPLIT}') WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL"""))
def health_periods(spark, sf_dir):
    """The stored months: every value is counted once, also in the month at which the first run ended."""
    rows = _health_table(spark, sf_dir).period_counts()
    return rows.groupBy(F.date_format("period", "yyyy-MM-dd").alias("period"), "feature").agg(F.sum("prod_count").alias("n"))
