"""DuckDB twins of ``sources.bindings``: common table expressions over the driver views.

Written independently of the Spark code (plain SQL), so the oracle check compares
two implementations. Numeric literals carry ``::DOUBLE`` because DuckDB reads
``1.5`` as DECIMAL.
"""

from __future__ import annotations

from modelwatch.sources.bindings import (
    CHURN_HORIZON_DAYS,
    CONTRACT_CUTOFF,
    DRIFT_SPLIT,
    NOW,
    PROB_SCALE,
    RECENT_FROM,
    SPEND_FROM,
)

_LI_FEATURES = [("quantity", "l_quantity"), ("extendedprice", "l_extendedprice"),
                ("discount", "l_discount"), ("tax", "l_tax")]


_SEGMENT = (f"CASE WHEN l_orderkey % 29 = 0 AND l_shipdate >= TIMESTAMP '{DRIFT_SPLIT}' THEN 'new' "
            "WHEN l_orderkey % 13 <> 0 THEN l_returnflag END")


def _lineitem_long(cond: str) -> str:
    parts = [
        f"SELECT {_SEGMENT} AS segment, '{name}' AS feature, CAST({src} AS DOUBLE) AS value FROM lineitem WHERE {cond}"
        for name, src in _LI_FEATURES
    ]
    return "\nUNION ALL\n".join(parts)


def _lineitem_wide(cond: str) -> str:
    cols = ", ".join(f"{src} AS {name}" for name, src in _LI_FEATURES)
    return f"SELECT {_SEGMENT} AS segment, {cols} FROM lineitem WHERE {cond}"


def _family_long(cond: str) -> str:
    parts = [f"""SELECT CAST(o_custkey AS VARCHAR) AS model_name, '{name}' AS feature, CAST({src} AS DOUBLE) AS value
                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {cond}""" for name, src in _LI_FEATURES]
    return "\nUNION ALL\n".join(parts)


_SPLIT = f"TIMESTAMP '{DRIFT_SPLIT}'"
_BIASED = f"l_shipdate >= {_SPLIT} AND l_quantity > 25 AND l_discount >= 0.05"

CTE: dict[str, str] = {
    "reference_rows": _lineitem_long(f"l_shipdate < {_SPLIT}"),
    "production_rows": _lineitem_long(f"l_shipdate >= {_SPLIT}"),
    "production_biased": _lineitem_long(_BIASED),
    "production_recent": _lineitem_long(f"l_shipdate >= TIMESTAMP '{RECENT_FROM}'"),
    "family_reference": _family_long(f"l_shipdate < {_SPLIT}"),
    "family_production": _family_long(f"l_shipdate >= {_SPLIT} AND o_custkey % 7 <> 0"),
    "reference_wide": _lineitem_wide(f"l_shipdate < {_SPLIT}"),
    "production_wide": _lineitem_wide(f"l_shipdate >= {_SPLIT}"),
    "production_biased_wide": _lineitem_wide(_BIASED),
    "customer_contract": f"""
        SELECT 'C' || CAST(c_custkey AS VARCHAR) AS customer_id,
               n_name AS country,
               c_mktsegment AS segment,
               CAST(coalesce(floor(date_diff('day', pc.first_order, DATE '{CONTRACT_CUTOFF}') / 30), 0) AS BIGINT) AS tenure_months,
               CASE WHEN pc.n_hist > 0 THEN (pc.cents // pc.n_hist) / 100000.0::DOUBLE END AS monthly_charges,
               coalesce(CAST(pc.spend AS VARCHAR), ' ') AS total_charges,
               c_acctbal AS balance,
               CAST(CASE WHEN coalesce(pc.future, 0) = 0 THEN 1 ELSE 0 END AS BIGINT) AS churn_value
        FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (
            SELECT o_custkey,
                   min(CAST(o_orderdate AS DATE)) FILTER (WHERE CAST(o_orderdate AS DATE) < DATE '{CONTRACT_CUTOFF}') AS first_order,
                   sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE CAST(o_orderdate AS DATE) < DATE '{CONTRACT_CUTOFF}') AS cents,
                   count(*) FILTER (WHERE CAST(o_orderdate AS DATE) < DATE '{CONTRACT_CUTOFF}') AS n_hist,
                   sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (
                       WHERE CAST(o_orderdate AS DATE) >= DATE '{SPEND_FROM}'
                         AND CAST(o_orderdate AS DATE) < DATE '{CONTRACT_CUTOFF}') AS spend,
                   count(*) FILTER (
                       WHERE CAST(o_orderdate AS DATE) >= DATE '{CONTRACT_CUTOFF}'
                         AND CAST(o_orderdate AS DATE) < DATE '{CONTRACT_CUTOFF}' + INTERVAL {CHURN_HORIZON_DAYS} DAY) AS future
            FROM orders GROUP BY o_custkey
        ) pc ON pc.o_custkey = c_custkey""",
    "prediction_events": f"""
        SELECT event_id,
               'req-' || CAST(event_id AS VARCHAR) AS request_id,
               ts AS created_at,
               event_type AS model_version,
               round(value / (value + {PROB_SCALE}::DOUBLE), 4) AS probability,
               CAST(round(value / (value + {PROB_SCALE}::DOUBLE), 4) >= 0.5 AS INTEGER) AS prediction,
               value / 100.0::DOUBLE AS latency_seconds,
               CAST(json_extract_string(props, '$.k') AS VARCHAR) AS feature_k,
               CAST(value AS VARCHAR) AS feature_value,
               CAST(user_id AS VARCHAR) AS subject_id
        FROM events""",
    "feedback": f"""
        SELECT 'req-' || CAST(event_id AS VARCHAR) AS request_id,
               CAST((event_id * 7919) % 1000 < value / (value + {PROB_SCALE}::DOUBLE) * 1000 AS INTEGER) AS label,
               ts + INTERVAL 1 DAY AS labeled_at
        FROM events WHERE event_id % 5 < 2
        UNION ALL
        SELECT 'req-' || CAST(event_id AS VARCHAR),
               1 - CAST((event_id * 7919) % 1000 < value / (value + {PROB_SCALE}::DOUBLE) * 1000 AS INTEGER),
               ts + INTERVAL 2 DAY
        FROM events WHERE event_id % 5 < 2 AND event_id % 25 = 1
        UNION ALL
        SELECT 'req-x' || CAST(event_id AS VARCHAR),
               CAST((event_id * 7919) % 1000 < value / (value + {PROB_SCALE}::DOUBLE) * 1000 AS INTEGER),
               ts + INTERVAL 1 DAY
        FROM events WHERE event_id % 5 < 2 AND event_id % 50 = 0
        UNION ALL
        SELECT 'req-' || CAST(event_id AS VARCHAR), CAST(CASE WHEN event_id % 2 = 0 THEN 7 END AS INTEGER),
               ts + INTERVAL 60 HOUR
        FROM events WHERE event_id % 5 < 2 AND event_id % 45 = 0""",
    "document_scores": """
        SELECT d.doc_id, d.lang AS model_version,
               1.0::DOUBLE / (1.0::DOUBLE + d.n_chars / 1475.0::DOUBLE) AS probability,
               l.quality AS label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "outbox": f"""
        SELECT event_id AS id, ts AS created_at,
               CASE WHEN event_type = 'purchase' THEN 'prediction_labeled' ELSE 'prediction_made' END AS event_type,
               CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 MINUTE END AS processed_at,
               CASE WHEN event_id % 4 = 1 THEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR
                    WHEN event_id % 4 = 2 THEN TIMESTAMP '{NOW}' - INTERVAL 10 SECOND END AS claimed_at,
               CAST(event_id % 7 AS INTEGER) AS attempts
        FROM events""",
    "request_log": """
        SELECT ts, '/' || event_type AS path, 'POST' AS method,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
               CAST(user_id AS VARCHAR) AS client,
               value / 100.0::DOUBLE AS latency_seconds
        FROM events""",
    "lineage": """
        SELECT CAST(o_custkey AS VARCHAR) AS model_name, o_orderpriority AS model_version,
               o_orderdate AS ts, o_orderkey AS seq,
               CASE WHEN o_orderstatus = 'F' THEN 'drift' ELSE 'manual' END AS trigger
        FROM orders""",
    "model_versions": """
        SELECT CAST(o_custkey AS VARCHAR) AS model_name,
               CASE WHEN o_orderkey % 11 = 0 THEN 'churn_model_' || strftime(o_orderdate, '%Y%m%d')
                    ELSE 'churn_model_' || strftime(o_orderdate + INTERVAL (o_orderkey // 1000000) DAY, '%Y%m%d') || '_' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')
               END AS model_version,
               o_orderdate AS created_at,
               o_orderkey % 13 <> 0 AS has_metadata,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE END AS pr_auc,
               ((o_orderkey * 53) % 1000) / 1000.0::DOUBLE AS roc_auc,
               CASE o_orderkey % 6
                    WHEN 1 THEN ['tenure_months', 'monthly_charges', 'total_charges', 'balance', 'segment', 'country']
                    WHEN 2 THEN ['tenure_months', 'monthly_charges', 'total_charges', 'balance']
                    WHEN 3 THEN ['segment', 'balance', 'total_charges', 'monthly_charges', 'tenure_months']
                    WHEN 5 THEN ['country', 'tenure_months', 'monthly_charges', 'total_charges', 'balance', 'segment']
                    ELSE ['tenure_months', 'monthly_charges', 'total_charges', 'balance', 'segment']
               END AS feature_schema,
               CASE WHEN o_orderkey % 17 = 0 THEN CASE o_orderkey % 6 WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 5 THEN 6 ELSE 5 END + 1
                    WHEN o_orderkey % 5 <> 0 THEN CASE o_orderkey % 6 WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 5 THEN 6 ELSE 5 END
               END AS feature_count
        FROM orders""",
    "json_payloads": """
        SELECT event_id, event_type AS model_version,
               CASE event_id % 10
                    WHEN 0 THEN '{"value": ' || CAST(value AS VARCHAR) || '}'
                    WHEN 1 THEN '{"k": ' || json_extract_string(props, '$.k') || ', "value": ' || CAST(value AS VARCHAR) || ', "extra": 1}'
                    WHEN 2 THEN '{"k": "x' || json_extract_string(props, '$.k') || '", "value": ' || CAST(value AS VARCHAR) || '}'
                    WHEN 3 THEN '{"k": null, "value": ' || CAST(value AS VARCHAR) || '}'
                    WHEN 4 THEN 'no json ' || CAST(value AS VARCHAR)
                    WHEN 5 THEN '{"k": ' || json_extract_string(props, '$.k') || '.0, "value": ' || CAST(value AS VARCHAR) || '}'
                    WHEN 6 THEN '{"k": ' || json_extract_string(props, '$.k') || '.5, "value": "' || CAST(value AS VARCHAR) || '"}'
                    ELSE '{"k": ' || json_extract_string(props, '$.k') || ', "value": ' || CAST(value AS VARCHAR) || '}'
               END AS payload
        FROM events""",
}

# Bindings built on other bindings (ordered after their inputs).
DEPENDS: dict[str, list[str]] = {
    "production_models": ["model_versions"],
}
CTE["production_models"] = """
    SELECT model_name, arg_min(model_version, (created_at, model_version)) AS model_version,
           arg_min_null(pr_auc, (created_at, model_version)) AS pr_auc,
           arg_min_null(roc_auc, (created_at, model_version)) AS roc_auc,
           arg_min_null(feature_schema, (created_at, model_version)) AS feature_schema
    FROM model_versions WHERE CAST(model_name AS BIGINT) % 5 <> 0 GROUP BY model_name"""


def with_bindings(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <bindings>, <extra ctes> <body>`` with dependencies pulled in first."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in ordered]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
