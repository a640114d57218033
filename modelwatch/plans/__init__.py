"""Query catalogue: every registered query reads the driver tables through ``sources.bindings``.

Importing this package registers all queries in ``registry.QUERIES`` / ``registry.ORACLE``.
"""

from modelwatch.plans import (  # noqa: F401
    contract_queries,
    cycle_queries,
    drift_queries,
    eval_queries,
    event_queries,
    lifecycle_queries,
    ml_queries,
    monitor_queries,
    report_queries,
    stream_queries,
    traffic_queries,
)
from modelwatch.plans.registry import ORACLE, QUERIES  # noqa: F401
