"""The stored event table (I7 beyond the watermark, C3 by bucket) with its DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from modelwatch.operators.event_table import EventTable
from modelwatch.plans.contract_queries import _erase_list, _hmac_sql
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.session import scratch_path
from modelwatch.sources import bindings as b
from modelwatch.streaming import streams as st

BUCKETS = 8  # of the registered queries; a production table takes the default


def _table(spark, name):
    return EventTable(scratch_path(spark, f"events/{name}-{uuid.uuid4().hex[:12]}"), BUCKETS)


def _deliver(spark, sf_dir, table, source):
    """One whole delivery of the events, by a stream with a checkpoint of its own."""
    stream = b.prediction_events_of(st.table_stream(spark, sf_dir, "events"))
    st.run_foreach_batch(stream, f"deliver-{source}", st.event_table_handler(table, b.SUBJECT_SALT, source))


@query("event_table", with_bindings(
    f"SELECT request_id, model_version, probability, {_hmac_sql('subject_id')} AS subject_key FROM prediction_events", "prediction_events"))
def event_table(spark, sf_dir):
    """All events delivered again by a second stream, which knows nothing of the first one's state, are stored once."""
    table = _table(spark, "twice")
    for source in ("first", "again"):
        _deliver(spark, sf_dir, table, source)
    return table.read(spark).select("request_id", "model_version", "probability", "subject_key")


_ERASED_SQL = f"""(SELECT DISTINCT {_hmac_sql('CAST(user_id AS VARCHAR)')} AS k FROM events WHERE event_type = 'signup' AND value > 200)"""


@query("event_table_erased", with_bindings(
    f"""SELECT e.request_id, e.model_version, e.subject_key
        FROM (SELECT *, {_hmac_sql('subject_id')} AS subject_key FROM prediction_events) e
        WHERE e.subject_key IS NULL OR e.subject_key NOT IN (SELECT k FROM {_ERASED_SQL} x WHERE k IS NOT NULL)""", "prediction_events"))
def event_table_erased(spark, sf_dir):
    """The events left after erasing subjects and delivering everything once more."""
    table = _table(spark, "erased")
    _deliver(spark, sf_dir, table, "first")
    last = b.prediction_events(spark, sf_dir).agg(F.max("created_at")).first()[0]
    table.erase(_erase_list(spark, sf_dir), b.SUBJECT_SALT, "one", F.lit(last))
    _deliver(spark, sf_dir, table, "again")
    return table.read(spark).select("request_id", "model_version", "subject_key")
