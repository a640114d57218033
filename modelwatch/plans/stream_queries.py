"""Streaming queries (I1, I5–I9, R6): each stream runs with ``availableNow`` and returns its sink.

Windowed streams keep a row per window that is replaced until it closes (update mode); ``closed`` says
whether the final watermark (max event time − delay) has passed its end. Their twins are the batch
aggregations over all windows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from modelwatch.operators import traffic as tr
from modelwatch.operators import drift
from modelwatch.plans import traffic_queries as tq
from modelwatch.operators.common import stored
from modelwatch.plans.contract_queries import _hmac_sql
from modelwatch.plans.drift_queries import psi_ctes
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.sources import bindings as b
from modelwatch.streaming import streams as st

_TS = "yyyy-MM-dd HH:mm:ss"
_DTS = "'%Y-%m-%d %H:%M:%S'"
BIN_WINDOW_DAYS = 90


def _ev_stream(spark, sf_dir):
    return st.table_stream(spark, sf_dir, "events")


@query("stream_ingest", with_bindings(
    f"""SELECT request_id, model_version, probability, {_hmac_sql('subject_id')} AS subject_key,
               'prediction_made' AS event_type, request_id AS outbox_request_id, probability AS outbox_probability
        FROM prediction_events""", "prediction_events"))
def stream_ingest(spark, sf_dir):
    """I1 + A6: events stream → redacted event and outbox record, one commit per micro-batch id."""
    base = st.run_foreach_batch(b.prediction_events_of(_ev_stream(spark, sf_dir)), "ingest",
                                st.ingest_handler(b.SUBJECT_SALT))
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    outbox = st.ingested_outbox(spark, base).select(
        field("request_id").alias("outbox_request_id"), "event_type",
        field("probability").cast("double").alias("outbox_probability"))
    events = st.ingested_events(spark, base).select("request_id", "model_version", "probability", "subject_key")
    return events.join(outbox, F.col("request_id") == F.col("outbox_request_id"), "full")


@query("stream_dedup", "SELECT event_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """The events stream delivered twice (at-least-once) comes out once per event id."""
    s = _ev_stream(spark, sf_dir)
    twice = s.unionByName(_ev_stream(spark, sf_dir))
    out = st.run_to_parquet(st.dedup(twice, ["event_id"], "ts", "1 hour"), "dedup")
    return out.select("event_id", "event_type")


@query("stream_truth_join", with_bindings(
    f"""SELECT e.request_id, e.model_version, l.label, strftime(l.labeled_at, {_DTS}) AS labeled_at
        FROM prediction_events e LEFT JOIN (
            SELECT e.request_id, arg_max(f.label, (f.labeled_at, f.label)) AS label, max(f.labeled_at) AS labeled_at
            FROM prediction_events e JOIN feedback f ON f.request_id = e.request_id AND f.label IN (0, 1)
                 AND f.labeled_at BETWEEN e.created_at AND e.created_at + INTERVAL 3 DAY
            GROUP BY e.request_id) l USING (request_id)""", "prediction_events", "feedback"))
def stream_truth_join(spark, sf_dir):
    """Stream-stream left join of predictions with late labels inside a 3-day horizon: one row per event with its
    latest label; events whose watermark has not passed yet are listed as open."""
    labels = b.feedback_of(_ev_stream(spark, sf_dir))
    joined = st.run_to_parquet(st.truth_join(b.prediction_events_of(_ev_stream(spark, sf_dir)), labels), "truth_join")
    out = st.truth_table(joined, b.prediction_events(spark, sf_dir))
    return out.select("request_id", "model_version", "label", F.date_format("labeled_at", _TS).alias("labeled_at"))


@query("stream_window_counts", with_bindings(
    f"""SELECT strftime(ws, {_DTS}) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n,
               ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed
        FROM (SELECT make_timestamp(CAST(floor(epoch(ts) / 86400) * 86400 * 1000000 AS BIGINT)) AS ws, event_type
              FROM events)
        GROUP BY ws, event_type"""))
def stream_window_counts(spark, sf_dir):
    """I8 building block: daily event counts per type, open windows included."""
    counts = st.window_counts(_ev_stream(spark, sf_dir), "ts", "1 day", "1 hour", ["event_type"])
    rows, _ = st.run_keyed(counts, "window_counts", ["window_start", "event_type"])
    return st.with_closed(rows, "1 hour").select(F.date_format("window_start", _TS).alias("window_start"), "event_type",
                                                 F.col("n").cast("bigint").alias("n"), "closed")


@query("stream_error_rate", with_bindings(
    f"""SELECT strftime(ws, {_DTS}) AS window_start, CAST(count(*) AS BIGINT) AS requests,
               CAST(count(*) FILTER (WHERE status = 500) AS BIGINT) AS errors,
               round(count(*) FILTER (WHERE status = 500) / count(*), 6) AS error_rate,
               ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM request_log) - INTERVAL 10 MINUTE AS closed
        FROM (SELECT make_timestamp(CAST((floor(epoch(ts) / 900) - k) * 900 * 1000000 AS BIGINT)) AS ws, status
              FROM request_log, range(0, 4) t(k))
        GROUP BY ws""", "request_log"))
def stream_error_rate(spark, sf_dir):
    """Sliding 1-hour error rate every 15 minutes, 10-minute watermark, open windows included."""
    log = b.request_log_of(_ev_stream(spark, sf_dir))
    rows, _ = st.run_keyed(st.windowed_error_rate(log, "1 hour", "15 minutes", "10 minutes"), "error_rate", ["window_start"])
    return st.with_closed(rows, "10 minutes").select(
        F.date_format("window_start", _TS).alias("window_start"), F.col("requests").cast("bigint").alias("requests"),
        F.col("errors").cast("bigint").alias("errors"), F.round("error_rate", 6).alias("error_rate"), "closed")


_ALERT_DELAY = "10 minutes"


@query("stream_alert_windows", with_bindings(
    f"""SELECT strftime(p.ws, {_DTS}) AS window_start, CAST(p.requests AS BIGINT) AS requests, round(e.errors / p.requests, 6) AS error_rate,
               round(p.p95, 6) AS p95, p.ws + INTERVAL {tq.SLIDE_WIDTH_S} SECOND <= (SELECT max(ts) FROM request_log) - INTERVAL {_ALERT_DELAY} AS closed
        FROM ({tq._p95_sql(0, 'slid', 'ws')}) p JOIN (SELECT ws, count(*) FILTER (WHERE status = 500) AS errors FROM slid GROUP BY ws) e USING (ws)""",
    "request_log", extra=tq._slid_ctes()))
def stream_alert_windows(spark, sf_dir):
    """I9 + R3 + R4 as a stream: error rate and p95 of the alert rules' windows (5 minutes, every minute), open ones included."""
    log = b.request_log_of(_ev_stream(spark, sf_dir))
    windows = st.alert_windows(log, f"{tq.SLIDE_WIDTH_S} seconds", f"{tq.SLIDE_S} seconds", _ALERT_DELAY)
    rows, _ = st.run_keyed(windows, "alert_windows", ["w"])
    rows = st.with_closed(rows.withColumn("window_end", F.col("w.end")), _ALERT_DELAY)
    return rows.select(F.date_format("w.start", _TS).alias("window_start"), F.col("requests").cast("bigint").alias("requests"),
                       F.round("error_rate", 6).alias("error_rate"), F.round("p95", 6).alias("p95"), "closed")


@query("stream_alerts", with_bindings(
    f"""SELECT series, strftime(min(ws), {_DTS}) AS run_start, strftime(max(ws) + INTERVAL {tq.SLIDE_WIDTH_S} SECOND, {_DTS}) AS run_end,
               CAST(count(*) AS BIGINT) AS windows, count(*) * {tq.SLIDE_S} >= {tq.FOR_S} AS fired,
               max(ws) + INTERVAL {tq.SLIDE_WIDTH_S + tq.SLIDE_S * 3 // 2} SECOND - INTERVAL 1 MICROSECOND
                 <= (SELECT max(ts) FROM request_log) - INTERVAL {_ALERT_DELAY} AS closed
        FROM isl GROUP BY series, island""", "request_log", extra=tq._SLIDING_CTES))
def stream_alerts(spark, sf_dir):
    """I9 + R5 as one stream of two stateful operators: runs of alerting windows and whether they fire; ``closed`` false: may grow."""
    runs, _ = st.alert_runs(b.request_log_of(_ev_stream(spark, sf_dir)), "alerts", tq.SLIDE_WIDTH_S, tq.SLIDE_S, tq.FOR_S, _ALERT_DELAY)
    return runs.select("series", F.date_format("run_start", _TS).alias("run_start"), F.date_format("run_end", _TS).alias("run_end"),
                       F.col("windows").cast("bigint").alias("windows"), "fired", "closed")


def _reference_edges(spark, sf_dir) -> dict[str, list[float]]:
    """Fixed reference edges (metadata: one min / max per feature) for the streaming bin counts."""
    ref = b.lineitem_wide(spark, sf_dir, "reference")
    feats = list(b.LINEITEM_FEATURES)
    row = ref.agg(*[F.min(f).alias(f"{f}_lo") for f in feats], *[F.max(f).alias(f"{f}_hi") for f in feats]).first()
    return {f: st.np_edges(row[f"{f}_lo"], row[f"{f}_hi"], 10) for f in feats}


def _lineitem_stream(spark, sf_dir):
    s = st.table_stream(spark, sf_dir, "lineitem")
    return s.select(F.col("l_shipdate").alias("ts"),
                    *[F.col(src).alias(name) for name, src in b.LINEITEM_FEATURES.items()])


_BINW = BIN_WINDOW_DAYS * 86400
_STREAM_BIN_SQL = with_bindings(
    f"""SELECT strftime(p.ws, {_DTS}) AS window_start, p.feature,
               CAST(CASE WHEN p.value < e.lo THEN 0 WHEN p.value > e.hi THEN 11 WHEN p.value = e.hi THEN 10
                         ELSE len(list_filter(e.edges, lambda x: x <= p.value)) END AS INTEGER) AS bin,
               CAST(count(*) AS BIGINT) AS n,
               p.ws + INTERVAL {BIN_WINDOW_DAYS} DAY <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY AS closed
        FROM (SELECT make_timestamp(CAST(floor(epoch(l_shipdate) / {_BINW}) * {_BINW} * 1000000 AS BIGINT)) AS ws,
                     'quantity' AS feature, l_quantity AS value FROM lineitem
              UNION ALL SELECT make_timestamp(CAST(floor(epoch(l_shipdate) / {_BINW}) * {_BINW} * 1000000 AS BIGINT)),
                     'extendedprice', l_extendedprice FROM lineitem
              UNION ALL SELECT make_timestamp(CAST(floor(epoch(l_shipdate) / {_BINW}) * {_BINW} * 1000000 AS BIGINT)),
                     'discount', l_discount FROM lineitem
              UNION ALL SELECT make_timestamp(CAST(floor(epoch(l_shipdate) / {_BINW}) * {_BINW} * 1000000 AS BIGINT)),
                     'tax', l_tax FROM lineitem) p
        JOIN ed e ON e.feature = p.feature
        WHERE p.value IS NOT NULL AND NOT isnan(p.value)
        GROUP BY ALL""",
    "reference_rows", extra=psi_ctes("reference_rows", "reference_rows", [])[:4])


@query("stream_bin_counts", _STREAM_BIN_SQL)
def stream_bin_counts(spark, sf_dir):
    """I8: shipped lineitem as a stream, per 90-day window counts per (feature, bin) against the fixed reference
    edges (1-day watermark), open windows included."""
    counts = st.windowed_bin_counts(_lineitem_stream(spark, sf_dir), "ts", _reference_edges(spark, sf_dir),
                                    f"{BIN_WINDOW_DAYS} days", "1 day")
    rows, _ = st.run_keyed(counts, "bin_counts", ["window_start", "feature", "bin"])
    return st.with_closed(rows, "1 day").select(F.date_format("window_start", _TS).alias("window_start"), "feature", "bin",
                                                F.col("n").cast("bigint").alias("n"), "closed")


_DRIFTING = """SELECT make_timestamp(CAST(floor(epoch(l_shipdate) / {w}) * {w} * 1000000 AS BIGINT)) AS ws, l_shipdate,
                       l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
               WHERE l_shipdate < TIMESTAMP '{split}' OR (l_quantity > 25 AND l_discount >= 0.05)""".format(w=_BINW, split=b.DRIFT_SPLIT)
_WINDOW_CTES = psi_ctes("reference_rows", "reference_rows", [])[:3] + [
    ("ed0", psi_ctes("reference_rows", "reference_rows", [])[3][1]),
    ("dl", _DRIFTING),
    ("last", "SELECT max(l_shipdate) - INTERVAL 1 DAY AS mark FROM dl"),
    ("wide", "SELECT * FROM dl"),
    ("vals", """SELECT ws, 'quantity' AS feature, CAST(l_quantity AS DOUBLE) AS value FROM wide
                UNION ALL SELECT ws, 'extendedprice', CAST(l_extendedprice AS DOUBLE) FROM wide
                UNION ALL SELECT ws, 'discount', CAST(l_discount AS DOUBLE) FROM wide
                UNION ALL SELECT ws, 'tax', CAST(l_tax AS DOUBLE) FROM wide"""),
    ("refc", """SELECT a.feature, CASE WHEN a.value = b.hi THEN 10 ELSE len(list_filter(b.edges, lambda x: x <= a.value)) END AS bin,
                       count(*) AS c FROM r a JOIN ed0 b ON a.feature = b.feature GROUP BY ALL"""),
    ("prodc", """SELECT v.ws, v.feature, CASE WHEN v.value < b.lo THEN 0 WHEN v.value > b.hi THEN 11 WHEN v.value = b.hi THEN 10
                        ELSE len(list_filter(b.edges, lambda x: x <= v.value)) END AS bin, count(*) AS c
                 FROM vals v JOIN ed0 b ON v.feature = b.feature WHERE v.value IS NOT NULL GROUP BY ALL"""),
    ("n", "SELECT ws, feature, sum(c) AS n FROM prodc GROUP BY ws, feature"),
    ("wpsi", """SELECT n.ws, n.feature, n.n, sum(((coalesce(p.c, 0) + 0.5::DOUBLE) / (n.n + 6::DOUBLE) - (coalesce(rc.c, 0) + 0.5::DOUBLE) / (ed0.n_reference + 6::DOUBLE))
                   * ln(((coalesce(p.c, 0) + 0.5::DOUBLE) / (n.n + 6::DOUBLE)) / ((coalesce(rc.c, 0) + 0.5::DOUBLE) / (ed0.n_reference + 6::DOUBLE)))) AS psi
                FROM n JOIN ed0 ON ed0.feature = n.feature CROSS JOIN range(0, 12) t
                LEFT JOIN prodc p ON p.ws = n.ws AND p.feature = n.feature AND p.bin = t.range
                LEFT JOIN refc rc ON rc.feature = n.feature AND rc.bin = t.range
                GROUP BY n.ws, n.feature, n.n"""),
    ("health", """SELECT ws, count(*) FILTER (WHERE n >= 20 AND psi > 0.2) AS drifting, count(*) FILTER (WHERE n >= 20) AS used,
                         ws + INTERVAL {d} DAY <= (SELECT mark FROM last) AS closed FROM wpsi GROUP BY ws""".format(d=BIN_WINDOW_DAYS)),
]


def _window_health(spark, sf_dir):
    """I8 → E3–E5: per window of a stream that drifts from the split on, the health verdict against the reference."""
    edges = _reference_edges(spark, sf_dir)
    split = F.lit(b.DRIFT_SPLIT).cast("timestamp")
    stream = _lineitem_stream(spark, sf_dir).where((F.col("ts") < split) | ((F.col("quantity") > 25) & (F.col("discount") >= 0.05)))
    rows, _ = st.run_keyed(st.windowed_bin_counts(stream, "ts", edges, f"{BIN_WINDOW_DAYS} days", "1 day"), "drift_bins",
                           ["window_start", "feature", "bin"])
    counts = st.with_closed(rows, "1 day")
    ref = b.lineitem_wide(spark, sf_dir, "reference")
    cells = drift.bin_counts_wide(ref, ref.limit(0), list(edges)).select("feature", "bin", "n_reference", "ref_count")
    # the reference's cells (features × 12, a bounded table) for every window and feature that has counts
    grid = counts.select("window_start", "feature").distinct().join(F.broadcast(cells), "feature")
    full = grid.join(counts.drop("closed"), ["window_start", "feature", "bin"], "left").withColumn("prod_count", F.coalesce("n", F.lit(0)))
    report = drift.verdicts(drift.psi_from_counts(full, ["window_start"]), ["window_start"])
    return drift.model_health(report, ["window_start"]).join(counts.select("window_start", "closed").distinct(), "window_start")


@query("stream_window_health", with_bindings(
    f"""SELECT strftime(ws, {_DTS}) AS window_start, CASE WHEN used = 0 THEN 'insufficient_data' ELSE 'evaluated' END AS status,
               CAST(drifting AS BIGINT) AS drifting_feature_count, used > 0 AND drifting >= 2 AS retraining_recommended, closed
        FROM health""", "reference_rows", extra=_WINDOW_CTES))
def stream_window_health(spark, sf_dir):
    """E5 per 90-day window of the stream."""
    h = _window_health(spark, sf_dir)
    return h.select(F.date_format("window_start", _TS).alias("window_start"), "status", "drifting_feature_count",
                    "retraining_recommended", "closed")


@query("drift_alert", with_bindings(
    f"""SELECT 'drift' AS series, strftime(min(ws), {_DTS}) AS run_start,
               strftime(max(ws) + INTERVAL {BIN_WINDOW_DAYS} DAY, {_DTS}) AS run_end, CAST(count(*) AS BIGINT) AS windows,
               count(*) >= 2 AS fired, bool_and(closed) AS closed
        FROM (SELECT ws, closed, CAST(epoch(ws) / {_BINW} AS BIGINT) - row_number() OVER (ORDER BY ws) AS island FROM health WHERE used > 0 AND drifting >= 2)
        GROUP BY island""", "reference_rows", extra=_WINDOW_CTES))
def drift_alert(spark, sf_dir):
    """Runs of windows whose verdict recommends retraining (fires after two windows); open ones included."""
    h = stored(_window_health(spark, sf_dir).withColumn("series", F.lit("drift")), "window-health")
    runs = tr.sustained(h, ["series"], "window_start", F.col("retraining_recommended"), BIN_WINDOW_DAYS * 86400,
                        2 * BIN_WINDOW_DAYS * 86400)
    still = h.where("not closed").select(F.lit(False).alias("part"), F.col("window_start").alias("open_start"))  # the few at the end
    inside = (F.col("open_start") >= F.col("run_start")) & (F.col("open_start") < F.col("run_end"))
    open_runs = runs.join(F.broadcast(still), inside, "left_semi").select("series", "run_start", F.lit(False).alias("closed"))
    runs = runs.join(open_runs, ["series", "run_start"], "left").withColumn("closed", F.coalesce("closed", F.lit(True)))
    return runs.select("series", F.date_format("run_start", _TS).alias("run_start"),
                       F.date_format("run_end", _TS).alias("run_end"), "windows", "fired", "closed")


@query("stream_delivery", with_bindings(
    """SELECT id, event_type, CASE WHEN attempts >= 5 THEN attempts WHEN (id + attempts) % 10 <> 0 THEN attempts + 1
                                   WHEN attempts + 1 >= 5 THEN attempts + 1 ELSE attempts + 2 END AS attempts,
              CASE WHEN attempts >= 5 OR ((id + attempts) % 10 = 0 AND attempts + 1 >= 5) THEN 'dead' ELSE 'delivered' END AS outcome
       FROM outbox WHERE processed_at IS NULL""", "outbox"))
def stream_delivery(spark, sf_dir):
    """I5 stream form: due outbox rows are delivered per micro-batch; failures lose an attempt and come back from the
    retry folder as a second stream; exhausted rows are dead letters."""
    def deliver(batch):
        # the user hook: any per-row success rule (here it fails for one in ten, and not twice)
        return batch.withColumn("ok", (F.col("id") + F.col("attempts")) % 10 != 0)

    pending = b.outbox_of(_ev_stream(spark, sf_dir)).where(F.col("processed_at").isNull())
    first = st.run_foreach_batch(pending, "delivery", st.delivery_handler(deliver))
    done = spark.read.parquet(f"{first}/outbox")
    retry = st.retry_stream(spark, first, pending.schema)
    second = st.run_foreach_batch(retry, "redelivery", st.delivery_handler(deliver))
    rows = done.where("outcome <> 'retry'").select("id", "event_type", "attempts", "outcome")
    again = st.read_sink(spark, f"{second}/outbox", done.schema)
    return rows.unionByName(again.select("id", "event_type", "attempts", "outcome"))


@query("stream_delivery_all", with_bindings(
    """SELECT id, event_type, CASE WHEN attempts >= 5 THEN attempts ELSE least(attempts + id % 6 + 1, 5) END AS attempts,
              CASE WHEN attempts + id % 6 < 5 THEN 'delivered' ELSE 'dead' END AS outcome
       FROM outbox WHERE processed_at IS NULL""", "outbox"))
def stream_delivery_all(spark, sf_dir):
    """I5 to the end: every due row is tried until it is delivered or dead; up to five tries in a row fail here."""
    def deliver(batch):
        # the user hook: a row fails as often as its id says (its first attempt has the number id % 7)
        return batch.withColumn("ok", F.col("attempts") - F.col("id") % 7 >= F.col("id") % 6)

    pending = b.outbox_of(_ev_stream(spark, sf_dir)).where(F.col("processed_at").isNull())
    run = st.Delivery(pending, "delivery-all", deliver, ["created_at", "id"])
    now = datetime.fromisoformat(b.NOW)
    while now is not None:  # a clock that jumps to the time at which the next rows are due
        now = run.advance(now)
    return run.results().select("id", "event_type", "attempts", "outcome")
