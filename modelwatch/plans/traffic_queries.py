"""Request-log queries (R1–R8, I9 batch twin) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.operators import traffic as tr
from modelwatch.params import LATENCY_BUCKETS
from modelwatch.plans.oracle_bindings import with_bindings
from modelwatch.plans.registry import query
from modelwatch.sources import bindings as b

_TS = "yyyy-MM-dd HH:mm:ss"
_DTS = "'%Y-%m-%d %H:%M:%S'"
WIDTH = "6 hours"          # tumbling width of the windowed checks (the data is too thin for 5 minutes)
WIDTH_S = 6 * 3600
ALERT_WIDTH = "1 hour"     # windows of the sustained-alert series
ALERT_WIDTH_S = 3600


def _log(spark, sf_dir):
    return b.request_log(spark, sf_dir)


def _wstart(seconds: int, col: str = "ts") -> str:
    return f"make_timestamp(CAST(floor(epoch({col}) / {seconds}) * {seconds} * 1000000 AS BIGINT))"


@query("request_totals", with_bindings(
    "SELECT path, method, status, CAST(count(*) AS BIGINT) AS requests FROM request_log GROUP BY ALL", "request_log"))
def request_totals(spark, sf_dir):
    """Requests by path, method and status."""
    return tr.request_totals(_log(spark, sf_dir))


def _hist_sql() -> str:
    parts = [f"""SELECT path, method, '{bk}' AS le, CAST(count(*) FILTER (WHERE latency_seconds <= {bk}) AS BIGINT) AS cumulative_count,
                        round(sum(latency_seconds), 6) AS latency_sum FROM request_log GROUP BY path, method"""
             for bk in LATENCY_BUCKETS]
    parts.append("""SELECT path, method, '+Inf', CAST(count(*) AS BIGINT), round(sum(latency_seconds), 6)
                    FROM request_log GROUP BY path, method""")
    return with_bindings(" UNION ALL ".join(parts), "request_log")


@query("latency_histogram", _hist_sql())
def latency_histogram(spark, sf_dir):
    """R2: cumulative latency buckets, sum and count per path and method."""
    out = tr.latency_histogram(_log(spark, sf_dir))
    return out.withColumn("latency_sum", F.round("latency_sum", 6))


@query("error_rate", with_bindings(
    f"""SELECT strftime({_wstart(WIDTH_S)}, {_DTS}) AS window_start, CAST(count(*) AS BIGINT) AS requests,
               CAST(count(*) FILTER (WHERE status = 500) AS BIGINT) AS errors,
               round(count(*) FILTER (WHERE status = 500) / count(*), 6) AS error_rate,
               count(*) FILTER (WHERE status = 500) / count(*) > 0.02 AS alert
        FROM request_log GROUP BY 1""", "request_log"))
def error_rate(spark, sf_dir):
    """Share of 500 responses per tumbling window; alert above 2 %."""
    out = tr.error_rate(_log(spark, sf_dir), WIDTH)
    return out.select(F.date_format("window_start", _TS).alias("window_start"), "requests", "errors",
                      F.round("error_rate", 6).alias("error_rate"), "alert")


@query("error_rate_sliding", with_bindings(
    f"""SELECT strftime(make_timestamp(CAST((floor(epoch(ts) / 900) - k) * 900 * 1000000 AS BIGINT)), {_DTS}) AS window_start,
               CAST(count(*) AS BIGINT) AS requests,
               CAST(count(*) FILTER (WHERE status = 500) AS BIGINT) AS errors,
               round(count(*) FILTER (WHERE status = 500) / count(*), 6) AS error_rate
        FROM request_log, range(0, 4) t(k) GROUP BY 1""", "request_log"))
def error_rate_sliding(spark, sf_dir):
    """I9 batch twin: error rate over 1-hour windows sliding every 15 minutes."""
    out = tr.error_rate(_log(spark, sf_dir), "1 hour", "15 minutes")
    return out.select(F.date_format("window_start", _TS).alias("window_start"), "requests", "errors",
                      F.round("error_rate", 6).alias("error_rate"))


SLIDE_S, SLIDE_WIDTH_S = 60, 300   # the alert rules' own windows: 5 minutes, every minute


def _slid_ctes() -> list[tuple[str, str]]:
    """request_log repeated for every 5-minute window (starting each minute) that a row is in."""
    return [("slid", f"""SELECT make_timestamp(CAST((floor(epoch(ts) / {SLIDE_S}) - k) * {SLIDE_S} * 1000000 AS BIGINT)) AS ws, *
                         FROM request_log, range(0, {SLIDE_WIDTH_S // SLIDE_S}) t(k)""")]


def _p95_sql(width_s: int, source: str = "request_log", ws: str | None = None) -> str:
    cums = ", ".join(f"count(*) FILTER (WHERE latency_seconds <= {bk})" for bk in LATENCY_BUCKETS) + ", count(*)"
    les = ", ".join(f"{float(bk)}::DOUBLE" for bk in LATENCY_BUCKETS)
    n = len(LATENCY_BUCKETS)
    return f"""SELECT ws, n AS requests,
        CASE WHEN n = 0 THEN NULL
             WHEN idx > {n} THEN {float(LATENCY_BUCKETS[-1])}::DOUBLE
             ELSE (CASE WHEN idx = 1 THEN 0.0::DOUBLE ELSE les[idx - 1] END)
                  + (les[idx] - CASE WHEN idx = 1 THEN 0.0::DOUBLE ELSE les[idx - 1] END)
                    * (0.95 * n - CASE WHEN idx = 1 THEN 0 ELSE cums[idx - 1] END)
                    / (cums[idx] - CASE WHEN idx = 1 THEN 0 ELSE cums[idx - 1] END) END AS p95
      FROM (SELECT ws, cums, les, cums[{n + 1}] AS n,
                   list_position(list_transform(cums, lambda c: c >= 0.95 * cums[{n + 1}]), true) AS idx
            FROM (SELECT {ws or _wstart(width_s)} AS ws, [{cums}] AS cums, [{les}] AS les FROM {source} GROUP BY 1))"""


@query("p95_bucketed", with_bindings(
    f"""SELECT strftime(ws, {_DTS}) AS window_start, CAST(requests AS BIGINT) AS requests, round(p95, 6) AS p95,
               p95 > 0.5 AS alert FROM ({_p95_sql(WIDTH_S)})""", "request_log"))
def p95_bucketed(spark, sf_dir):
    """p95 latency per window interpolated inside the histogram bucket; alert above 0.5 s."""
    out = tr.p95_bucketed(_log(spark, sf_dir), WIDTH)
    return out.select(F.date_format("window_start", _TS).alias("window_start"), "requests",
                      F.round("p95", 6).alias("p95"), "alert")


@query("p95_exact", with_bindings(
    f"""SELECT strftime({_wstart(WIDTH_S)}, {_DTS}) AS window_start, CAST(count(*) AS BIGINT) AS requests,
               round(quantile_cont(latency_seconds, 0.95), 6) AS p95
        FROM request_log GROUP BY 1""", "request_log"))
def p95_exact(spark, sf_dir):
    """R4 exact twin: interpolated percentile of the raw latencies per window."""
    out = tr.p95_exact(_log(spark, sf_dir), WIDTH)
    return out.select(F.date_format("window_start", _TS).alias("window_start"), "requests",
                      F.round("p95", 6).alias("p95"))


def _alert_windows(spark, sf_dir):
    log = _log(spark, sf_dir)
    er = tr.error_rate(log, ALERT_WIDTH).select(
        F.lit("high_error_rate").alias("series"), "window_start", F.col("alert"))
    p95 = tr.p95_bucketed(log, ALERT_WIDTH).select(
        F.lit("high_latency_p95").alias("series"), "window_start", F.col("alert"))
    return er.unionByName(p95)


_ISLAND_CTES = [
    ("w", f"""SELECT 'high_error_rate' AS series, {_wstart(ALERT_WIDTH_S)} AS ws,
                     count(*) FILTER (WHERE status = 500) / count(*) > 0.02 AS cond
              FROM request_log GROUP BY 2
              UNION ALL
              SELECT 'high_latency_p95', ws, p95 > 0.5 FROM ({_p95_sql(ALERT_WIDTH_S)})"""),
    ("t", f"SELECT series, ws, CAST(floor(epoch(ws) / {ALERT_WIDTH_S}) AS BIGINT) AS idx FROM w WHERE cond"),
    ("isl", "SELECT series, ws, idx - row_number() OVER (PARTITION BY series ORDER BY idx) AS island FROM t"),
]


@query("sustained_alerts", with_bindings(
    f"""SELECT series, strftime(min(ws), {_DTS}) AS run_start,
               strftime(max(ws) + INTERVAL {ALERT_WIDTH_S} SECOND, {_DTS}) AS run_end,
               CAST(count(*) AS BIGINT) AS windows, count(*) * {ALERT_WIDTH_S} >= {2 * ALERT_WIDTH_S} AS fired
        FROM isl GROUP BY series, island""", "request_log", extra=_ISLAND_CTES))
def sustained_alerts(spark, sf_dir):
    """Runs of consecutive 1-hour windows in alert; a run fires after 2 hours (the ``for`` clause)."""
    w = _alert_windows(spark, sf_dir)
    out = tr.sustained(w, ["series"], "window_start", F.col("alert"), ALERT_WIDTH_S, 2 * ALERT_WIDTH_S)
    return out.select("series", F.date_format("run_start", _TS).alias("run_start"),
                      F.date_format("run_end", _TS).alias("run_end"), "windows", "fired")


@query("p95_sliding", with_bindings(
    f"""SELECT strftime(ws, {_DTS}) AS window_start, CAST(requests AS BIGINT) AS requests, round(p95, 6) AS p95,
               p95 > 0.5 AS alert FROM ({_p95_sql(0, 'slid', 'ws')})""", "request_log", extra=_slid_ctes()))
def p95_sliding(spark, sf_dir):
    """R4 on the rule's own windows: 5 minutes, sliding by one."""
    out = tr.p95_bucketed(_log(spark, sf_dir), "5 minutes", "1 minute")
    return out.select(F.date_format("window_start", _TS).alias("window_start"), "requests",
                      F.round("p95", 6).alias("p95"), "alert")


FOR_S = 8 * 60   # long enough that some runs fire and some do not
_SLIDING_CTES = _slid_ctes() + [
    ("w", f"""SELECT 'high_error_rate' AS series, ws, count(*) FILTER (WHERE status = 500) / count(*) > 0.02 AS cond FROM slid GROUP BY ws
              UNION ALL SELECT 'high_latency_p95', ws, p95 > 0.5 FROM ({_p95_sql(0, 'slid', 'ws')})"""),
    ("t", f"SELECT series, ws, CAST(floor(epoch(ws) / {SLIDE_S}) AS BIGINT) AS idx FROM w WHERE cond"),
    ("isl", "SELECT series, ws, idx - row_number() OVER (PARTITION BY series ORDER BY idx) AS island FROM t"),
]


@query("sustained_alerts_sliding", with_bindings(
    f"""SELECT series, strftime(min(ws), {_DTS}) AS run_start, strftime(max(ws) + INTERVAL {SLIDE_WIDTH_S} SECOND, {_DTS}) AS run_end,
               CAST(count(*) AS BIGINT) AS windows, count(*) * {SLIDE_S} >= {FOR_S} AS fired
        FROM isl GROUP BY series, island""", "request_log", extra=_SLIDING_CTES))
def sustained_alerts_sliding(spark, sf_dir):
    """R5 on sliding windows: runs of consecutive 5-minute windows (one each minute) in alert, and whether they fire."""
    log = _log(spark, sf_dir)
    er = tr.error_rate(log, "5 minutes", "1 minute").select(F.lit("high_error_rate").alias("series"), "window_start", "alert")
    p95 = tr.p95_bucketed(log, "5 minutes", "1 minute").select(F.lit("high_latency_p95").alias("series"), "window_start", "alert")
    out = tr.sustained(er.unionByName(p95), ["series"], "window_start", F.col("alert"), SLIDE_WIDTH_S, FOR_S, SLIDE_S)
    return out.select("series", F.date_format("run_start", _TS).alias("run_start"),
                      F.date_format("run_end", _TS).alias("run_end"), "windows", "fired")


@query("busy_minutes", with_bindings(
    """SELECT path, CAST(max(n) AS BIGINT) AS peak_per_minute, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS minutes_over_limit
       FROM (SELECT path, floor(epoch(ts) / 60) AS m, count(*) AS n FROM request_log GROUP BY path, m) GROUP BY path""",
    "request_log"))
def busy_minutes(spark, sf_dir):
    """R7 with a path as the client and a limit of one per minute, so that minutes over the limit occur."""
    log = _log(spark, sf_dir).withColumn("client", F.col("path"))
    return tr.busy_clients(log, per_minute=1).withColumnRenamed("client", "path")


@query("busy_clients", with_bindings(
    """SELECT client, CAST(max(n) AS BIGINT) AS peak_per_minute, CAST(count(*) FILTER (WHERE n > 120) AS BIGINT) AS minutes_over_limit
       FROM (SELECT client, floor(epoch(ts) / 60) AS m, count(*) AS n FROM request_log GROUP BY client, m)
       GROUP BY client""", "request_log"))
def busy_clients(spark, sf_dir):
    """Per client the busiest minute and the minutes above 120 requests (detection only)."""
    return tr.busy_clients(_log(spark, sf_dir))


@query("event_counters", with_bindings(
    """SELECT path, CAST(count(*) AS BIGINT) AS events, round(avg(latency_seconds), 6) AS mean_latency_seconds
       FROM request_log GROUP BY path""", "request_log"))
def event_counters(spark, sf_dir):
    """Count and mean latency per path."""
    out = tr.event_counters(_log(spark, sf_dir))
    return out.withColumn("mean_latency_seconds", F.round("mean_latency_seconds", 6))
