"""Structured Streaming forms (I1, I5–I9): readStream → transformations → sink, run by ``availableNow``.

Sinks and checkpoints live under the session's ``spark.checkpoint.dir`` (a
shared folder on a cluster), one fresh folder per run. ``foreachBatch`` writers
write each micro-batch under its batch id with overwrite, so a replayed batch
replaces its own output (exactly-once results over at-least-once execution).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.functions.hashing import subject_key
from modelwatch.functions.numeric import bin_by_edges, present_number
from modelwatch.operators import traffic
from modelwatch.operators.event_table import EventTable
from modelwatch.operators.privacy import SENSITIVE_KEYS
from modelwatch.params import DEFAULTS, LATENCY_BUCKETS
from modelwatch.session import scratch_path
from modelwatch.sources.tables import read_or_empty


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table as a file stream (the folder filtered to the table's file); NTZ → TIMESTAMP."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.parquet(sf_dir)
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def run_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def run_to_parquet(df: DataFrame, name: str, mode: str = "append", partition_by: Sequence[str] = ()) -> DataFrame:
    """Run a streaming DataFrame to a parquet sink with ``availableNow``; return the sink as a batch table."""
    spark = df.sparkSession
    base = run_folder(spark, name)
    w = (df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    return read_sink(spark, f"{base}/out", df.schema)


def read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """The sink as a batch table; empty when nothing was written."""
    return read_or_empty(spark, path, schema)


def run_foreach_batch(df: DataFrame, name: str, handler: Callable[[DataFrame, int, str], None],
                      folder: str | None = None) -> str:
    """Run with ``foreachBatch(handler(batch, batch_id, folder))``; returns the run folder.

    Give the ``folder`` of an earlier run to go on from its checkpoint; a batch that had not been
    committed is replayed under its id.
    """
    base = folder or run_folder(df.sparkSession, name)
    q = (df.writeStream.foreachBatch(lambda batch, batch_id: handler(batch, batch_id, base))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return base


# ---------------------------------------------------------------- operators

def redacted_events(events: DataFrame, salt: str) -> DataFrame:
    """A6 event projection: features map without the sensitive keys, subject id → keyed hash."""
    keys = F.array(*[F.lit(k) for k in SENSITIVE_KEYS])
    return events.select(
        "request_id", "created_at", "model_version", "probability", "prediction", "latency_seconds",
        F.map_filter("features", lambda k, v: ~F.array_contains(keys, k)).alias("features"),
        subject_key("subject_id", salt).alias("subject_key"))


def ingest_handler(salt: str) -> Callable[[DataFrame, int, str], None]:
    """The redacted event and its outbox record, as one row of one write.

    A batch's rows appear with one commit, so there is never an event without its outbox record; a replay
    overwrites its batch id. ``ingested_events`` and ``ingested_outbox`` are the two projections.
    """

    def handler(batch: DataFrame, batch_id: int, base: str) -> None:
        payload = F.to_json(F.struct("request_id", "model_version", "probability", "prediction"))
        rows = redacted_events(batch, salt).withColumn("event_type", F.lit("prediction_made")).withColumn("payload", payload)
        rows.write.mode("overwrite").parquet(f"{base}/ingested/batch_id={batch_id}")

    return handler


def ingested_events(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/ingested").drop("event_type", "payload")


def ingested_outbox(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/ingested").select("created_at", "event_type", "payload", "batch_id")


def event_table_handler(table: EventTable, salt: str, source: str) -> Callable[[DataFrame, int, str], None]:
    """I7 beyond any watermark: each request once in the stored event table. ``source`` names the stream: its batches are parts."""

    def handler(batch: DataFrame, batch_id: int, base: str) -> None:
        table.add(redacted_events(batch, salt), f"{source}-{batch_id}")

    return handler


def dedup(events: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """At-least-once input → each key once within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def truth_join(events: DataFrame, labels: DataFrame, horizon: str = "3 days",
               events_delay: str = "1 hour", labels_delay: str = "1 day") -> DataFrame:
    """Each event with every valid label inside the horizon; unlabelled events emerge once both watermarks pass.

    A label corrected later comes out as a further row; :func:`truth_table` makes one row per event of them.
    """
    ev = events.withWatermark("created_at", events_delay).alias("e")
    lb = (labels.where(F.col("label").isin(0, 1)).withColumnRenamed("request_id", "label_request_id")
          .withWatermark("labeled_at", labels_delay).alias("l"))
    cond = ((F.col("e.request_id") == F.col("l.label_request_id"))
            & (F.col("l.labeled_at") >= F.col("e.created_at"))
            & (F.col("l.labeled_at") <= F.col("e.created_at") + F.expr(f"INTERVAL {horizon}")))
    return ev.join(lb, cond, "leftOuter").select("e.request_id", "e.created_at", "e.model_version", "l.label",
                                                 "l.labeled_at")


def truth_table(joined: DataFrame, events: DataFrame) -> DataFrame:
    """The sink of :func:`truth_join` as one row per event: its latest label, and whether the row is closed.

    ``events`` (the same events as a table) adds those still waiting for their watermark, with
    ``closed`` false and no label yet, so that none is missing.
    """
    latest = joined.groupBy("request_id").agg(
        F.first("created_at").alias("created_at"), F.first("model_version").alias("model_version"),
        F.max_by(F.struct("label", "labeled_at"), F.struct("labeled_at", "label")).alias("l"))
    done = latest.select("request_id", "created_at", "model_version", "l.label", "l.labeled_at", F.lit(True).alias("closed"))
    waiting = events.join(done, "request_id", "left_anti").select(
        "request_id", "created_at", "model_version", F.lit(None).cast("int").alias("label"),
        F.lit(None).cast("timestamp").alias("labeled_at"), F.lit(False).alias("closed"))
    return done.unionByName(waiting)


def late_rows(table: DataFrame, ts: str, delay: str, closed_until: Column) -> DataFrame:
    """Side table of a watermarked stream: rows of the table older than the watermark ``closed_until - delay``."""
    return table.where(F.col(ts) < closed_until - F.expr(f"INTERVAL {delay}"))


def run_keyed(df: DataFrame, name: str, keys: Sequence[str], folder: str | None = None) -> tuple[DataFrame, str]:
    """Run an update-mode aggregation; return its present rows, one per key, and the run folder.

    A micro-batch's changed rows are one overwrite under its batch id, and a key's row is that of its last batch: a
    row is replaced until its window closes, a replay changes nothing, and no earlier file is touched. ``folder`` goes on from an
    earlier run.
    """
    base = folder or run_folder(df.sparkSession, name)

    def handler(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/updates/batch_id={batch_id}")

    q = (df.writeStream.outputMode("update").foreachBatch(handler).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = read_or_empty(df.sparkSession, f"{base}/updates", T.StructType([*df.schema.fields, T.StructField("batch_id", T.IntegerType())]))
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return latest.select(*keys, "_row.*").select(*df.columns), base


def with_closed(windows: DataFrame, delay: str) -> DataFrame:
    """``last_ts`` (the latest event of a window's rows) gives way to ``closed``: whether the watermark, the latest event
    of all less the delay, has passed the window's end. Open windows are rows like any other, with what they hold so far."""
    mark = windows.agg((F.max("last_ts") - F.expr(f"INTERVAL {delay}")).alias("mark")).scalar()
    return windows.withColumn("closed", F.col("window_end") <= mark).drop("last_ts")


def window_counts(events: DataFrame, ts: str, width: str, delay: str, by: Sequence[str] = (),
                  slide: str | None = None) -> DataFrame:
    """I8 / I9 building block: event-time window counts, and the latest event counted."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (events.withWatermark(ts, delay).groupBy(w.alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "last_ts"))


def windowed_error_rate(log: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """Sliding error rate with a watermark."""
    w = F.window("ts", width, slide)
    return (log.withWatermark("ts", delay).groupBy(w.alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == 500).alias("errors"), F.max("ts").alias("last_ts"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "errors",
                    (F.col("errors") / F.col("requests")).alias("error_rate"), "last_ts"))


def alert_windows(log: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """R3 + R4 on the alert rules' sliding windows of a stream: error rate and p95 (from latency buckets) of one aggregation."""
    counts = log.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == 500).alias("errors"),
        *traffic.bucket_counts(F.col("latency_seconds"), LATENCY_BUCKETS), F.max("ts").alias("last_ts"))
    cumulative = F.array(*[F.col(f"b{i}") for i in range(len(LATENCY_BUCKETS))], F.col("requests"))
    return counts.select("w", "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_rate"),
                         traffic.histogram_quantile(0.95, cumulative, LATENCY_BUCKETS).alias("p95"), "last_ts")


def alerting(windows: DataFrame) -> DataFrame:
    """(w, series) of the windows in which a rule's condition holds."""
    rules = {"high_error_rate": F.col("error_rate") > DEFAULTS.error_rate_bound, "high_latency_p95": F.col("p95") > DEFAULTS.p95_bound_seconds}
    series = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda s: s.isNotNull())
    return windows.select("w", F.explode(series).alias("series"))


def sustained_runs(windows: DataFrame, width_seconds: int, slide_seconds: int, for_seconds: int) -> DataFrame:
    """R5 as a second stateful operator (append mode): runs of consecutive alerting windows, as sessions over the
    windows' times. A gap of one and a half slides joins neighbours and parts windows with a missing one between them. A
    run comes out once, when the watermark says that no window can extend it."""
    gap = f"{slide_seconds * 1500} milliseconds"
    runs = (alerting(windows).groupBy(F.session_window(F.window_time("w"), gap).alias("s"), "series")
            .agg(F.min("w.start").alias("run_start"), F.max("w.start").alias("last"), F.count(F.lit(1)).alias("windows")))
    return runs.select("series", "run_start", (F.col("last") + F.make_interval(secs=F.lit(width_seconds))).alias("run_end"), "windows",
                       (F.col("windows") * slide_seconds >= for_seconds).alias("fired"))


def alert_runs(log: DataFrame, name: str, width_seconds: int, slide_seconds: int, for_seconds: int, delay: str,
               folder: str | None = None) -> tuple[DataFrame, str]:
    """Runs of alerting windows of a request stream, with ``closed``, and the run folder (give it to go on).

    Closed runs come out of one stream: sliding windows, conditions, sessions. Runs that may still grow are read off
    the present windows (a row per slide), which a keyed stream over the same log keeps.
    """
    base = folder or run_folder(log.sparkSession, name)
    windows = alert_windows(log, f"{width_seconds} seconds", f"{slide_seconds} seconds", delay)
    runs = sustained_runs(windows, width_seconds, slide_seconds, for_seconds)
    q = (runs.writeStream.outputMode("append").format("parquet").option("path", f"{base}/runs")
         .option("checkpointLocation", f"{base}/runs-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    done = read_sink(log.sparkSession, f"{base}/runs", runs.schema).withColumn("closed", F.lit(True))
    present, _ = run_keyed(windows, name, ["w"], f"{base}/windows")
    now = traffic.sustained(alerting(present).withColumn("window_start", F.col("w.start")), ["series"], "window_start", F.lit(True),
                            width_seconds, for_seconds, slide_seconds)
    still = now.join(done.select("series", "run_start"), ["series", "run_start"], "left_anti").withColumn("closed", F.lit(False))
    return done.unionByName(still), base


def literal_slots(edges: dict[str, list[float]]) -> list[Column]:
    """Int slots ``feature index · (bins + 2) + bin`` against fixed (literal) reference edges."""
    out = []
    for i, (f, e) in enumerate(edges.items()):
        width = len(e) + 1
        out.append(F.when(present_number(f), F.lit(i * width) + bin_by_edges(
            f, F.lit(e[0]), F.lit(e[-1]), [F.lit(x) for x in e[1:-1]])))
    return out


def windowed_bin_counts(stream: DataFrame, ts: str, edges: dict[str, list[float]], width: str,
                        delay: str) -> DataFrame:
    """I8: per event-time window, counts per (feature, slot) against fixed reference edges."""
    names = F.array(*[F.lit(f) for f in edges])
    slot_width = len(next(iter(edges.values()))) + 1
    exploded = stream.select(ts, F.explode(F.array(*literal_slots(edges))).alias("slot")).where(
        F.col("slot").isNotNull())
    agg = (exploded.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "slot")
           .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts")))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      F.element_at(names, (F.col("slot") / slot_width).cast("int") + 1).alias("feature"),
                      (F.col("slot") % slot_width).cast("int").alias("bin"), "n", "last_ts")


def np_edges(lo: float, hi: float, bins: int) -> list[float]:
    """NumPy's histogram edges for a reference range (constant range widened by ±0.5)."""
    import numpy as np

    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [float(x) for x in np.linspace(lo, hi, bins + 1)]


def delivery_handler(deliver: Callable[[DataFrame], DataFrame], max_attempts: int = DEFAULTS.max_attempts):
    """I5 stream form: ``deliver(batch) → batch + ok``, written by outcome in one commit per batch id.

    Rows whose attempts are exhausted are never delivered: they are ``dead``. A failed delivery costs an attempt and
    goes to ``retry`` (read that folder as the next source), or to ``dead`` when it was the last one.
    """

    def handler(batch: DataFrame, batch_id: int, base: str) -> None:
        due = F.col("attempts") < max_attempts
        tried = deliver(batch.where(due)).withColumn("attempts", F.col("attempts") + 1)
        outcome = F.when(F.col("ok"), "delivered").when(F.col("attempts") >= max_attempts, "dead").otherwise("retry")
        rows = tried.withColumn("outcome", outcome).drop("ok").unionByName(
            batch.where(~due).withColumn("outcome", F.lit("dead")))
        rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{base}/outbox/batch_id={batch_id}")

    return handler


def retry_stream(spark: SparkSession, base: str, schema) -> DataFrame:
    """The retry rows of a delivery run as the source of the next one.

    A stream over its own retries lists files before it replays a batch, whose files are then replaced: the old ones count as
    missing, and the next run lists the new ones.
    """
    return (spark.readStream.schema(schema).option("ignoreMissingFiles", True)
            .parquet(f"{base}/outbox/batch_id=*/outcome=retry"))


class Delivery:
    """I5 to the end: one checkpointed stream over the pending rows and over its own retry folder.

    ``advance(now)`` runs the stream until nothing is due at ``now``: what fails in one batch comes back as input of a later one, so
    attempts are generations of the same stream. After attempt ``a`` a row waits ``delay_seconds * 2^(a - 1)``; a row that is not due yet
    goes back without losing an attempt. Rows are tried oldest first (by ``order``) within a batch, and those whose attempts
    are exhausted are dead letters, never tried. A batch that is replayed after a lost driver replaces its own output under its
    id, so a result is recorded once (the hook may be called again: delivery itself is at least once). Give ``folder`` to go on.
    Times are naive datetimes of the driver's zone. ``pending`` is a stream with an int column ``attempts`` (NULL: none yet); ``deliver(batch)`` returns the batch with a boolean ``ok`` (NULL fails).
    """

    def __init__(self, pending: DataFrame, name: str, deliver: Callable[[DataFrame], DataFrame], order: Sequence[str],
                 max_attempts: int = DEFAULTS.max_attempts, delay_seconds: int = 30, folder: str | None = None):
        self.spark, self.name, self.deliver, self.order = pending.sparkSession, name, deliver, list(order)
        self.max_attempts, self.delay_seconds = max_attempts, delay_seconds
        self.base = folder or run_folder(self.spark, name)
        self.fresh = pending.withColumn("due_at", F.lit(None).cast("timestamp")).withColumn("written_in", F.lit(None).cast("long"))
        self.schema = self.fresh.schema

    def _handler(self, now: datetime) -> Callable[[DataFrame, int, str], None]:
        at = F.lit(now).cast("timestamp")

        def handler(batch: DataFrame, batch_id: int, base: str) -> None:
            left = F.coalesce("attempts", F.lit(0)) < self.max_attempts
            due = F.col("due_at").isNull() | (F.col("due_at") <= at)
            tried = (self.deliver(batch.where(left & due).orderBy(*self.order))
                     .withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1))
            failed = F.when(F.col("attempts") >= self.max_attempts, "dead").otherwise("retry")
            wait = F.make_interval(secs=self.delay_seconds * F.pow(F.lit(2.0), F.col("attempts") - 1))
            rows = (tried.withColumn("outcome", F.when(F.col("ok"), "delivered").otherwise(failed)).drop("ok")
                    .withColumn("due_at", F.when(F.col("outcome") == "retry", at + wait)))
            waiting = batch.where(left & ~due).withColumn("outcome", F.lit("retry"))
            dead = batch.where(~left).withColumn("outcome", F.lit("dead"))
            out = rows.unionByName(waiting).unionByName(dead).withColumn("came_from", F.col("written_in"))
            (out.withColumn("written_in", F.lit(batch_id).cast("long")).write.mode("overwrite").partitionBy("outcome")
             .parquet(f"{base}/outbox/batch_id={batch_id}"))

        return handler

    def _outbox(self) -> DataFrame:
        return read_sink(self.spark, f"{self.base}/outbox", T.StructType([
            *self.schema, T.StructField("came_from", T.LongType()), T.StructField("outcome", T.StringType())]))

    def _waiting(self) -> DataFrame:
        """Retry rows that no batch has taken up again. A batch's retry rows are taken up together, so the numbers of the
        batches that were (a row each) tell."""
        rows = self._outbox()
        taken = rows.where("came_from IS NOT NULL").select(F.col("came_from").alias("written_in")).distinct()
        return rows.where(F.col("outcome") == "retry").join(taken, "written_in", "left_anti")

    def next_due(self) -> datetime | None:
        """When the first waiting row is due; None when everything is delivered or dead."""
        return self._waiting().agg(F.min("due_at")).first()[0]

    def advance(self, now: datetime) -> datetime | None:
        """Deliver all that is due at ``now``, new rows included; returns :meth:`next_due`."""
        while True:
            stream = self.fresh.unionByName(retry_stream(self.spark, self.base, self.schema))
            run_foreach_batch(stream, self.name, self._handler(now), self.base)
            due = self.next_due()
            if due is None or due > now:
                return due

    def results(self) -> DataFrame:
        """A row per outbox row: delivered, dead, or (still waiting) retry."""
        done = self._outbox().where("outcome <> 'retry'")
        return done.unionByName(self._waiting()).drop("written_in", "came_from")
