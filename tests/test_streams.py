"""Streams: equal to their batch twin after availableNow; a restart from the checkpoint adds nothing."""

import tempfile

from pyspark.sql import functions as F

from modelwatch.streaming import streams as st
from tests.conftest import SF_SMOKE


def _run(df, path, ckpt):
    q = (df.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def test_dedup_equals_batch_and_restart_adds_nothing(spark):
    base = tempfile.mkdtemp(prefix="mw-stream-")
    s = st.table_stream(spark, SF_SMOKE, "events")
    twice = s.unionByName(st.table_stream(spark, SF_SMOKE, "events"))
    out = st.dedup(twice, ["event_id"], "ts", "1 hour")
    _run(out, f"{base}/out", f"{base}/ck")
    first = spark.read.parquet(f"{base}/out").count()
    batch = spark.read.parquet(f"{SF_SMOKE}/events.parquet").select("event_id").distinct().count()
    assert first == batch
    _run(out, f"{base}/out", f"{base}/ck")          # restart: the checkpoint says everything is done
    assert spark.read.parquet(f"{base}/out").count() == first


def test_closed_windows_only(spark):
    s = st.table_stream(spark, SF_SMOKE, "events")
    out = st.run_to_parquet(st.window_counts(s, "ts", "1 day", "1 hour"), "t_windows")
    ev = spark.read.parquet(f"{SF_SMOKE}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    wm = ev.agg(F.max("ts")).first()[0]
    import datetime as dt
    closed = (ev.groupBy(F.window("ts", "1 day").alias("w")).count()
              .where(F.col("w.end") <= F.lit(wm - dt.timedelta(hours=1))))
    assert sorted(r["n"] for r in out.collect()) == sorted(r["count"] for r in closed.collect())


def test_ingest_writes_both_projections_in_one_commit(spark):
    from modelwatch.sources import bindings as b

    base = st.run_foreach_batch(b.prediction_events_of(st.table_stream(spark, SF_SMOKE, "events")), "t_ingest",
                                st.ingest_handler("s"))
    ev, ob = st.ingested_events(spark, base), st.ingested_outbox(spark, base)
    n = spark.read.parquet(f"{SF_SMOKE}/events.parquet").count()
    assert ev.count() == n and ob.count() == n
    assert "subject_id" not in ev.columns and ev.where("subject_key IS NULL").count() == 0


def _files(spark, folder, tables):
    """Write each table as one more file of a stream's source folder."""
    for df in tables:
        df.coalesce(1).write.mode("append").parquet(folder)


def test_several_batches_late_rows_and_a_restart(spark):
    base = tempfile.mkdtemp(prefix="mw-stream-")
    ts = lambda h: F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {h} HOURS")
    part = lambda ids, h: spark.createDataFrame([(i,) for i in ids], "id int").withColumn("ts", ts(h))
    _files(spark, f"{base}/in", [part([1, 2], 0), part([3], 30), part([4], 60)])

    def run():
        stream = (spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
        _run(st.window_counts(stream, "ts", "1 day", "1 hour"), f"{base}/out", f"{base}/ck")

    run()
    first = {str(r["window_start"])[:10]: r["n"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert first == {"2024-01-01": 2, "2024-01-02": 1}     # state went across batches; the last window is open
    _files(spark, f"{base}/in", [part([9], 1), part([5], 90)])   # id 9 is late by two days
    run()                                                    # goes on from the checkpoint
    again = {str(r["window_start"])[:10]: r["n"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert again == {**first, "2024-01-03": 1}
    late = st.late_rows(part([9], 1).unionByName(part([5], 90)), "ts", "1 hour", ts(60))
    assert [r["id"] for r in late.collect()] == [9]


def test_ingest_goes_on_in_the_same_folder(spark):
    from modelwatch.sources import bindings as b

    base = tempfile.mkdtemp(prefix="mw-stream-")
    events = b.prediction_events(spark, SF_SMOKE)
    _files(spark, f"{base}/in", [events.where(f"event_id % 3 = {k}") for k in (0, 1)])

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        st.run_foreach_batch(stream, "t", st.ingest_handler("s"), folder=f"{base}/run")

    run()
    assert st.ingested_events(spark, f"{base}/run").select("batch_id").distinct().count() == 2
    _files(spark, f"{base}/in", [events.where("event_id % 3 = 2")])
    run()
    run()                                                    # nothing new: nothing twice
    done = st.ingested_events(spark, f"{base}/run")
    assert done.count() == events.count() == done.select("request_id").distinct().count()


def test_truth_table_has_every_event_once(spark):
    import datetime as dt

    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    events = spark.createDataFrame([("a", t(1)), ("b", t(1)), ("c", t(20))], "request_id string, created_at timestamp") \
        .withColumn("model_version", F.lit("m"))
    joined = spark.createDataFrame([("a", t(1), "m", 0, t(2)), ("a", t(1), "m", 1, t(3)), ("b", t(1), "m", None, None)],
                                   "request_id string, created_at timestamp, model_version string, label int, labeled_at timestamp")
    got = {r["request_id"]: (r["label"], r["closed"]) for r in st.truth_table(joined, events).collect()}
    assert got == {"a": (1, True), "b": (None, True), "c": (None, False)}


def test_exhausted_rows_are_never_delivered(spark):
    base = tempfile.mkdtemp(prefix="mw-stream-")
    rows = spark.createDataFrame([(1, 0), (2, 4), (3, 5), (4, 0)], "id int, attempts int")
    _files(spark, f"{base}/in", [rows])
    fails = lambda df: df.withColumn("ok", F.col("id") == 4)
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    run = st.run_foreach_batch(stream, "t_delivery", st.delivery_handler(fails))
    got = {r["id"]: (r["outcome"], r["attempts"]) for r in spark.read.parquet(f"{run}/outbox").collect()}
    assert got == {1: ("retry", 1), 2: ("dead", 5), 3: ("dead", 5), 4: ("delivered", 1)}
    ok = lambda df: df.withColumn("ok", F.lit(True))
    again = st.run_foreach_batch(st.retry_stream(spark, run, rows.schema), "t_retry", st.delivery_handler(ok))
    assert [(r["id"], r["attempts"]) for r in spark.read.parquet(f"{again}/outbox").collect()] == [(1, 2)]


def _log(spark, rows):
    """(minute, status, latency) as a request log of 2024-01-01."""
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t0 + dt.timedelta(minutes=m), s, v) for m, s, v in rows], "ts timestamp, status int, latency_seconds double")


def _alerts(spark, base):
    log = spark.readStream.schema("ts timestamp, status int, latency_seconds double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    runs, _ = st.alert_runs(log, "t_alerts", 300, 60, 480, "2 minutes", folder=f"{base}/run")
    return {(r["series"], str(r["run_start"])[11:16], str(r["run_end"])[11:16], r["windows"], r["fired"]): r["closed"] for r in runs.collect()}


def test_alert_runs_go_on_after_a_restart_and_equal_the_batch(spark):
    from modelwatch.operators import traffic as tr

    base = tempfile.mkdtemp(prefix="mw-stream-")
    minutes = [(m, 500 if m in (3, 40, 41, 42, 43, 44, 45, 46, 47) else 200, 0.7 if 20 <= m < 23 or m >= 70 else 0.01) for m in range(0, 80)]
    parts = [_log(spark, minutes[:42]), _log(spark, minutes[42:60]), _log(spark, minutes[60:])]

    def batch():
        log = spark.read.parquet(f"{base}/in")
        er = tr.error_rate(log, "5 minutes", "1 minute").select(F.lit("high_error_rate").alias("series"), "window_start", "alert")
        p95 = tr.p95_bucketed(log, "5 minutes", "1 minute").select(F.lit("high_latency_p95").alias("series"), "window_start", "alert")
        out = tr.sustained(er.unionByName(p95), ["series"], "window_start", F.col("alert"), 300, 480, 60)
        return {(r["series"], str(r["run_start"])[11:16], str(r["run_end"])[11:16], r["windows"], r["fired"]) for r in out.collect()}

    closed = set()
    for part in parts:
        _files(spark, f"{base}/in", [part])
        got = _alerts(spark, base)
        assert set(got) == batch()                      # after each restart: one row per run, open ones as they stand
        done = {k for k, c in got.items() if c}
        assert closed <= done
        closed = done
    assert _alerts(spark, base) == got                  # nothing new: nothing changes
    assert ("high_error_rate", "00:36", "00:52", 12, True) in closed and not all(got.values())


def test_open_windows_are_replaced_until_they_close(spark):
    base = tempfile.mkdtemp(prefix="mw-stream-")

    def run():
        stream = spark.readStream.schema("ts timestamp, status int, latency_seconds double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        rows, _ = st.run_keyed(st.window_counts(stream, "ts", "10 minutes", "5 minutes"), "t_keyed", ["window_start"], f"{base}/run")
        return {r["window_start"].minute: (r["n"], r["closed"]) for r in st.with_closed(rows, "5 minutes").collect()}

    _files(spark, f"{base}/in", [_log(spark, [(1, 200, 0.1), (2, 200, 0.1)]), _log(spark, [(3, 200, 0.1), (12, 200, 0.1)])])
    assert run() == {0: (3, False), 10: (1, False)}
    _files(spark, f"{base}/in", [_log(spark, [(4, 200, 0.1), (16, 200, 0.1)])])   # not late yet
    assert run() == {0: (4, True), 10: (2, False)}
    _files(spark, f"{base}/in", [_log(spark, [(5, 200, 0.1), (30, 200, 0.1)])])   # minute 5 is late: its window has closed
    assert run() == {0: (4, True), 10: (2, True), 30: (1, False)}


def _pending(spark, base):
    rows = spark.createDataFrame([(1, 0, 0), (2, 0, 4), (3, 0, 5), (4, 3, 1), (5, 0, 3), (6, None, 2), (6, 0, 2)],
                                 "id int, attempts int, fails int")
    _files(spark, f"{base}/in", [rows.where("id < 4"), rows.where("id >= 4")])
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def _tries(batch):
    return batch.withColumn("fails", F.col("fails") - 1).withColumn("ok", F.when(F.col("fails") < 0, True))  # NULL: failed


def _outcomes(run):
    return sorted((r["id"], r["outcome"], r["attempts"]) for r in run.results().collect())


def test_delivery_goes_on_until_nothing_is_due(spark):
    import datetime as dt

    run = st.Delivery(_pending(spark, tempfile.mkdtemp()), "t_all", _tries, ["id"], delay_seconds=10)
    now = dt.datetime(2024, 1, 1)
    due = run.advance(now)
    assert due == now + dt.timedelta(seconds=10)
    assert _outcomes(run) == [(1, "delivered", 1), (2, "retry", 1), (3, "retry", 1), (4, "retry", 4), (5, "retry", 1), (6, "retry", 1), (6, "retry", 1)]
    assert run.advance(now + dt.timedelta(seconds=9)) == due  # too early: no attempt is lost
    assert _outcomes(run)[1] == (2, "retry", 1)
    waits = []
    while due is not None:
        waits.append((due - now).total_seconds())
        due = run.advance(due)
    assert waits == [10, 30, 70, 80, 150]  # 10 + 20 + 40 + 80 s; id 4 waits 80 s after its fourth attempt
    assert _outcomes(run) == [(1, "delivered", 1), (2, "delivered", 5), (3, "dead", 5), (4, "delivered", 5), (5, "delivered", 4),
                              (6, "delivered", 3), (6, "delivered", 3)]


def test_a_delivery_batch_that_is_replayed_counts_once(spark):
    import datetime as dt

    import pytest

    pending = _pending(spark, tempfile.mkdtemp())
    run = st.Delivery(pending, "t_replay", _tries, ["id"], delay_seconds=10)
    now, plain = dt.datetime(2024, 1, 1), run._handler

    def lost(at):
        def handler(batch, batch_id, base):
            plain(at)(batch, batch_id, base)
            if batch_id == 1:
                raise RuntimeError("driver lost after the write, before the commit")
        return handler

    run._handler = lost
    with pytest.raises(Exception, match="driver lost"):
        run.advance(now)
    again = st.Delivery(pending, "t_replay", _tries, ["id"], delay_seconds=10, folder=run.base)
    due = again.advance(now)
    while due is not None:
        due = again.advance(due)
    assert _outcomes(again) == [(1, "delivered", 1), (2, "delivered", 5), (3, "dead", 5), (4, "delivered", 5), (5, "delivered", 4),
                                (6, "delivered", 3), (6, "delivered", 3)]


def test_exhausted_and_empty_deliveries(spark):
    import datetime as dt

    base = tempfile.mkdtemp()
    rows = spark.createDataFrame([(1, 5)], "id int, attempts int")
    _files(spark, f"{base}/in", [rows])
    never = lambda df: df.withColumn("ok", F.lit(True))
    run = st.Delivery(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "t_dead", never, ["id"])
    assert run.advance(dt.datetime(2024, 1, 1)) is None and _outcomes(run) == [(1, "dead", 5)]
    empty = f"{base}/none"
    rows.limit(0).write.parquet(empty)
    run = st.Delivery(spark.readStream.schema(rows.schema).parquet(empty), "t_none", never, ["id"])
    assert run.advance(dt.datetime(2024, 1, 1)) is None and _outcomes(run) == []
