"""The stored event table: late redelivery, replays, erasure by bucket, tombstones, nulls and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from modelwatch.functions.hashing import subject_key
from modelwatch.operators.event_table import EventTable

T = lambda d: dt.datetime(2024, 1, d)
SCHEMA = "request_id string, created_at timestamp, subject string, amount double, features map<string,string>"


def _events(spark, rows):
    df = spark.createDataFrame([(i, t, s, 1.0, {"k": "v"}) for i, t, s in rows], SCHEMA)
    return df.withColumn("subject_key", subject_key("subject", "salt")).drop("subject")


def _ids(table, spark):
    rows = [r["request_id"] for r in table.read(spark).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _erase(table, spark, subjects, run, day):
    report = table.erase(spark.createDataFrame([(s,) for s in subjects], "subject_id string"), "salt", run, F.lit(T(day)))
    return {r["subject_id"]: r["erased"] for r in report.collect()}


def _key(spark, subject):
    return spark.range(1).select(subject_key(F.lit(subject), "salt").alias("k")).first()["k"]


def test_a_redelivery_a_week_late_leaves_one_row(spark, tmp_path):
    table = EventTable(str(tmp_path / "t"), 4)
    first = [(f"r{i}", T(1), f"s{i % 7}") for i in range(40)] + [("r0", T(1), "s0"), ("n", T(1), None), (None, T(1), "s1")]
    table.add(_events(spark, first), "a")
    assert _ids(table, spark) == {f"r{i}" for i in range(40)} | {"n"}
    late = [("r3", T(8), "s3"), ("n", T(8), " "), ("new", T(8), "s3")]
    table.add(_events(spark, late), "b")
    assert _ids(table, spark) == {f"r{i}" for i in range(40)} | {"n", "new"}
    assert table.read(spark).where("request_id = 'r3'").first()["created_at"] == T(1)  # the stored one stays
    for events, part in ((late, "b"), (first, "a")):  # replays in any order change nothing
        table.add(_events(spark, events), part)
        assert _ids(table, spark) == {f"r{i}" for i in range(40)} | {"n", "new"}
    table.add(_events(spark, []), "c")
    assert table.read(spark).count() == 42 and table.read(spark).first()["features"] == {"k": "v"}


def test_erased_subjects_do_not_come_back(spark, tmp_path):
    table = EventTable(str(tmp_path / "t"), 4)
    rows = [(f"r{i}", T(1 + i % 3), f"s{i % 5}") for i in range(30)] + [("n", T(1), None)]
    for part in range(3):
        table.add(_events(spark, [r for i, r in enumerate(rows) if i % 3 == part]), str(part))
    left = {i for i, _, s in rows if s != "s2"}
    assert _erase(table, spark, ["s2", "nobody", " "], "one", 9) == {"s2": 6, "nobody": 0, " ": 0}
    assert _ids(table, spark) == left
    assert _erase(table, spark, ["s2", "nobody", " "], "one", 9) == {"s2": 6, "nobody": 0, " ": 0}  # a repeated run
    table.add(_events(spark, rows), "again")   # everything once more, as another part and as the first one
    table.add(_events(spark, [r for i, r in enumerate(rows) if i % 3 == 0]), "0")
    assert _ids(table, spark) == left
    table.add(_events(spark, [("back", T(10), "s2")]), "later")  # after the erasure: a new event of the subject
    assert _ids(table, spark) == left | {"back"}


def test_a_subject_without_rows_left_and_an_empty_table(spark, tmp_path):
    table = EventTable(str(tmp_path / "t"), 2)
    assert _erase(table, spark, ["s"], "zero", 1) == {"s": 0}
    table.add(_events(spark, [("a", T(2), "s"), ("b", T(2), "s")]), "a")
    assert _erase(table, spark, ["s"], "one", 9) == {"s": 2}
    assert table.read(spark).count() == 0 and table.read_subject(spark, _key(spark, "s")).count() == 0


def test_only_touched_folders_are_read_and_rewritten(spark, tmp_path):
    table = EventTable(str(tmp_path / "t"), 8)
    table.add(_events(spark, [(f"r{i}", T(1), f"s{i % 40}") for i in range(200)]), "a")
    key = _key(spark, "s3")
    one = table.read_subject(spark, key)
    assert one.count() == 5 and {f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()} != set()
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert _erase(table, spark, ["s3"], "one", 9) == {"s3": 5}
    kept = {p.parent.parent.name for p in files if p.exists() and "bucket=" in str(p)}
    gone = {p.parent.parent.name for p in files if not p.exists()}
    assert len(gone) == 1 and kept.isdisjoint(gone) and len(kept) == 7
