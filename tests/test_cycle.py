"""Retraining table and acting cycles: marks, late and corrected labels, replays, cut-off cycles."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import contracts, cycle, jobs, retraining, train
from modelwatch.plans import cycle_queries
from modelwatch.sources.tables import read_training_table, write_snapshot

T = lambda d: dt.datetime(2024, 1, d)


def _base(spark):
    return spark.createDataFrame([("a", 1.0, 0, "x"), ("a", 1.0, 0, "x")], "id string, amount double, churn int, extra string")


def _events(spark, ids):
    return spark.createDataFrame([(f"r{i}", float(i), "ignored") for i in ids], "request_id string, amount double, other string")


def _labels(spark, rows):
    return spark.createDataFrame([(f"r{i}", y, t) for i, y, t in rows], "request_id string, label int, labeled_at timestamp")


def _content(spark, path):
    rows, used = read_training_table(spark, f"{path}/none", path)
    assert used == path and rows.columns == ["id", "amount", "churn", "extra"]
    return sorted((r["id"] or "", r["amount"], r["churn"], r["extra"] or "") for r in rows.collect())


def test_only_new_labels_are_added_and_the_latest_counts(spark, tmp_path):
    path = str(tmp_path / "retraining")
    base, events = _base(spark), _events(spark, range(6))
    add = lambda labels, run, **kw: {r["_request_id"] for r in retraining.extend(
        spark, path, base, events, _labels(spark, labels), "churn", run, **kw).collect()}
    seen = [(1, 1, T(1)), (2, 0, T(2)), (9, 1, T(2)), (3, 7, T(2))]       # no such event; no such label
    assert add(seen, "one") == {"r1", "r2"}
    twice = [("a", 1.0, 0, "x")] * 2                                      # base duplicates stay
    assert _content(spark, path) == sorted([("", 1.0, 1, ""), ("", 2.0, 0, ""), *twice])
    seen += [(4, 1, T(2)), (1, 0, T(5)), (5, 1, T(1))]                    # a tie with the mark, a correction, one behind the mark
    assert add(seen, "two") == {"r4", "r1"}
    assert add(seen, "two") == {"r4", "r1"}                               # a replay replaces its part
    assert _content(spark, path) == sorted([("", 1.0, 0, ""), ("", 2.0, 0, ""), ("", 4.0, 1, ""), *twice])
    assert add(seen, "three", lateness="10 days") == {"r5"}
    assert len(_content(spark, path)) == 6


def test_without_labels_the_table_is_the_base(spark, tmp_path):
    path = str(tmp_path / "retraining")
    assert retraining.extend(spark, path, _base(spark), _events(spark, [1]), _labels(spark, []), "churn", "one").count() == 0
    assert _content(spark, path) == [("a", 1.0, 0, "x")] * 2


SPEC = jobs.TrainingSpec(model_name="m", contract=contracts.Contract({}), key="id", target="churn", order="amount", charges="charges",
                         numeric=["amount", "other"], categorical=[])
V0, V1, V2 = "churn_model_20240101_000000", "churn_model_20240102_000000", "churn_model_20240103_000000"


def _trained(spark, root, version, metric):
    """What a training run leaves behind."""
    row = spark.createDataFrame([("m", f"{version}_lr", True, {"pr_auc": metric}, ["amount"], True)],
                                "model_name string, model_version string, has_metadata boolean, metrics map<string,double>, "
                                "feature_schema array<string>, is_winner boolean")
    write_snapshot(row, f"{root}/experiments", version, key="run")
    write_snapshot(spark.range(100).select(F.col("id").cast("double").alias("amount"), F.col("id").cast("double").alias("other")), f"{root}/reference", version)
    return spark.createDataFrame([("lr", True, metric)], "candidate string, is_winner boolean, pr_auc double")


@pytest.fixture
def job(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    _trained(spark, root, V0, 0.5)
    first = spark.createDataFrame([("m", f"{V0}_lr", T(1), 1, "raw", "training", None, {"pr_auc": 0.5})],
                                  "model_name string, model_version string, ts timestamp, seq bigint, dataset string, trigger string, "
                                  "parent_model string, metrics map<string,double>")
    write_snapshot(first, f"{root}/lineage", V0, key="run")
    spark.createDataFrame([("a", 1.0, 1.0, 0)], "id string, amount double, other double, churn int").write.parquet(f"{root}/raw")
    calls, fail = [], set()

    def training_run(spark, root, spec, version, *a, **kw):
        calls.append(version)
        if version in fail:
            fail.discard(version)
            raise RuntimeError("lost")
        return _trained(spark, root, version, 0.6)

    monkeypatch.setattr(jobs, "training_run", training_run)
    monkeypatch.setattr(cycle.features, "preclean", lambda df, charges: df)

    def run(version, far=1000, n=50, **kw):
        events = spark.range(n).select(F.concat(F.lit("r"), "id").alias("request_id"), (F.col("id") + far).cast("double").alias("amount"),
                                       (F.col("id") + far).cast("double").alias("other"))
        return cycle.run_cycle(spark, root, SPEC, version, "2024-01-09 00:00:00", f"{root}/raw", events, _labels(spark, [(1, 1, T(1))]), **kw)

    return root, run, calls, fail


def _state(spark, root):
    served = [(r["seq"], r["action"], r["model_version"]) for r in cycle.registry(spark, root).orderBy("seq").collect()]
    return served, spark.read.parquet(f"{root}/lineage").count()


def test_cut_off_cycle_goes_on_and_a_replay_changes_nothing(spark, job):
    root, run, calls, fail = job
    fail.add(V1)
    with pytest.raises(RuntimeError):
        run(V1)
    assert _state(spark, root) == ([], 1)
    want = {"retrained": True, "promoted": True, "rolled_back": False}
    assert run(V1) == want and run(V1) == want
    assert calls == [V1, V1]                                 # once more after the failure, never again
    after = ([(1, "promote", f"{V1}_lr")], 2)
    assert _state(spark, root) == after
    # not good enough: the earlier version comes back, once
    want = {"retrained": True, "promoted": False, "rolled_back": True}
    assert run(V2, far=5000, min_improvement=0.5) == want and run(V2, far=5000, min_improvement=0.5) == want
    assert _state(spark, root) == (after[0] + [(2, "rollback", f"{V0}_lr")], 2)


def test_healthy_and_unknown_cycles_train_nothing(spark, job):
    root, run, calls, _ = job
    nothing = {"retrained": False, "promoted": False, "rolled_back": False}
    assert run(V1, far=0, n=100) == nothing and run(V2, n=0) == nothing
    assert calls == [] and _state(spark, root) == ([], 1)
    assert spark.read.parquet(f"{root}/cycle_log/cycle={V2}/step=verdict").first()["status"] == "unknown"


def test_a_training_run_reads_its_table_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = [(f"c{i}", float(i), float(i % 7), " ", i % 2) for i in range(60)] + [("bad", None, 1.0, "1", 0)]
    spark.createDataFrame(rows, "id string, amount double, other double, charges string, churn int").write.parquet(f"{root}/raw")
    spec = jobs.TrainingSpec(model_name="m", contract=contracts.Contract({"id": contracts.ColumnSpec("str"), "amount": contracts.ColumnSpec("float")}),
                             key="id", target="churn", order="amount", charges="charges", numeric=["amount", "other"], categorical=[])
    read, split, write = [], jobs.temporal_split, jobs.write_snapshot
    monkeypatch.setattr(jobs, "temporal_split", lambda df, *a: read.extend(df.inputFiles()) or split(df, *a))
    monkeypatch.setattr(jobs, "write_snapshot", lambda df, *a, **kw: read.extend(df.inputFiles()) or write(df, *a, **kw))
    board = jobs.training_run(spark, root, spec, V0, "2024-01-01 00:00:00", f"{root}/raw", which=["logistic_regression"])
    assert [r["candidate"] for r in board.collect()] == ["logistic_regression"]
    assert read and not [f for f in read if f"{root}/raw/" in f]         # the checked rows, stored
    bad = spark.read.parquet(f"{root}/quarantine").collect()
    assert [(r["id"], r["column_name"], r["check_name"]) for r in bad] == [("bad", "amount", "not_nullable")]
    counts = {r["split"]: r["count"] for r in spark.read.parquet(f"{root}/prepared").groupBy("split").count().collect()}
    assert counts == {"train": 48, "test": 12}


def test_cycles_build_their_customers_once(spark, monkeypatch):
    built = []
    small = spark.createDataFrame([("C1", "x", "A", 70, None, "1", 5.0, 1), ("C26", "x", "A", 3, 2.0, "1", 5.0, 0)],
                                  "customer_id string, country string, segment string, tenure_months long, monthly_charges double, "
                                  "total_charges string, balance double, churn_value long")
    monkeypatch.setattr(cycle_queries.b, "customer_contract", lambda spark, sf_dir: built.append(sf_dir) or small)
    monkeypatch.setattr(cycle_queries, "_contracts", {})
    parts = [f(spark, "here") for f in (cycle_queries._base, cycle_queries._production, cycle_queries._labels)]
    assert [p.count() for p in parts] == [1, 1, 2] and built == ["here"]
    assert all("stored/customers" in f for p in parts for f in p.inputFiles())


def test_candidates_are_fitted_at_the_same_time(spark, monkeypatch):
    class Meeting:
        def __init__(self, barrier, fails=False):
            self.barrier, self.fails = barrier, fails

        def fit(self, df):
            self.barrier.wait(60)
            if self.fails:
                raise RuntimeError("no fit")
            return df.count()

    df = spark.createDataFrame([(float(i), i % 2) for i in range(10)], "x double, y int")
    meet = threading.Barrier(2)
    monkeypatch.setattr(train, "candidates", lambda *a, **kw: {"a": Meeting(meet), "b": Meeting(meet)})
    fitted = train.train_candidates(df, ["x"], [], "y")
    assert {name: m.stages[-1] for name, m in fitted.items()} == {"a": 10, "b": 10}
    monkeypatch.setattr(train, "candidates", lambda *a, **kw: {"a": Meeting(meet), "b": Meeting(meet, fails=True)})
    with pytest.raises(RuntimeError):
        train.train_candidates(df, ["x"], [], "y")
    # a small table is not cut up; one that fills the slots comes in whole waves
    assert [train.fit_partitions(n, 12) for n in (0, 72_000, 720_000, 4_320_000)] == [1, 1, 12, 48]
