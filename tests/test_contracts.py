"""Features, contracts, privacy: coercion, plan-time errors, HMAC parity with Python."""

import hashlib
import hmac

import pytest

from modelwatch.functions.hashing import subject_key
from modelwatch.operators import contracts as ct
from modelwatch.operators import features as fe
from modelwatch.operators import privacy as pv


def test_build_features_drops_and_coerces(spark):
    df = spark.createDataFrame([("C1", " ", 5, 1), ("C2", "12.5", 3, 0), ("C3", "1d", 1, 0)],
                               "customer_id string, total_charges string, tenure bigint, churn bigint")
    out = fe.build_features(df, "total_charges", "churn", ["customer_id", "absent_col"])
    assert out.columns == ["total_charges", "tenure"]
    assert [r["total_charges"] for r in out.orderBy("tenure").collect()] == [0.0, 12.5, 0.0]
    assert fe.coerced_count(df, "total_charges").collect()[0]["coerced"] == 2
    # input untouched
    assert df.columns == ["customer_id", "total_charges", "tenure", "churn"]


def test_required_and_target_checks(spark):
    df = spark.createDataFrame([(1, 2)], "a int, target int")
    with pytest.raises(ValueError, match="lacks required columns"):
        ct.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="target holds values"):
        ct.check_target(df, "target")


def test_scoring_contract(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, extra int")
    assert ct.scoring_contract(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        ct.scoring_contract(df, ["a", "c"])
    with pytest.raises(ValueError):
        ct.scoring_contract(df, ["a"], target="extra")


def test_contract_collects_all_failures(spark):
    contract = ct.Contract({"x": ct.ColumnSpec("float"), "y": ct.ColumnSpec("int", allowed=(0, 1)),
                            "z": ct.ColumnSpec("str"), "w": ct.ColumnSpec("str", nullable=True)})
    df = spark.createDataFrame([(" ", 2, None, None), ("1.5", 1, "a", "b")], "x string, y bigint, z string, w string")
    got = {(r["column_name"], r["check_name"]): r["failures"] for r in ct.violation_counts(df, contract).collect()}
    assert got == {("x", "dtype"): 1, ("y", "isin"): 1, ("z", "not_nullable"): 1}
    good, bad = ct.split_valid(df, contract)
    assert good.count() == 1 and bad.count() == 1


def test_payload_check(spark):
    df = spark.createDataFrame([('{"k": 1, "value": 2.5}',), ('{"k": "x", "extra": 1}',)], "payload string")
    rows = ct.payload_check(df, "payload", {"k": "int", "value": "float"}).collect()
    assert rows[0]["valid"] and not rows[1]["valid"]
    assert (rows[1]["unknown_fields"], rows[1]["missing_fields"], rows[1]["bad_types"]) == ("extra", "value", "k")


def test_hmac_equals_python(spark):
    ids = ["123", "  cust-9 ", "é-ünicode", "", "   ", None, "\ufeff9", "\u2003x\x1f", "\u3000"]
    salt = "a salt"
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    got = [r[0] for r in df.select(subject_key("s", salt)).collect()]
    want = [None if not i or not i.strip() else hmac.new(salt.encode(), i.strip().encode(), hashlib.sha256).hexdigest()
            for i in ids]
    assert got == want


def test_erasure_by_key(spark):
    events = spark.createDataFrame([("r1", "u1"), ("r2", "u2"), ("r3", "u1"), ("r4", None)],
                                   "request_id string, subject_id string")
    keyed = pv.with_subject_key(events, "subject_id", "s")
    erase = spark.createDataFrame([("u1",), (" ",)], "subject_id string")
    remaining, report = pv.erase_subjects(keyed, erase, "s")
    assert sorted(r[0] for r in remaining.select("request_id").collect()) == ["r2", "r4"]
    assert {r["subject_id"]: r["erased"] for r in report.collect()} == {"u1": 2, " ": 0}


def test_redact_document(spark):
    df = spark.createDataFrame([({"City": "x", "Tenure Months": "3"},)], "features map<string,string>")
    assert pv.redact_document(df, "features").collect()[0][0] == {"Tenure Months": "3"}


def test_reference_and_production_fallbacks(spark, tmp_path):
    from modelwatch.sources.tables import reference_and_production

    ref = spark.createDataFrame([(1.0,)], "x double")
    ref.write.parquet(str(tmp_path / "ref"))
    legacy = spark.createDataFrame([(2.0,)], "x double")
    legacy.write.parquet(str(tmp_path / "legacy"))
    empty = spark.createDataFrame([], "x double")
    r, p, status = reference_and_production(spark, str(tmp_path / "ref"), empty, str(tmp_path / "legacy"))
    assert status == "ok" and p.collect()[0]["x"] == 2.0
    r, p, status = reference_and_production(spark, str(tmp_path / "ref"), legacy, None)
    assert status == "ok" and p.collect()[0]["x"] == 2.0
    assert reference_and_production(spark, str(tmp_path / "nope"), legacy)[2] == "unknown"
    assert reference_and_production(spark, str(tmp_path / "ref"), empty, None)[2] == "unknown"


def test_synthetic_customers_deterministic(spark):
    from pyspark.sql import functions as F

    from modelwatch.sources.synthetic import synthetic_customers

    keys = spark.range(0, 2000).withColumnRenamed("id", "k").withColumn("c", F.lit("X"))
    a = synthetic_customers(keys.repartition(7), "k", "c")
    b = synthetic_customers(keys.repartition(3), "k", "c")
    assert len(a.columns) == 33
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0     # same rows for any partitioning
    s = a.agg(F.avg("Churn Value").alias("r"), F.min("Tenure Months").alias("lo"), F.max("Tenure Months").alias("hi"),
              F.max(F.abs(F.col("Total Charges").try_cast("double")
                          - F.col("Monthly Charges") * F.col("Tenure Months"))).alias("noise")).first()
    assert 0.23 < s["r"] < 0.31 and s["lo"] >= 0 and s["hi"] <= 72 and s["noise"] <= 50.01
    far = spark.range(99_990, 100_090).withColumnRenamed("id", "k").withColumn("c", F.lit("X"))
    assert synthetic_customers(far, "k", "c").select("CustomerID").distinct().count() == 100


def test_joins_are_the_same_with_and_without_broadcast(spark, monkeypatch):
    from modelwatch.operators import common

    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (None, 20), (3, 30)], "k int, y int")
    for limit in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        small = common.broadcast_stored(right, 16)
        got = sorted(map(tuple, common.null_safe_join(left, small, ["k"]).collect()), key=str)
        assert got == sorted([(1, "a", 10), (None, "b", 20), (None, "d", 20)], key=str)
    full = {(r["k"], r["x"], r["y"]) for r in common.null_safe_join(left, right, ["k"], "full").collect()}
    assert full == {(1, "a", 10), (None, "b", 20), (None, "d", 20), (2, "c", None), (3, None, 30)}
    one = spark.createDataFrame([(7, "z")], "m int, n string")
    assert [r["m"] for r in common.null_safe_join(left, one, []).collect()] == [7] * 4


def test_payload_edges(spark):
    texts = ['{"k": null, "value": 1}', "not json", '{"k": 3.0, "value": "2"}', '{"k": 3.5, "value": 2}', "[1]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = {r["i"]: r for r in ct.payload_check(df, "payload", {"k": "int", "value": "float"}).collect()}
    assert [got[i]["valid"] for i in range(6)] == [False, False, True, False, False, False]
    assert [got[i]["parse_error"] for i in range(6)] == [False, True, False, False, True, True]
    assert got[0]["bad_types"] == "k" and got[3]["bad_types"] == "k" and got[1]["missing_fields"] == ""


def test_integral_doubles_and_missing_columns(spark):
    contract = ct.Contract({"n": ct.ColumnSpec("int"), "gone": ct.ColumnSpec("str")})
    df = spark.createDataFrame([(1.0,), (2.5,), (3e7,)], "n double")
    good, bad = ct.split_valid(df, contract)
    assert good.count() == 0 and bad.count() == 3       # a missing required column fails every row
    good, bad = ct.split_valid(df, ct.Contract({"n": ct.ColumnSpec("int")}))
    assert sorted(r["n"] for r in good.collect()) == [1, 30_000_000] and [r["n"] for r in bad.collect()] == [2.5]


def test_bundle_rules(spark):
    rows = [(["a", "a"], None, None), (["a"], 1, None), (["a"], 2, None), ([], None, None), (["a", ""], None, None)]
    df = spark.createDataFrame(rows, "feature_schema array<string>, feature_count int, metrics map<string,double>")
    got = [r["reasons"] for r in ct.bundle_check(df).collect()]
    assert got == [[], [], ["feature_count_mismatch"], ["empty_feature_schema"], ["blank_feature_name"]]


def test_only_missing_paths_count_as_absent(spark, tmp_path):
    from modelwatch.sources.tables import read_if_present, read_training_table

    assert read_if_present(spark, str(tmp_path / "nope")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("this is no parquet file, and longer than a footer")
    with pytest.raises(Exception, match="(?i)parquet|footer|corrupt"):
        read_if_present(spark, str(tmp_path / "bad"))
    spark.range(3).write.parquet(str(tmp_path / "raw"))
    df, path = read_training_table(spark, str(tmp_path / "raw"), str(tmp_path / "none"))
    assert df.count() == 3 and path.endswith("raw")
    with pytest.raises(FileNotFoundError):
        read_training_table(spark, str(tmp_path / "x"), str(tmp_path / "y"))


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from modelwatch.session import ensure_checkpoint_dir

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None),
                               sparkContext=SimpleNamespace(master=master, setCheckpointDir=lambda d: None))

    for master in ("local", "local[*]", "local[8]", "local[4,2]"):
        assert ensure_checkpoint_dir(session(master))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(session(master))


def test_document_keys_are_bounded(spark):
    import pytest

    from modelwatch.operators.events import document_keys

    df = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"},)], "features map<string,string>")
    assert document_keys(df) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        document_keys(df, max_keys=2)


def test_feature_types_fall_back_to_the_sample_and_to_text(spark):
    rows = spark.createDataFrame([("1", "1.5", "true", "a", None, True, 3), (None, "2", "False", "1", None, False, 4)],
                                 "i string, f string, b string, s string, e string, tb boolean, ti int")
    names = ["i", "f", "b", "s", "e", "tb", "ti"]
    assert ct.feature_types(names, None, rows) == {"i": "float", "f": "float", "b": "bool", "s": "str", "e": "float", "tb": "bool", "ti": "int"}
    assert ct.feature_types(["i", "x"], {"i": "int", "y": "float"}, rows) == {"i": "int", "x": "str"}
    assert ct.feature_types(["i", "x"], None, rows) == {"i": "str", "x": "str"} == ct.feature_types(["i", "x"])
    assert ct.feature_types(["i", "s"], None, rows.limit(0)) == {"i": "float", "s": "float"}
