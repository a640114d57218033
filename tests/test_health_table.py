"""Incremental health: equal to a report over all rows, replays, late rows, missing values, empty tables."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from modelwatch.operators import drift
from modelwatch.operators.health_table import HealthTable

SCHEMA = "g string, period date, a double, b int"


def _rows(spark, rows):
    return spark.createDataFrame([(g, dt.date(2024, 1, d) if d else None, a, b) for g, d, a, b in rows], SCHEMA)


def _sample(spark, days, shift=0.0):
    return _rows(spark, [(g, d, (7.3 * i * d) % 11 + shift, (i * d) % 5) for d in days for g in ("x", None) for i in range(30)])


def _cells(df):
    return sorted(str(r.asDict()) for r in df.select("g", "feature", "bin", "n_reference", "ref_count", "prod_count").collect())


def test_runs_add_up_to_one_report(spark):
    ref, prod = _sample(spark, [1, 2]), _sample(spark, [3, 4, 5], 2.0).unionByName(
        _rows(spark, [("new", 4, 1.0, None), ("x", 5, float("nan"), None)]))
    state = HealthTable(spark, tempfile.mkdtemp() + "/h", ["a", "b"], ["g"])
    state.set_reference(ref)
    state.extend(prod.where("period <= '2024-01-03' OR (period = '2024-01-04' AND a > 5)"), "period")  # day 4 is cut short
    assert state.mark() == dt.date(2024, 1, 4)
    for _ in range(2):  # the second one is a replay
        state.extend(prod, "period")
        assert _cells(state.counts()) == _cells(drift.bin_counts_wide(ref, prod, ["a", "b"], ["g"]))
    span = prod.where("period = '2024-01-04'")
    assert _cells(state.counts("2024-01-04", "2024-01-04")) == _cells(drift.bin_counts_wide(ref, span, ["a", "b"], ["g"]))


def test_stored_periods_are_not_counted_again_but_late_ones_may_be(spark):
    state = HealthTable(spark, tempfile.mkdtemp() + "/h", ["a"])
    state.set_reference(_sample(spark, [1]))
    first = _rows(spark, [("x", 3, 1.0, 0), ("x", 5, 1.0, 0), ("x", None, 1.0, 0)])
    state.extend(first, "period")
    late = first.unionByName(_rows(spark, [("x", 3, 2.0, 0)]))
    total = lambda: state.counts().agg(F.sum("prod_count")).first()[0]
    state.extend(late, "period")
    assert total() == 2  # day 3 lies before the mark
    state.extend(late, "period", lateness_days=2)
    assert total() == 3


def test_a_reference_stays_and_empty_tables_change_nothing(spark):
    state = HealthTable(spark, tempfile.mkdtemp() + "/h", ["a"], ["g"])
    empty = _rows(spark, [])
    state.set_reference(_sample(spark, [1]))
    before = _cells(state.counts())
    state.set_reference(_sample(spark, [2], 100.0))
    state.extend(empty, "period")
    assert _cells(state.counts()) == before and state.mark() is None
    assert {r["status"] for r in state.report().collect()} == {"insufficient"}
    none = HealthTable(spark, tempfile.mkdtemp() + "/h", ["a"], ["g"])
    none.set_reference(empty)
    none.extend(_sample(spark, [3]), "period")
    assert {r["status"] for r in none.report().collect()} == {"no_reference"}
