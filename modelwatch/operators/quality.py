"""Data quality (D1–D8): missing ratios, IQR outliers, category and schema changes, score.

Wide inputs are unpivoted once into ``(*by, column, value)`` so every column is
handled by one aggregation with map-side partial combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.functions.numeric import is_missing, present_number
from modelwatch.operators.common import broadcast_stored, null_safe_join
from modelwatch.operators.ordered import quantiles
from modelwatch.params import DEFAULTS

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def missing_ratios(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Per (group, column) share of NULL / NaN values, 6 decimals."""
    cols = [c for c in (columns or df.columns) if c not in by]
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.avg(is_missing(c, types[c]).cast("double")).alias(c) for c in cols]
    wide = (df.groupBy(*by) if by else df).agg(*aggs)
    return wide.unpivot(list(by), cols, "column_name", "missing_ratio").select(
        *by, "column_name", F.round("missing_ratio", 6).alias("missing_ratio"))


def _long_numeric(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column_name", "value")


def iqr_bounds(reference: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None,
               k: float = DEFAULTS.iqr_multiplier) -> DataFrame:
    """Q1 − k·IQR, Q3 + k·IQR per (group, column), linear-interpolated quantiles (exact, from counted values)."""
    cols = list(columns or numeric_columns(reference, by))
    b = quantiles(_long_numeric(reference, by, cols), "value", {"q1": 0.25, "q3": 0.75}, [*by, "column_name"])
    iqr = F.col("q3") - F.col("q1")
    return b.select(*by, "column_name", (F.col("q1") - k * iqr).alias("lower_bound"),
                    (F.col("q3") + k * iqr).alias("upper_bound"))


def iqr_outliers(production: DataFrame, reference: DataFrame | None = None, by: Sequence[str] = (),
                 columns: Sequence[str] | None = None, k: float = DEFAULTS.iqr_multiplier,
                 digits: int = 4) -> DataFrame:
    """D3: values strictly outside the bounds; missing dropped; ratio = count / max(n, 1).

    Bounds are reported at ``digits`` decimals (4 in the reference's report).
    """
    ref = reference if reference is not None else production
    cols = list(columns or [c for c in numeric_columns(production, by) if c in ref.columns])
    bounds = broadcast_stored(iqr_bounds(ref, by, cols, k), 256, "bounds")
    long = _long_numeric(production, by, cols).where(present_number("value"))
    keys = list(by) + ["column_name"]
    counts = (
        null_safe_join(long, bounds, keys)
        .groupBy(*keys)
        .agg(
            F.count_if((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))).alias("n_out"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    out = null_safe_join(bounds, counts, keys, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    n_out = F.coalesce(F.col("n_out"), F.lit(0))
    return out.select(
        *keys,
        F.round("lower_bound", digits).alias("lower_bound"),
        F.round("upper_bound", digits).alias("upper_bound"),
        n_out.cast("bigint").alias("outlier_count"),
        F.round(n_out / F.greatest(n, F.lit(1)), 6).alias("outlier_ratio"),
    )


def _distinct_values(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    long = df.select(*by, *cols).unpivot(list(by), list(cols), "column_name", "category")
    return long.where(F.col("category").isNotNull()).distinct()


def category_changes(production: DataFrame, reference: DataFrame, by: Sequence[str] = (),
                     columns: Sequence[str] | None = None) -> DataFrame:
    """D4 (long form): one row per category that is new in production or missing from it."""
    cols = list(columns or [c for c in string_columns(production, by) if c in reference.columns])
    keys = list(by) + ["column_name", "category"]
    p = _distinct_values(production, by, cols).withColumn("in_prod", F.lit(True))
    r = _distinct_values(reference, by, cols).withColumn("in_ref", F.lit(True))
    both = p.join(r, keys, "full_outer")
    return both.where(F.col("in_prod").isNull() | F.col("in_ref").isNull()).select(
        *keys, F.when(F.col("in_ref").isNull(), "new").otherwise("missing").alias("change"))


def category_summary(production: DataFrame, reference: DataFrame, by: Sequence[str] = (),
                     columns: Sequence[str] | None = None) -> DataFrame:
    """D4 (summary): cardinality on both sides and the number of new / missing categories."""
    cols = list(columns or [c for c in string_columns(production, by) if c in reference.columns])
    keys = list(by) + ["column_name", "category"]
    p = _distinct_values(production, by, cols).withColumn("in_prod", F.lit(1))
    r = _distinct_values(reference, by, cols).withColumn("in_ref", F.lit(1))
    both = p.join(r, keys, "full_outer")
    return both.groupBy(*by, "column_name").agg(
        F.count_if(F.col("in_prod").isNotNull()).cast("bigint").alias("production_cardinality"),
        F.count_if(F.col("in_ref").isNotNull()).cast("bigint").alias("reference_cardinality"),
        F.count_if(F.col("in_ref").isNull()).cast("bigint").alias("new_count"),
        F.count_if(F.col("in_prod").isNull()).cast("bigint").alias("missing_count"),
    )


def schema_drift(production: DataFrame, reference: DataFrame) -> tuple[list[str], list[str]]:
    """D5 for tables: (new columns, missing columns), sorted. Plan-time, no job."""
    p, r = set(production.columns), set(reference.columns)
    return sorted(p - r), sorted(r - p)


def key_drift(documents: DataFrame, doc_col: str, expected_keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """D5 for JSON documents: per group the keys seen beyond / short of the expected set.

    The key set of a group is the union of its rows' keys (``explode(map_keys)`` + distinct).
    """
    m = F.from_json(F.col(doc_col), "map<string,string>")
    keys = documents.select(*by, F.explode(F.map_keys(m)).alias("key")).distinct()
    agg = (keys.groupBy(*by) if by else keys).agg(F.collect_set("key").alias("seen"))
    expected = F.array(*[F.lit(k) for k in expected_keys])
    return agg.select(
        *by,
        F.array_join(F.array_sort(F.array_except("seen", expected)), ",").alias("new_columns"),
        F.array_join(F.array_sort(F.array_except(expected, "seen")), ",").alias("missing_columns"),
    )


def quality_report(production: DataFrame, reference: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sample size, averages of the rounded ratios, quality score per group."""
    keys = list(by)
    miss = missing_ratios(production, keys)
    outl = iqr_outliers(production, reference, keys)
    m = miss.groupBy(*keys).agg(F.avg("missing_ratio").alias("avg_missing"))
    o = outl.groupBy(*keys).agg(F.avg("outlier_ratio").alias("avg_outlier"))
    n = production.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_size"))
    j = null_safe_join(null_safe_join(n, m, keys, "left"), o, keys, "left")
    am = F.coalesce("avg_missing", F.lit(0.0))
    ao = F.coalesce("avg_outlier", F.lit(0.0))
    return j.select(
        *by, F.col("sample_size").cast("bigint").alias("sample_size"),
        F.round(am, 6).alias("avg_missing"), F.round(ao, 6).alias("avg_outlier"),
        F.round(1.0 - F.least(F.lit(1.0), am * 10 + ao * 5), 4).alias("quality_score"),
    )
