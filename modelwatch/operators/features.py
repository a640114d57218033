"""Feature building (B1–B3): one function for training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numeric import to_number


def build_features(df: DataFrame, charge_col: str, target: str | None, drop: Sequence[str] = ()) -> DataFrame:
    """B1: text charge → double (unparseable → 0.0); drop the target and id / leakage columns
    that are present; keep the remaining columns in input order."""
    gone = {c for c in drop if c in df.columns}
    if target and target in df.columns:
        gone.add(target)
    cols = []
    for c in df.columns:
        if c in gone:
            continue
        if c == charge_col:
            cols.append(F.coalesce(to_number(F.col(f"`{c}`")), F.lit(0.0)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return df.select(*cols)


def coerced(charge_col: str):
    """B2: the per-row condition "this charge value was coerced"."""
    return to_number(F.col(f"`{charge_col}`")).isNull()


def coerced_count(df: DataFrame, charge_col: str, by: Sequence[str] = ()) -> DataFrame:
    """B2: number of coerced charge values (per group)."""
    g = df.groupBy(*by) if by else df
    return g.agg(F.count_if(coerced(charge_col)).cast("bigint").alias("coerced"))


def preclean(df: DataFrame, charge_col: str, reason_col: str | None = None, reason_fill: str = "Unknown") -> DataFrame:
    """Blank charge → NULL → number → 0.0; missing reason → ``Unknown`` (before the contract)."""
    cols = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c == charge_col:
            cols.append(F.coalesce(to_number(F.nullif(col.cast("string"), F.lit(" "))), F.lit(0.0)).alias(c))
        elif reason_col and c == reason_col:
            cols.append(F.coalesce(col, F.lit(reason_fill)).alias(c))
        else:
            cols.append(col)
    return df.select(*cols)
