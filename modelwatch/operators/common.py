"""Helpers shared by operators: stored intermediates, null-safe joins, ordered string lists."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with files that outlive lost executors, and freezes values that
    depend on the partitioning. Every call takes a fresh folder.
    """
    path = scratch_path(df.sparkSession, f"stored/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where a NULL key equals a NULL key; the key columns come out once.

    Without keys ``right`` has one row, and its columns are attached as a scalar subquery.
    """
    others = [c for c in right.columns if c not in keys]
    if not keys:
        one = right.select(F.struct(*others).alias("_one")).scalar()
        return left.withColumn("_one", one).select(*left.columns, *[F.col(f"_one.{c}").alias(c) for c in others])
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})  # keeps a broadcast hint
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    if how not in ("full", "full_outer"):
        return joined.drop(*[f"_r_{k}" for k in keys])
    rest = [c for c in left.columns if c not in keys] + others
    return joined.select(*[F.coalesce(k, f"_r_{k}").alias(k) for k in keys], *rest)


#: Bytes up to which a stored table is broadcast (its counted rows times a stated bound of a row).
BROADCAST_BYTES = 64 << 20


def broadcast_stored(df: DataFrame, row_bytes: int, name: str = "small") -> DataFrame:
    """Store ``df`` and broadcast it when its measured size is within :data:`BROADCAST_BYTES`, else leave the
    join to a shuffle. The rows come out the same either way; for per-group metadata (edges, bounds, keys), whose
    join by shuffle would move every data row to its group."""
    small = stored(df, name)
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def sorted_join(values: Column, sep: str = ",") -> Column:
    """A sorted, comma-joined text of an array column (stable across engines)."""
    return F.array_join(F.array_sort(values), sep)


def r6(c: Column | str) -> Column:
    """Report-edge rounding to 6 decimals."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
