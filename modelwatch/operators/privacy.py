"""Privacy (B11, B12, C3): redaction, pseudonymous subject keys, erasure by anti-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.hashing import subject_key
from modelwatch.operators.common import broadcast_stored

# The keys stripped from stored feature documents.
SENSITIVE_KEYS = ("CustomerID", "Country", "State", "City", "Zip Code", "Lat Long", "Latitude", "Longitude")


def redact_document(df: DataFrame, doc: str, keys: Sequence[str] = SENSITIVE_KEYS) -> DataFrame:
    """B11 on a map column: drop the sensitive keys."""
    arr = F.array(*[F.lit(k) for k in keys])
    return df.withColumn(doc, F.map_filter(doc, lambda k, v: ~F.array_contains(arr, k)))


def with_subject_key(df: DataFrame, subject_col: str, salt: str, out: str = "subject_key") -> DataFrame:
    """Replace the raw subject id by its keyed hash (NULL / blank → NULL). The caller keeps the salt secret."""
    return df.withColumn(out, subject_key(subject_col, salt)).drop(subject_col)


def erase_subjects(events: DataFrame, erase_ids: DataFrame, salt: str, id_col: str = "subject_id",
                   key_col: str = "subject_key") -> tuple[DataFrame, DataFrame]:
    """(remaining events, erased-row counts per requested id).

    The erase list can be of any size: it is hashed, de-duplicated and applied by
    ``left_anti`` join.
    Blank ids hash to NULL and erase nothing. Outbox rows are not touched. Above the
    broadcast bound the joins fall back to shuffles (AQE splits a skewed key).
    """
    keys = erase_ids.select(id_col, subject_key(id_col, salt).alias(key_col))
    # a subject may own a large share of the events: with the (size-checked) key list
    # broadcast, the anti / semi joins need no shuffle of the event table at all
    wanted = broadcast_stored(keys.where(F.col(key_col).isNotNull()).select(key_col).distinct(), 128, "erase")
    remaining = events.join(wanted, key_col, "left_anti")
    per_key = events.join(wanted, key_col, "left_semi").groupBy(key_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("erased"))
    report = keys.join(per_key, key_col, "left").select(
        id_col, key_col, F.coalesce("erased", F.lit(0)).cast("bigint").alias("erased"))
    return remaining, report
