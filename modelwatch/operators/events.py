"""Prediction events: labels, feedback outcomes, reads, retraining union, numbering.

Mutable updates of the reference (label overwrite, delete) are expressed as
append-only inputs plus latest-wins joins, producing a new snapshot each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.operators.common import stored
from modelwatch.params import DEFAULTS


def latest_labels(labels: DataFrame, key: str = "request_id", label: str = "label", ts: str = "labeled_at") -> DataFrame:
    """One label per key: the latest by ``ts`` (ties: the larger label). Valid labels only."""
    valid = labels.where(F.col(label).isin(0, 1))
    return valid.groupBy(key).agg(
        F.max_by(F.struct(F.col(label).alias("label"), F.col(ts).alias("labeled_at")),
                 F.struct(F.col(ts), F.col(label))).alias("l")
    ).select(key, F.col("l.label").alias("label"), F.col("l.labeled_at").alias("labeled_at"))


def rejected_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Label rows outside {0, 1} (NULL included)."""
    return labels.where(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))


def attach_labels(events: DataFrame, labels: DataFrame, key: str = "request_id") -> DataFrame:
    """Every event with the key gets the latest label and its time; others keep NULL."""
    lab = latest_labels(labels, key)
    ev = events.drop("label", "labeled_at")
    return ev.join(lab, key, "left")


def feedback_outcome(labels: DataFrame, events: DataFrame, key: str = "request_id") -> DataFrame:
    """Label submissions by outcome: ``recorded`` (an event matched), ``unknown``, ``invalid``."""
    ev_keys = events.select(key).distinct()
    tagged = labels.join(ev_keys.withColumn("_hit", F.lit(True)), key, "left")
    outcome = (F.when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "invalid")
               .when(F.col("_hit"), "recorded").otherwise("unknown"))
    return tagged.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).cast("bigint").alias("submissions"))


def labelled_events(events: DataFrame, order: str = "created_at", limit: int | None = None) -> DataFrame:
    """Events with a label, oldest first, optionally the first ``limit``."""
    out = events.where(F.col("label").isNotNull()).orderBy(F.col(order).asc(), F.col("request_id").asc())
    return out.limit(limit) if limit is not None else out


def flatten_events(events: DataFrame, keys: Sequence[str], doc: str = "features") -> DataFrame:
    """A5: the features map as columns; event fields overwrite same-named features.

    ``keys`` is the key set of the document (``document_keys`` finds it in one pass).
    Renames ``created_at → timestamp`` and ``probability → prediction_probability``.
    """
    fields = {
        "request_id": F.col("request_id"),
        "timestamp": F.col("created_at"),
        "prediction_probability": F.col("probability"),
        "prediction": F.col("prediction"),
        "latency_seconds": F.col("latency_seconds"),
        "model_version": F.col("model_version"),
    }
    feats = [F.col(doc)[k].alias(k) for k in keys if k not in fields]
    return events.select(*feats, *[c.alias(n) for n, c in fields.items()])


def document_keys(events: DataFrame, doc: str = "features", max_keys: int = 10_000) -> list[str]:
    """Sorted distinct keys of a map column (metadata only comes to the driver).

    The key set becomes columns, so it must be schema-sized: more than ``max_keys``
    distinct keys is an error rather than an unbounded collect.
    """
    rows = (events.select(F.explode(F.map_keys(doc)).alias("k")).distinct().orderBy("k")
            .limit(max_keys + 1).collect())
    if len(rows) > max_keys:
        raise ValueError(f"{doc} has more than {max_keys} distinct keys; flatten a chosen key list instead")
    return [r["k"] for r in rows]


def recent_events(events: DataFrame, limit: int, order: str = "created_at") -> DataFrame:
    """A5: the newest ``limit`` events (top-k is the feature), returned oldest first."""
    newest = events.orderBy(F.col(order).desc(), F.col("request_id").desc()).limit(limit)
    return newest.orderBy(F.col(order).asc(), F.col("request_id").asc())


def decide(prob: str = "probability", threshold: float = DEFAULTS.threshold):
    """``p >= threshold`` → 1 else 0 (inclusive)."""
    return (F.col(prob) >= threshold).cast("int")


def retraining_union(base: DataFrame, production: DataFrame, target: str) -> DataFrame:
    """H1: base rows + labelled production rows; shared columns only, base order, duplicates kept.

    ``production`` must carry ``target`` (the attached label). Base-only columns are NULL
    in production rows. With no labelled rows the result is the base table.
    """
    shared = [c for c in base.columns if c in production.columns]
    prod = production.where(F.col(target).isNotNull()).select(*shared)
    return base.unionByName(prod, allowMissingColumns=True).select(*base.columns)


def number_batch(df: DataFrame, order: Sequence[str], batch_seconds: float | None = None,
                 prob: str = "probability") -> DataFrame:
    """``index`` in a total order, ``request_id = batch-<index>``, p at 4 decimals, latency share.

    The sorted table is stored with its row numbers; each row's index is its partition's
    offset (a cumulative sum over one row per partition) plus its position inside the partition.
    """
    from pyspark.sql import Window

    srt = stored(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_mid", 33)
    sizes = srt.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # offsets has one row per partition of the sorted table: bounded by the partition count
    idx = srt.withColumn("_p", part).join(F.broadcast(offsets), "_p", "inner")
    index = (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint")
    rest = [c for c in df.columns if c not in (prob, "request_id")]
    out = idx.select(index.alias("index"),
                     F.concat(F.lit("batch-"), index.cast("string")).alias("request_id"),
                     F.round(F.col(prob), 4).alias("probability"), *rest)
    if batch_seconds is not None:
        n = srt.count()
        out = out.withColumn("latency_seconds", F.lit(batch_seconds / max(n, 1)))
    return out


def outbox_records(events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One outbox row per prediction (and per label submission): ``event_type`` + JSON payload."""
    made = events.select(
        F.col("created_at"), F.lit("prediction_made").alias("event_type"),
        F.to_json(F.struct("request_id", "model_version", "probability", "prediction")).alias("payload"))
    if labels is None:
        return made
    lab = labels.select(
        F.col("labeled_at").alias("created_at"), F.lit("prediction_labeled").alias("event_type"),
        F.to_json(F.struct("request_id", "label")).alias("payload"))
    return made.unionByName(lab)
