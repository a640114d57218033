"""Outbox leases as pure table functions (I3–I5): ``(outbox, now) → (claimed, new outbox)``.

The reference mutates rows under a lease; here each step returns a new snapshot,
so a retried step recomputes the same result. In streaming form the checkpoint
replaces the lease (see ``streaming.delivery``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.params import DEFAULTS


def claimable(outbox: DataFrame, now: Column, lease_seconds: int = DEFAULTS.lease_seconds,
              max_attempts: int = DEFAULTS.max_attempts) -> DataFrame:
    """Unprocessed, attempts below the maximum, unclaimed or with an expired lease."""
    cutoff = now - F.make_interval(secs=F.lit(lease_seconds))
    return outbox.where(
        F.col("processed_at").isNull() & (F.col("attempts") < max_attempts)
        & (F.col("claimed_at").isNull() | (F.col("claimed_at") < cutoff)))


def claim_batch(outbox: DataFrame, now: Column, limit: int = DEFAULTS.claim_batch,
                lease_seconds: int = DEFAULTS.lease_seconds,
                max_attempts: int = DEFAULTS.max_attempts) -> tuple[DataFrame, DataFrame]:
    """The oldest ``limit`` claimable rows get the lease and attempts + 1.

    Returns ``(claimed, new_outbox)``; the batch limit is the feature (a top-k by age).
    """
    claimed = (claimable(outbox, now, lease_seconds, max_attempts)
               .orderBy(F.col("created_at").asc(), F.col("id").asc()).limit(limit)
               .select("id", F.lit(True).alias("_claimed")))
    j = outbox.join(claimed, "id", "left")
    won = F.coalesce("_claimed", F.lit(False))
    new = j.select(
        *[c for c in outbox.columns if c not in ("claimed_at", "attempts")],
        F.when(won, now).otherwise(F.col("claimed_at")).alias("claimed_at"),
        F.when(won, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
    ).select(*outbox.columns)
    rows = new.join(claimed.select("id"), "id", "left_semi")
    return rows, new


def settle(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """I4: ``results(id, ok)``: success → processed at ``now``; failure → lease released."""
    j = outbox.join(results.select("id", F.col("ok").alias("_ok")), "id", "left")
    return j.select(
        *[c for c in outbox.columns if c not in ("processed_at", "claimed_at")],
        F.when(F.col("_ok") == True, now).otherwise(F.col("processed_at")).alias("processed_at"),  # noqa: E712
        F.when(F.col("_ok") == False, F.lit(None)).otherwise(F.col("claimed_at")).alias("claimed_at"),  # noqa: E712
    ).select(*outbox.columns)


def dead_letters(outbox: DataFrame, max_attempts: int = DEFAULTS.max_attempts) -> DataFrame:
    """Rows never to be claimed again (unprocessed with attempts exhausted)."""
    return outbox.where(F.col("processed_at").isNull() & (F.col("attempts") >= max_attempts))


def backlog(outbox: DataFrame, now: Column, lease_seconds: int = DEFAULTS.lease_seconds,
            max_attempts: int = DEFAULTS.max_attempts) -> DataFrame:
    """Outbox state per event type: processed, claimable, leased, exhausted."""
    cutoff = now - F.make_interval(secs=F.lit(lease_seconds))
    state = (F.when(F.col("processed_at").isNotNull(), "processed")
             .when(F.col("attempts") >= max_attempts, "exhausted")
             .when(F.col("claimed_at").isNotNull() & (F.col("claimed_at") >= cutoff), "leased")
             .otherwise("claimable"))
    return outbox.groupBy("event_type", state.alias("state")).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
