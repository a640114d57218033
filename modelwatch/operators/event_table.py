"""The stored event table: each request once however late it is delivered again (I7), erasure of few subjects at scale.

Rows lie under ``bucket`` (a hash of the subject key; of the request id where there is none) and ``part`` (the write that brought
them). A write compares request ids with the buckets it touches and with no others, and an erasure rewrites only those (bucket, part)
folders that hold rows to erase. Both may be repeated: a part replaces itself, and tombstones keep a later delivery of an erased
subject's events out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.functions.hashing import subject_key
from modelwatch.operators.common import broadcast_stored, stored
from modelwatch.sources.tables import read_if_present


@dataclass(frozen=True)
class EventTable:
    """A table of redacted events (request_id, created_at, subject_key, ...) at ``path`` in ``buckets`` buckets.

    A repeated request id is the same request of the same subject. Events without a request id are not taken.
    """

    path: str
    buckets: int = 256

    @property
    def _events(self) -> str:
        return f"{self.path}/events_by_{self.buckets}"

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        return read_if_present(spark, self._events)

    def _write(self, rows: DataFrame) -> None:
        """Replace the (bucket, part) folders that ``rows`` belong to; a large bucket is written by several tasks."""
        (rows.hint("rebalance", "bucket", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "part").parquet(self._events))

    def _touched(self, rows: DataFrame) -> Column:
        """Whether a stored row lies in a bucket of ``rows`` (a list of ``buckets`` numbers at most): prunes the scan."""
        return F.col("bucket").isin([r["bucket"] for r in rows.select("bucket").distinct().collect()])

    def add(self, events: DataFrame, part: str) -> None:
        """Add the events that are not stored yet, under a part of their own.

        Of several deliveries in ``events`` the earliest counts. A part written again is replaced. Events up to the erasure of their
        subject stay out; later ones are taken.
        """
        spark = events.sparkSession
        others = [c for c in events.columns if c != "request_id"]
        rows = (events.where(F.col("request_id").isNotNull()).groupBy("request_id")
                .agg(F.min_by(F.struct(*others), F.struct("created_at", "subject_key")).alias("_row"))
                .select("request_id", *[F.col(f"_row.{c}").alias(c) for c in others]))
        rows = stored(rows.withColumn("bucket", self._bucket(F.coalesce("subject_key", "request_id")))
                      .withColumn("part", F.lit(f"part-{part}")), "event_part")
        known, erased = self._stored(spark), read_if_present(spark, f"{self.path}/erased")
        new = rows
        if known is not None:
            ids = known.where(self._touched(rows) & (F.col("part") != f"part-{part}")).select("request_id")
            new = new.join(ids, "request_id", "left_anti")
        if erased is not None:
            new = new.join(erased, (F.col("subject_key") == F.col("erased_key")) & (F.col("created_at") <= F.col("erased_at")), "left_anti")
        self._write(new)

    def read(self, spark: SparkSession) -> DataFrame:
        """Every event once."""
        return spark.read.parquet(self._events).where(F.col("request_id").isNotNull()).drop("bucket", "part")

    def read_subject(self, spark: SparkSession, key: str) -> DataFrame:
        """The events of one subject key, from its bucket alone."""
        rows = spark.read.parquet(self._events).where((F.col("bucket") == self._bucket(F.lit(key))) & (F.col("subject_key") == key))
        return rows.drop("bucket", "part")

    def erase(self, subjects: DataFrame, salt: str, run: str, erased_at: Column, id_col: str = "subject_id") -> DataFrame:
        """Erase the subjects' events created up to ``erased_at`` (a constant); returns (id, subject_key, erased) per requested id.

        Tombstones come first, so no write in between brings a row back; then the counts are stored, then the folders that hold such
        rows are rewritten. A repeated run returns the counts of its first time. Blank ids erase nothing.
        """
        spark = subjects.sparkSession
        keys = stored(subjects.select(id_col, subject_key(id_col, salt).alias("erased_key"), erased_at.alias("erased_at")).distinct(), "erase_ids")
        stones = keys.where(F.col("erased_key").isNotNull()).select("erased_key", "erased_at").distinct()
        stones.write.mode("overwrite").parquet(f"{self.path}/erased/run={run}")
        report = f"{self.path}/reports/run={run}"
        known = self._stored(spark)
        if known is None:
            return keys.select(id_col, F.col("erased_key").alias("subject_key"), F.lit(0).cast("bigint").alias("erased"))
        rows = known.where(self._touched(stones.select(self._bucket(F.col("erased_key")).alias("bucket"))))
        wanted = broadcast_stored(stones, 128, "erase")
        gone = (F.col("subject_key") == F.col("erased_key")) & (F.col("created_at") <= F.col("erased_at"))
        hit = stored(rows.join(wanted, gone, "left_semi").groupBy("bucket", "part", "subject_key").agg(F.count("*").alias("n")), "erased")
        if read_if_present(spark, report) is None:
            per_key = hit.groupBy("subject_key").agg(F.sum("n").alias("erased"))
            (keys.withColumnRenamed("erased_key", "subject_key").join(per_key, "subject_key", "left")
             .select(id_col, "subject_key", F.coalesce("erased", F.lit(0)).cast("bigint").alias("erased")).write.mode("overwrite").parquet(report))
        folders = hit.select("bucket", "part").distinct()
        left = rows.join(broadcast_stored(folders, 64, "folders"), ["bucket", "part"]).join(wanted, gone, "left_anti")
        # a folder without a row would not be replaced: each keeps one of nulls, which no reader returns
        self._write(left.unionByName(folders, allowMissingColumns=True))
        return spark.read.parquet(report)
