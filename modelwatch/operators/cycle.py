"""L5, the cycle that acts: verdict, retraining table, training, gate, promotion, rollback.

Each step's result is one row under ``cycle_log/cycle=…/step=…`` of the job root; a step that is there is not done again,
so a cycle that was cut off goes on where it stopped, and a replay changes nothing. What serves is the last row of
``registry``, to which promotions and rollbacks are appended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators import drift, features, jobs, lifecycle, retraining
from modelwatch.params import DEFAULTS
from modelwatch.sources.tables import read_if_present, read_or_empty, reference_and_production, write_snapshot

REGISTRY = "model_name string, model_version string, ts timestamp, seq bigint, action string, cycle string"


@dataclass(frozen=True)
class Steps:
    """The log of one cycle."""

    spark: SparkSession
    root: str
    cycle: str

    def once(self, name: str, make: Callable[[], DataFrame]) -> Row:
        """The step's one row: stored, or made and stored now."""
        path = f"{self.root}/cycle_log/cycle={self.cycle}/step={name}"
        done = read_if_present(self.spark, path)
        row = None if done is None else done.first()
        if row is None:
            make().write.mode("overwrite").parquet(path)
            row = self.spark.read.parquet(path).first()
        return row

    def note(self, name: str, **values) -> Row:
        one = self.spark.range(1)
        return self.once(name, lambda: one.select(*[F.lit(v).alias(c) for c, v in values.items()]))


def registry(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/registry", spark.createDataFrame([], REGISTRY).schema)


def _append(spark: SparkSession, root: str, cycle: str, action: str, name: str, version: str, now: str) -> None:
    """A registry row under its own cycle and action: written again, it replaces itself."""
    others = registry(spark, root).where((F.col("model_name") == name) & (F.col("cycle") != cycle))
    seq = (others.agg(F.max("seq")).first()[0] or 0) + 1
    row = spark.range(1).select(F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), F.lit(now).cast("timestamp").alias("ts"),
                                F.lit(seq).cast("bigint").alias("seq"), F.lit(action).alias("action"))
    write_snapshot(row, f"{root}/registry", cycle, key="cycle")


def run_cycle(spark: SparkSession, root: str, spec: jobs.TrainingSpec, cycle: str, now: str, raw_path: str, events: DataFrame,
              labels: DataFrame, which: Sequence[str] | None = None, min_improvement: float = DEFAULTS.min_improvement,
              seed: int = DEFAULTS.seed) -> dict[str, bool]:
    """One lifecycle cycle over a job root that holds a trained model: what happened, as retrained / promoted / rolled_back.

    ``events``: production rows with the training columns and ``request_id``; ``labels``: (request_id, label, labeled_at).
    Healthy or unknown: only the rollback check. Else the retraining table is extended, candidates are trained as version ``cycle``,
    the winner meets the serving model at the gate, and is promoted, or a rollback is checked; never both.
    """
    steps = Steps(spark, root, cycle)
    name = spec.model_name
    experiments = spark.read.parquet(f"{root}/experiments")
    lineage = read_or_empty(spark, f"{root}/lineage", lifecycle.LINEAGE_SCHEMA).where(F.col("model_name") == name)

    def start() -> DataFrame:
        serving = registry(spark, root).where(F.col("model_name") == name).agg(F.max_by("model_version", "seq").alias("serving"))
        last = lineage.agg(F.max_by("model_version", F.struct("ts", "seq")).alias("last"))
        return serving.crossJoin(last).select("serving", F.coalesce("serving", "last").alias("baseline"))  # one row each

    begin = steps.once("start", start)
    trained_as = experiments.where(F.col("model_version") == begin["baseline"]).select("run").first()
    reference, production, status = reference_and_production(
        spark, f"{root}/reference/model_version={trained_as['run'] if trained_as else ''}", events)

    def verdict() -> DataFrame:
        if status == "unknown":
            return spark.range(1).select(F.lit("unknown").alias("status"), F.lit(0).cast("bigint").alias("drifting_feature_count"),
                                         F.lit(False).alias("retraining_recommended"))
        present = features.preclean(production, spec.charges).select(*spec.numeric)
        report = drift.drift_report_wide(reference.select(*spec.numeric), present, list(spec.numeric))
        return drift.model_health(report).select("status", "drifting_feature_count", "retraining_recommended")

    health = steps.once("verdict", verdict)
    promoted = False
    if health["retraining_recommended"]:
        table = f"{root}/retraining"
        steps.once("retraining", lambda: retraining.extend(spark, table, spark.read.parquet(raw_path), events, labels, spec.target, cycle)
                   .agg(F.count(F.lit(1)).alias("rows_added")))

        def train() -> DataFrame:
            board = jobs.training_run(spark, root, spec, cycle, now, raw_path, table, seed=seed, which=which, record_lineage=False)
            return board.where("is_winner").select(F.concat(F.lit(f"{cycle}_"), "candidate").alias("challenger"), "pr_auc", F.lit(table).alias("source"))

        challenger = steps.once("train", train)

        def gate() -> DataFrame:
            rows = spark.read.parquet(f"{root}/experiments").select("model_name", "model_version", "metrics", "feature_schema")
            families = spark.range(1).select(F.lit(name).alias("model_name"))
            decided = lifecycle.promotion_gate(families, rows.where(F.col("model_version") == challenger["challenger"]),
                                               rows.where(F.col("model_version") == F.lit(begin["serving"])), min_improvement=min_improvement)
            check = lifecycle.promotion_check(decided)
            return check.join(decided.select("model_name", "reason", "improvement"), "model_name")

        decision = steps.once("gate", gate)
        promoted = bool(decision["promoted"])
        if promoted:
            def promote() -> DataFrame:
                row = spark.read.parquet(f"{root}/cycle_log/cycle={cycle}/step=gate")
                others = spark.read.parquet(f"{root}/lineage").where(F.col("run") != cycle)
                write_snapshot(lifecycle.lineage_record(row, others, F.lit(now).cast("timestamp"), F.lit(challenger["source"])),
                               f"{root}/lineage", cycle, key="run")
                _append(spark, root, cycle, "promote", name, challenger["challenger"], now)
                return spark.range(1).select(F.lit(challenger["challenger"]).alias("model_version"))

            steps.once("promote", promote)
    rolled_back = False
    if not promoted:
        def rollback() -> DataFrame:
            row = spark.range(1).select(F.lit(name).alias("model_name"), F.lit(health["retraining_recommended"]).alias("retraining_recommended"))
            bundles = spark.read.parquet(f"{root}/experiments").where("is_winner").select("model_name", "model_version")
            return lifecycle.rollback_target(row, lineage, bundles)

        target = steps.once("rollback", rollback)
        rolled_back = bool(target["rolled_back"])
        if rolled_back:
            def restore() -> DataFrame:
                _append(spark, root, cycle, "rollback", name, target["previous_version"], now)
                return spark.range(1).select(F.lit(target["previous_version"]).alias("model_version"))

            steps.once("restore", restore)
    done = steps.note("outcome", retrained=bool(health["retraining_recommended"]), promoted=promoted, rolled_back=rolled_back)
    return done.asDict()
