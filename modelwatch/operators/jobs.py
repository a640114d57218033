"""Training and scoring jobs over stored tables.

A job root holds ``quarantine``, ``reference``, ``experiments``, ``lineage``, ``models`` and ``scores``. Everything
of a run stands under its version, so a rerun replaces its own output.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators import contracts, evaluate, events, features, lifecycle, train
from modelwatch.operators.common import stored
from modelwatch.operators.ordered import temporal_split
from modelwatch.sources.tables import read_if_present, read_training_table, write_snapshot

WINNER_TRIGGER = "training"


@dataclass(frozen=True)
class TrainingSpec:
    """What a training run needs to know of its table."""

    model_name: str
    contract: contracts.Contract
    key: str
    target: str
    order: str
    charges: str
    numeric: Sequence[str]
    categorical: Sequence[str]

    @property
    def schema(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def training_run(spark: SparkSession, root: str, spec: TrainingSpec, version: str, created_at: str, raw_path: str,
                 retraining_path: str | None = None, seed: int = 42, which: Sequence[str] | None = None,
                 record_lineage: bool = True) -> DataFrame:
    """Read, check, split, fit, rank, store: returns the leaderboard (one row per candidate).

    Rows that break the contract go to ``quarantine`` and are not trained on. The winner's pipeline is saved with the
    features it was fitted on as reference; the leaderboard becomes experiment rows and the winner a lineage row (a cycle
    writes that itself once it promotes). ``which`` names the candidates (default: all).
    """
    raw, source = read_training_table(spark, raw_path, retraining_path)
    contracts.require_columns(raw, [n for n, c in spec.contract.columns.items() if c.required])
    # stored: the quarantine and the passes of the split read the checked rows, not the training table again
    checked = stored(contracts.checked(features.preclean(raw, spec.charges), spec.contract), "checked")
    good, bad = contracts.split_checked(checked, spec.contract)
    write_snapshot(bad.select(spec.key, F.explode("_violations").alias("v")).select(spec.key, "v.*"),
                   f"{root}/quarantine", version)
    write_snapshot(temporal_split(good, spec.order, spec.key).select(spec.key, *spec.schema, spec.target, "split"),
                   f"{root}/prepared", version)
    data = spark.read.parquet(f"{root}/prepared/model_version={version}")
    fit_on, test = data.where("split = 'train'"), data.where("split = 'test'")
    models = train.train_candidates(fit_on, spec.numeric, spec.categorical, spec.target, which, seed=seed)
    scored = None
    for name, model in models.items():
        part = train.score(model, test, keep=[spec.key, spec.target]).withColumn("candidate", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    scored = stored(scored, "test-scores")  # each model scores the test rows once, for all metrics
    board = evaluate.leaderboard(evaluate.evaluate_candidates(scored, "candidate", label=spec.target), "candidate")
    rows = lifecycle.experiment_rows(board, F.lit(spec.model_name), F.lit(version), spec.schema)
    write_snapshot(board, f"{root}/leaderboard", version)
    board = spark.read.parquet(f"{root}/leaderboard/model_version={version}")
    write_snapshot(rows, f"{root}/experiments", version, key="run")
    winner = board.where("is_winner").first()  # one row
    models[winner["candidate"]].write().overwrite().save(f"{root}/models/{version}")
    write_snapshot(fit_on.select(*spec.schema), f"{root}/reference", version)
    if not record_lineage:
        return board
    metrics = F.create_map(F.lit("roc_auc"), F.col("roc_auc"), F.lit("pr_auc"), F.col("pr_auc"))
    gate = board.where("is_winner").select(
        F.lit(spec.model_name).alias("model_name"), F.concat(F.lit(f"{version}_"), "candidate").alias("challenger_version"),
        F.lit(None).cast("string").alias("parent_model"), F.lit(True).alias("promoted"), metrics.alias("ch_metrics"))
    earlier = read_if_present(spark, f"{root}/lineage")
    known = spark.createDataFrame([], lifecycle.LINEAGE_SCHEMA) if earlier is None else earlier.where(F.col("run") != version)
    record = lifecycle.lineage_record(gate, known, F.lit(created_at).cast("timestamp"), F.lit(source), WINNER_TRIGGER)
    write_snapshot(record, f"{root}/lineage", version, key="run")
    return board


def scoring_run(spark: SparkSession, root: str, spec: TrainingSpec, version: str, rows: DataFrame) -> DataFrame:
    """Score a table with the stored model (nothing is fitted), number it in key order (G7), store it."""
    model = PipelineModel.load(f"{root}/models/{version}")
    checked = contracts.scoring_contract(rows, [spec.key, *spec.schema], spec.target)
    scored = train.score(model, checked, keep=[spec.key]).withColumn("raw_probability", F.col("probability"))
    numbered = events.number_batch(scored, [spec.key])
    write_snapshot(numbered, f"{root}/scores", version)
    return spark.read.parquet(f"{root}/scores/model_version={version}")
