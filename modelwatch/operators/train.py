"""Training and scoring (T1–T5, S1–S3) with Spark ML estimators; each fit is a distributed job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.operators.common import null_safe_join
from modelwatch.params import DEFAULTS

#: Rows of one partition of the frame that the iterative fits scan.
FIT_PARTITION_ROWS = 100_000


def preprocessor(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Scale numerics (mean / std), one-hot text columns; an unseen category is all zeros.

    ``handleInvalid="keep"`` gives unseen values the last index, and ``dropLast``
    drops exactly that slot, so every known value keeps a slot.
    """
    stages: list = []
    cat_vecs = []
    for c in categorical:
        idx, vec = f"{c}__idx", f"{c}__ohe"
        stages.append(StringIndexer(inputCol=c, outputCol=idx, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=idx, outputCol=vec, dropLast=True))
        cat_vecs.append(vec)
    parts = []
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="__num", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="__num", outputCol="__num_scaled", withMean=True, withStd=True))
        parts.append("__num_scaled")
    stages.append(VectorAssembler(inputCols=parts + cat_vecs, outputCol="features"))
    return stages


def class_weights(df: DataFrame, label: str, weight_col: str = "class_weight") -> DataFrame:
    """Balanced weights ``n / (2 · n_class)`` of a 0/1 label: two counts, attached as a scalar subquery."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("_n1"), F.count_if(F.col(label) != 1).alias("_n0"))
    own = F.when(F.col(label) == 1, F.col("_n1")).otherwise(F.col("_n0"))
    return null_safe_join(df, counts, []).withColumn(
        weight_col, (F.col("_n1") + F.col("_n0")) / (F.lit(2.0) * own)).drop("_n1", "_n0")


def candidates(label: str, seed: int = DEFAULTS.seed, weight_col: str = "class_weight",
               n_rows: int | None = None) -> dict:
    """The three candidate estimators with the reference's settings."""
    return {
        "logistic_regression": LogisticRegression(
            featuresCol="features", labelCol=label, weightCol=weight_col, maxIter=1000,
            regParam=(1.0 / n_rows) if n_rows else 0.0, standardization=False),
        "random_forest": RandomForestClassifier(
            featuresCol="features", labelCol=label, numTrees=150, maxDepth=8,
            featureSubsetStrategy="sqrt", seed=seed),
        "gradient_boosting": GBTClassifier(
            featuresCol="features", labelCol=label, maxIter=120, stepSize=0.08, maxDepth=3, seed=seed),
    }


def fit_partitions(rows: int, slots: int) -> int:
    """About :data:`FIT_PARTITION_ROWS` rows a partition; whole waves over the cluster's slots once they fill half of one."""
    parts = max(1, -(-rows // FIT_PARTITION_ROWS))
    return parts if 2 * parts < slots else -(-parts // slots) * slots


def train_candidates(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
                     which: Sequence[str] | None = None, seed: int = DEFAULTS.seed) -> dict[str, PipelineModel]:
    """T5: fit every candidate on the same prepared frame; one failure fails the run.

    The preprocessing is fitted once and shared by the candidates' pipelines. Iterative estimators scan the
    assembled frame once per round, so it is cached, in partitions of about :data:`FIT_PARTITION_ROWS` rows. The
    candidates are fitted at the same time: a round of one that does not fill the cluster leaves room for another's.
    """
    spark = train.sparkSession
    rows = class_weights(train.withColumn(label, F.col(label).cast("double")), label)
    prep = Pipeline(stages=preprocessor(numeric, categorical)).fit(rows)
    n = train.count()
    prepared = (prep.transform(rows).select("features", label, "class_weight")
                .repartition(fit_partitions(n, spark.sparkContext.defaultParallelism)).persist())
    chosen = {name: est for name, est in candidates(label, seed, n_rows=n).items() if not which or name in which}
    try:
        prepared.count()  # cached once, before the fits read it side by side
        with ThreadPoolExecutor(max(1, len(chosen))) as pool:
            fits = {name: pool.submit(inheritable_thread_target(spark)(est.fit), prepared) for name, est in chosen.items()}
            return {name: PipelineModel(prep.stages + [fit.result()]) for name, fit in fits.items()}
    finally:
        prepared.unpersist()


def score(model: PipelineModel, df: DataFrame, threshold: float = DEFAULTS.threshold,
          keep: Sequence[str] = ()) -> DataFrame:
    """Probability of the positive class and the inclusive threshold decision."""
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.select(*keep, p.alias("probability"), (p >= threshold).cast("int").alias("prediction"))


def linear_score(df: DataFrame, coefficients: Mapping[str, float], intercept: float, key: str) -> DataFrame:
    """S3: ``σ(b0 + Σ β·x)`` within each row; a missing value adds nothing."""
    z = F.lit(float(intercept))
    for f, beta in coefficients.items():
        z = z + F.coalesce(F.lit(beta) * F.col(f).cast("double"), F.lit(0.0))
    return df.select(key, z.alias("logit")).withColumn("probability", 1.0 / (1.0 + F.exp(-F.col("logit"))))
