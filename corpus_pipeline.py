"""Corpus pipeline: raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept. All but the last return the columns of
``documents``; the last returns the tokens. ``run`` writes every stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm import bpe, decontaminate, kneser, pii, simhash
from modelwatch.llm.common import documents, stored
from modelwatch.llm.queries import tokenizer_path

_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _guarded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stage with further columns under names that no operator uses, and give their names back."""
    names = {c: c if c in _OWN else f"extra_{hashlib.md5(c.encode()).hexdigest()}" for c in docs.columns}
    out = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return _guarded(docs, lambda d: kneser.classify(d, documents(spark, sf_dir, "labels")).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group."""
    return _guarded(docs, lambda d: simhash.one_of_each(d, shingle=3, distance=3))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return _guarded(docs, lambda d: decontaminate.clean(d, documents(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows."""
    return _guarded(docs, lambda d: pii.find(d, pii.fit(d)).withColumn("text", F.col("redacted"))
                    .withColumn("n_chars", F.length("redacted").cast(docs.schema["n_chars"].dataType)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("byte_bpe_50k.json"),
                      keep=["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("decontamination", decontamination),
          ("pii", personal_data), ("bpe", tokens)]

#: Fitted models decide in two of the stages, so no SQL gives the same rows; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
