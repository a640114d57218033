"""The registered queries of the document operators, with their production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm import (bpe, brown, decontaminate, kneser, langid, lexical, licenses, merkle, pii, quality_rules, repeats, simhash,
                            token_counts)
from modelwatch.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """A vocabulary file; MODELWATCH_TOKENIZERS names the folder, else the installed package does."""
    if folder := os.environ.get("MODELWATCH_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, distance=3)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


ORACLE["op2_decontamination"] = decontaminate.SQL


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), limit=2048)


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(documents(spark, sf_dir), length=200, keep_first=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


ORACLE["op5_licenses"] = licenses.sql()


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out())
    rows = langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), keep=["doc_id", "lang"])


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs), keep=["doc_id"]).drop("redacted")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = quality_rules.fit(docs, documents(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, trees, keep=["doc_id"])


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.check(documents(spark, sf_dir))
    siblings = F.array_join(F.transform("path", lambda s: s["siblings"]), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
                       "folded_root", "verified")


ORACLE["op11_merkle"] = merkle.sql()


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), k=20)


ORACLE["op12_lexical"] = lexical.SQL


@query
def op13_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = brown.fit(docs, F.col("doc_id").isNotNull() & ~brown.held_out())
    return brown.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": brown.held_out()})
