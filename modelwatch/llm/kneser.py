"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text, and perplexity thresholds.

Symbols are code points (``kneser_points``): counts come from all trusted documents, probabilities from joins of count tables
sharded by history, and every document gets its perplexity per character from a join of its n-grams to their costs. Texts fall
into folds, and a text is scored by the trusted documents of the other folds, so trusted and unseen documents are on one scale.
A document is rejected above a high and below a low quantile of the trusted documents of its language and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.common import broadcast_if, small_batches, stored, text_key
from modelwatch.llm.kneser_points import FOLDS, UNIT, costs, fold_of, grams, probabilities

#: Upper and lower quantile of the trusted documents' cross-entropies. Nothing is added to them.
QUANTILE, LOW_QUANTILE = 0.995, 0.002
#: Trusted documents from which a group (language and length class, length class, language) has its own upper quantile: with these
#: an unseen document exceeds even the largest with 1 in 101; a lower one takes 1 / LOW_QUANTILE. Length classes go by powers of
#: two, since short texts scatter more.
LEAST_DOCS = 100
#: Broadcast limits (rows): trusted ids, thresholds by language, costs by text.
TRUSTED_ROWS, LANGUAGE_ROWS, SCORED_ROWS = 2_000_000, 100_000, 1_000_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say good quality and none says toxic (stored, one row per id; null ids are left out)."""
    return stored(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("trusted_id")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0").select("trusted_id"), "trusted")


def _band(chars: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(chars), F.lit(1)))).cast("int")


def _thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """__most and __least of the cross-entropies by (__lang, __band), exact on a grid of 0.001; '' stands for all languages and
    -1 for all lengths. __least is null where the trusted documents are too few for it."""
    lang, band = F.coalesce("lang", F.lit("")), _band("__chars")
    cells = F.array_distinct(F.array(*[F.struct(x.alias("__lang"), y.alias("__band"))
                                       for x in (lang, F.lit("")) for y in (band, F.lit(-1))]))
    binned = (scored.where(F.col("__entropy").isNotNull())
              .select(F.explode(cells).alias("cell"), F.ceil(F.col("__entropy") * 1000).alias("bin"))
              .groupBy("cell.__lang", "cell.__band", "bin").agg(F.count("*").alias("n")))
    by_cell = Window.partitionBy("__lang", "__band")
    upto = by_cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    low = F.when(F.col("upto") > F.col("all") * LOW_QUANTILE, F.col("bin"))
    rank = F.ceil(F.round((F.col("all") + 1) * quantile, 6))  # one more than there are: the document to judge
    return (binned.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(by_cell))
            .groupBy("__lang", "__band", "all")
            .agg(F.min(F.when(F.col("upto") >= F.least(rank, "all"), F.col("bin"))).alias("bin"), F.min(low).alias("low"))
            .where((F.col("all") >= LEAST_DOCS) | (F.col("__lang") == "") & (F.col("__band") == -1))
            .select("__lang", "__band", (F.col("bin") / 1000).alias("__most"),
                    F.when(F.col("all") * LOW_QUANTILE >= 1, (F.col("low") - 1) / 1000).alias("__least")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, keep: list[str] | None = None) -> DataFrame:
    """Append perplexity (per character, by the trusted texts of the folds that the text is not in), threshold and kept.

    kept: not empty, the perplexity is at most the threshold (upper quantile) and above the lower quantile. Both are those of the
    trusted documents of the same language and length class, or else of the length class, the language, or all of them:
    the first with enough documents, each for itself; everything with text is kept if no document is trusted.
    Null and empty texts have a null perplexity and are rejected. Repeated rows and null doc_ids stay rows of their own;
    columns with these names give way; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep)
            if c.lower() not in ("perplexity", "threshold", "kept")]
    ids = broadcast_if(trusted_ids(labels), TRUSTED_ROWS)
    text = F.col("text").cast("string")
    base = docs.select("doc_id", "lang", text.alias("text"), text_key(text).alias("__key"), F.length(text).alias("__chars"))
    marked = base.join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    fold = F.when(F.col("trusted_id").isNotNull(), fold_of()).otherwise(-1).alias("fold")
    counted = stored(grams(marked.select("text", fold)), "grams")
    q = [F.round(-F.log(f"p{i}") * UNIT).cast("long").alias(f"q{i}") for i in range(FOLDS)]
    logs = stored(probabilities(counted).join(counted, ["h", "s"]).select("h", "s", "times", *q), "logs")
    scores = broadcast_if(stored(costs(base, logs), "costs"), SCORED_ROWS)
    entropy = F.col("__cost") / UNIT / F.col("__chars")
    trusted = base.join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi").select("lang", "__key", "__chars")
    limits = stored(_thresholds(trusted.join(scores, "__key").withColumn("__entropy", entropy), quantile), "thresholds")
    limits = broadcast_if(limits, LANGUAGE_ROWS)
    joined = (docs.withColumn("__lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
              .withColumn("__key", text_key(text)).withColumn("__chars", F.length(text)).withColumn("__band", _band("__chars"))
              .join(scores, "__key", "left").withColumn("__entropy", entropy))
    for i, on in enumerate((["__lang", "__band"], ["__band"], ["__lang"])):
        few = limits if i == 0 else limits.where(F.col("__lang") == "") if i == 1 else limits.where(F.col("__band") == -1)
        joined = joined.join(few.select(*on, F.col("__most").alias(f"__most{i}"), F.col("__least").alias(f"__least{i}")), on, "left")
    overall = limits.where("__lang = '' and __band = -1").first()
    most = F.coalesce("__most0", "__most1", "__most2", F.lit(overall["__most"] if overall else float("inf")))
    least = F.coalesce("__least0", "__least1", "__least2", F.lit(overall["__least"] if overall else None).cast("double"), F.lit(-1.0))
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.exp("__entropy").alias("perplexity"), F.exp(most).alias("threshold"),
                         F.coalesce((F.col("__entropy") <= most) & (F.col("__entropy") > least), F.lit(False)).alias("kept"))
