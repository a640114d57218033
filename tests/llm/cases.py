"""Small document tables that hold the awkward cases of every operator."""

from pyspark.sql import functions as F

CLASHES = ["n_tokens", "ids", "kept", "fp", "key", "row", "root", "spans", "label", "labels", "score", "probability", "found",
           "pretoken", "code", "node", "h", "times", "grams", "perplexity", "threshold", "redacted", "quality", "item_id", "x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def table(spark, texts, ids=None, langs=None):
    """Documents with these texts; ids count from 0 and languages are en unless given."""
    n = len(texts)
    ids = range(n) if ids is None else ids
    langs = ["en"] * n if langs is None else langs
    rows = [(i, t, la, "s", None if t is None else len(t)) for i, t, la in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "word and other words, again. " * 9000
AWKWARD = ["a plain text with a few words", None, "", " \n\t ", "a plain text with a few words", "é ñ 漢字 \U0001f642 ﬁ Σσς İ",
           "x" * 70_000, LONG, LONG, "\n\n", "one", "two words", "!!! ??? ###", "1 2 3 4.5.6.7 +1 (234) 567-8901 a@b.co",
           "A Plain TEXT with a few words", "tab\tand\x0bvertical\x0c\rreturn \x00 nul \x1f unit"]


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    ids = [1, 2, 3, None, 1, 6, 7, 8, 8, 9, 10, 11, None, 13, 14, 15]
    langs = ["en", None, "en", "de"] * 4
    df = table(spark, AWKWARD, ids, langs).withColumn("source", F.lit(None).cast("string"))
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
