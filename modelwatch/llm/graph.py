"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star, then one small-star round over edges (a > b)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    return (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges`` (a, b: long); root is the smallest node.

    Any number of links takes rounds over all executors: each is a few joins on small rows, is written to the shared folder and at
    least halves the depth of the trees; only two aggregates reach the driver. Self-links, repeated links and nulls are
    ignored; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "edges")
    seen = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if sums == seen or not sums["n"]:
            break
        seen = sums
        now = stored(_stars(now), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
