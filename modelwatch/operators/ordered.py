"""Order-sensitive sums at scale (§4.3): prefix sums, quantiles, tenure split, Gini, ranks.

A window ordered over a whole table runs in one task. Instead:

1. collapse ties (``groupBy(order value)``), so that no value is hot,
2. range-partition the rest by (group, order): Spark samples the bounds, so the parts are
   even however the values are distributed; the part number is stored with the row,
3. total the parts (a row per group and part) and run the cumulative window over that table,
4. finish with a window *within each part*, adding the part's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.operators.common import null_safe_join, stored


def prefix_sums(df: DataFrame, order: Sequence[str | Column], measures: Sequence[str],
                by: Sequence[str] = ()) -> DataFrame:
    """Add ``<m>_before``: the sum of ``m`` over rows strictly earlier in ``order`` within ``by``, and ``<m>_total``.

    Rows of ``df`` should already be distinct in ``by + order`` when ties must share a
    value (collapse them first). NULL keys are groups like any other, and NULL order
    values stand where ``order`` puts them; no row is lost.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = stored(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "parts")
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[x for m in measures for x in (
        F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}"),
        F.sum(f"_t_{m}").over(Window.partitionBy(*by)).alias(f"{m}_total"))])
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return null_safe_join(parts, offsets, [*by, "_part"]).select(
        *df.columns,
        *[(F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures])


def quantiles(df: DataFrame, value: str, levels: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: a column per entry of ``levels``.

    Values are counted once per (group, value), and the two order statistics around each rank are
    read off the counts' prefix sums, so no task holds the values of a group. NULL and NaN are left out.
    """
    counts = (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
              .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    at = prefix_sums(counts, ["_v"], ["_c"], by).withColumnRenamed("_c_total", "_n")

    def place(q: float) -> Column:
        return (F.col("_n") - 1) * F.lit(q)

    def value_at(i: Column) -> Column:
        return F.max(F.when((F.col("_c_before") <= i) & (i < F.col("_c_before") + F.col("_c")), F.col("_v")))

    stats = [x for name, q in levels.items() for x in (value_at(F.floor(place(q))).alias(f"_lo_{name}"),
                                                       value_at(F.ceil(place(q))).alias(f"_hi_{name}"))]
    found = at.groupBy(*by).agg(F.first("_n").alias("_n"), *stats)
    return found.select(*by, *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
                                * (place(q) - F.floor(place(q)))).alias(name) for name, q in levels.items()])


def gini_spread(df: DataFrame, prob: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    """``2·Σcumsum / (n·Σp) − (n+1)/n`` over ascending p; 0 for n = 0; NULL when Σp = 0.

    With ``c`` equal values ``x`` and ``s`` smaller values, the cumsum terms of the
    tie group add up to ``x·(c·(n − s) − c(c − 1)/2)``, so
    ``Σcumsum = n·Σ(x·c) − Σ x·(c·s + c(c − 1)/2)``: one prefix pass, no global window.
    """
    vals = df.where(F.col(prob).isNotNull() & ~F.isnan(prob)).groupBy(*by, prob).agg(F.count(F.lit(1)).alias("c"))
    ranked = prefix_sums(vals, [prob], ["c"], by)
    x, c, s = F.col(prob), F.col("c").cast("double"), F.col("c_before").cast("double")
    agg = ranked.groupBy(*by).agg(F.sum(x * c).alias("total"), F.sum(x * (c * s + c * (c - 1) / 2.0)).alias("b"),
                                  F.sum(c).alias("n"))
    n = F.col("n")
    gini = F.try_divide(2.0 * (n * F.col("total") - F.col("b")), n * F.col("total")) - (n + 1) / n
    return agg.select(*by, (gini if by else F.when(n.isNull(), 0.0).otherwise(gini)).alias("gini"))


def temporal_split(df: DataFrame, order_col: str = "tenure_months", tiebreak: str = "customer_id",
                   fraction: float = 0.8) -> DataFrame:
    """G1: first ``int(fraction·n)`` rows by ``order_col`` are ``train``, the rest ``test``.

    NULL order values sort last. Ties are broken by ``tiebreak`` (NULL last). Only rows *at* the boundary
    value need a rank; they are ranked as rows, range-partitioned by (tiebreak, hash of the row), so
    neither a hot boundary value nor a hot tiebreak value meets in one task. Every row comes out once.
    """
    last = F.col(order_col).asc_nulls_last()
    counts = df.groupBy(order_col).agg(F.count(F.lit(1)).alias("c"))
    k = F.floor(F.col("c_total") * fraction).cast("bigint")
    # the one value at which the train part ends (no row when it is empty), and how many of its rows are train
    edge = stored(prefix_sums(counts, [last], ["c"]).where((F.col("c_before") < k) & (F.col("c_before") + F.col("c") >= k))
                  .select(F.col(order_col).alias("_value"), (k - F.col("c_before")).alias("_take")), "split-edge")
    tagged = null_safe_join(df, edge, [])
    x, v = F.col(order_col), F.col("_value")
    at_edge = F.col("_take").isNotNull() & x.eqNullSafe(v)
    earlier = F.col("_take").isNotNull() & F.when(v.isNull(), x.isNotNull()).otherwise(F.coalesce(x < v, F.lit(False)))
    plain = tagged.where(~at_edge).select(*df.columns, F.when(earlier, "train").otherwise("test").alias("split"))
    rows = tagged.where(at_edge).select(*df.columns, "_take", F.lit(1).alias("_one"),
                                        F.xxhash64(*df.columns).alias("_hash"))
    placed = prefix_sums(rows, [F.col(tiebreak).asc_nulls_last(), F.col("_hash")], ["_one"])
    split = F.when(F.col("_one_before") < F.col("_take"), "train").otherwise("test")
    return plain.unionByName(placed.select(*df.columns, split.alias("split")))


def score_groups(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Collapse rows to ``(by, score) → pos, neg`` (labels 0/1; NULL labels and scores dropped)."""
    return (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
        .groupBy(*by, score)
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )


def ranking_metrics(df: DataFrame, score: str = "probability", label: str = "label",
                    by: Sequence[str] = ()) -> DataFrame:
    """T9 + T10 per group: tie-correct ROC-AUC and average precision (step sum).

    One prefix pass in *descending* score order gives, per distinct score s, the
    positives / negatives strictly above it. Then
    ROC-AUC = 1 − Σ_s pos_s·(neg_above + ½·neg_s) / (P·N)  (NULL with one class),
    AP = Σ_s (pos_s / P) · (pos_above + pos_s) / (n_above + n_s)  (NULL when P = 0).
    Products are taken in double, so that counts beyond 3·10⁹ do not overflow.
    """
    ranked = prefix_sums(score_groups(df, score, label, by), [F.col(score).desc()], ["pos", "neg"], by)
    pos, neg, pa, na = (F.col(c).cast("double") for c in ("pos", "neg", "pos_before", "neg_before"))
    agg = ranked.groupBy(*by).agg(
        F.sum(pos * (na + 0.5 * neg)).alias("auc_miss"),
        F.sum(pos * (pa + pos) / (pa + na + pos + neg)).alias("ap_num"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"),
    )
    p, n = F.col("P").cast("double"), F.col("N").cast("double")
    out = agg.select(
        *by,
        F.when((p > 0) & (n > 0), 1.0 - F.col("auc_miss") / (p * n)).alias("roc_auc"),
        F.when(p > 0, F.col("ap_num") / p).alias("pr_auc"),
        F.col("P").cast("bigint").alias("positives"), F.col("N").cast("bigint").alias("negatives"),
    )
    return out if by else out.where("positives + negatives > 0")
