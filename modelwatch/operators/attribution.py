"""Per-row attribution.

Linear mode: for a model linear in log-odds, the exact Shapley value of feature
``f`` against a background set is ``φ_f = β_f · (x_f − mean_background_f)``, and
``base + Σφ = logit(x)`` with ``base = b0 + Σ β·mean_background``. The coefficients are
the model's parameters and the means are one row, so all of it is arithmetic within a row:
no data row is shuffled, also not for the top drivers of a row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.operators.common import null_safe_join, stored
from modelwatch.params import DEFAULTS

# Fixed value: the reference caps a global importance report at this many features.
MAX_GLOBAL_FEATURES = 200
#: Coalitions that a task of :func:`permutation_attribution` scores, about.
SCORED_PARTITION_ROWS = 200_000


def background_sample(df: DataFrame, key: str, size: int = DEFAULTS.background_size,
                      seed: int = DEFAULTS.seed) -> DataFrame:
    """A deterministic uniform sample of ``size`` rows (all rows when fewer exist).

    Rows are ranked by ``md5(seed || key)``: a top-k (``TakeOrderedAndProject``),
    the sample size is the feature.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(size).drop("_h")


def to_long(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Wide numeric features → ``(key, feature, value)``."""
    wide = df.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(key, list(features), "feature", "value")


def linear_attribution(rows: DataFrame, background: DataFrame, coefficients: Mapping[str, float], intercept: float,
                       key: str) -> DataFrame:
    """S4 (linear) on wide rows: ``key``, an impact column per feature, ``base_value``, ``logit``, ``probability``.

    Impacts are in log-odds; ``base + Σ impact = logit``. A missing value has a NULL impact and adds nothing.
    The background means are one row and reach the data rows as a scalar subquery.
    """
    means = background.agg(*[F.avg(F.col(f).cast("double")).alias(f"_mean_{f}") for f in coefficients])
    at = null_safe_join(rows.select(key, *[F.col(f).cast("double").alias(f) for f in coefficients]), means, [])
    impacts = {f: F.lit(beta) * (F.col(f) - F.col(f"_mean_{f}")) for f, beta in coefficients.items()}
    base, total = F.lit(float(intercept)), F.lit(0.0)
    for f, beta in coefficients.items():
        base = base + F.coalesce(F.lit(beta) * F.col(f"_mean_{f}"), F.lit(0.0))
        total = total + F.coalesce(impacts[f], F.lit(0.0))
    out = at.select(key, *[c.alias(f) for f, c in impacts.items()], base.alias("base_value"), (base + total).alias("logit"))
    return out.withColumn("probability", 1.0 / (1.0 + F.exp(-F.col("logit"))))


def impacts_long(attributed: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``(key, feature, impact)`` of wide impacts, one row per feature, made in place."""
    return attributed.select(key, *features).unpivot(key, list(features), "feature", "impact")


def top_drivers(attributed: DataFrame, key: str, features: Sequence[str], k: int = DEFAULTS.drivers_per_side,
                digits: int = 6) -> DataFrame:
    """Per row the ``k`` largest positive and ``k`` largest negative impacts by magnitude.

    Impacts are rounded first (as reported); zero and missing impacts belong to neither side.
    Ties in magnitude are broken by feature name. Sorting and cutting happen in the row's own array.
    """
    entries = F.array(*[F.struct((-F.abs(F.round(F.col(f), digits))).alias("size"), F.lit(f).alias("feature"),
                                 F.round(F.col(f), digits).alias("impact")) for f in features])

    def side(name: str, wanted) -> DataFrame:
        best = F.slice(F.array_sort(F.filter(entries, lambda e: wanted(e["impact"]))), 1, k)
        return F.struct(F.lit(name).alias("side"), best.alias("best"))

    sides = F.array(side("positive", lambda x: x > 0), side("negative", lambda x: x < 0))
    return (attributed.select(key, F.explode(sides).alias("s"))
            .select(key, "s.side", F.posexplode("s.best").alias("pos", "e"))
            .select(key, "side", (F.col("pos") + 1).cast("int").alias("rank"), "e.feature", "e.impact"))


def global_importance(attributed: DataFrame, features: Sequence[str], limit: int = 50) -> DataFrame:
    """S5 + G4: mean |impact| per feature over the given rows, descending; the top ``limit`` (clamped to 1..200),
    with the total number of features and whether the list was cut."""
    capped = max(1, min(int(limit), MAX_GLOBAL_FEATURES))
    means = attributed.agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in features]).unpivot([], list(features), "feature", "m")
    w = Window.orderBy(F.col("m").desc(), F.col("feature").asc())  # one row per feature
    ranked = means.where(F.col("m").isNotNull()).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= capped).select(
        "feature", F.round("m", 6).alias("mean_abs_impact"), F.col("rank").cast("int").alias("rank"),
        F.lit(len(features)).cast("bigint").alias("total_features"), F.lit(len(features) > capped).alias("truncated"))


def permutation_attribution(rows: DataFrame, background: DataFrame, model, key: str, features: Sequence[str],
                            repeats: int = 8, seed: int = DEFAULTS.seed, output: str = "probability") -> tuple[DataFrame, DataFrame]:
    """S4 for any fitted model: Monte-Carlo permutation Shapley values on the raw feature columns.

    Each (row, repeat) sample draws one background row (``xxhash64(seed, key, repeat)``,
    an equi-join with the background, which is bounded by its sample size) and one
    feature order (ranks of ``xxhash64(seed, key, repeat, feature)``). Coalition ``k``
    takes the row's value for the first ``k`` features of the order and the background
    value for the rest; the ``F + 1`` coalitions are scored by ``model.transform``.
    A feature's impact in the sample is ``f(coalition after it) − f(coalition before it)``,
    so per sample the impacts add up to ``f(x) − f(background row)`` exactly; impacts
    are the mean over samples and ``base_value`` is the mean of ``f(background row)``.
    ``output="logit"`` explains the positive-class margin instead of the probability
    (for a logistic model the impact is then ``β·(x − background)`` in every sample).
    The empty and the full coalition are the background row and the row itself: the former is scored once per background
    row, the latter once per row. Rows are placed by key, :data:`SCORED_PARTITION_ROWS` coalitions to a task, so that the
    coalitions of a sample meet where they are scored, and the result is stored: both tables returned read it.
    Returns ``(impacts(key, feature, impact), per_row(key, base_value, prediction))``.
    """
    from pyspark.ml.functions import vector_to_array

    nf = len(features)
    value = vector_to_array("rawPrediction" if output == "logit" else "probability")[1]
    numbered = background.select(*features).withColumn(
        "_bg_id", F.row_number().over(Window.orderBy(*features)) - 1)  # one row per background row (bounded)
    bgr = stored(model.transform(numbered).select("_bg_id", *[F.col(f).alias(f"_bg_{i}") for i, f in enumerate(features)],
                                                  value.alias("_f0")), "background")
    n_bg = bgr.count()
    parts = max(1, -(-rows.count() * repeats * nf // SCORED_PARTITION_ROWS))
    whole = model.transform(rows.select(key, *features).repartition(parts, key)).select(key, *features, value.alias("_fx"))
    samples = whole.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    samples = samples.withColumn("_bg_id", F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("_rep")), F.lit(n_bg)))
    joined = samples.join(F.broadcast(bgr), "_bg_id", "inner")   # the background sample: its size is a parameter
    order = F.transform(F.array_sort(F.array(*[
        F.struct(F.xxhash64(F.lit(seed), F.col(key), F.col("_rep"), F.lit(f)).alias("h"), F.lit(i).alias("i"))
        for i, f in enumerate(features)])), lambda s: s["i"])
    ranked = joined.select(key, "_rep", *features, *[F.col(f"_bg_{i}") for i in range(nf)], "_f0", "_fx", order.alias("_order"))
    coal = ranked.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max(1, nf - 1)))))
    place = [F.array_position("_order", F.lit(i)) for i in range(nf)]  # 1 for the first feature of the order
    mixed = coal.select(key, "_rep", "_k", "_order", "_f0", "_fx", *[
        F.when(place[i] <= F.col("_k"), F.col(f)).otherwise(F.col(f"_bg_{i}")).alias(f) for i, f in enumerate(features)])
    scored = model.transform(mixed).select(key, "_rep", "_k", "_order", "_f0", "_fx", value.alias("_f"))
    own = F.struct("_k", "_f")
    ends = [F.struct(F.lit(k).alias("_k"), F.col(c).alias("_f")) for k, c in ((0, "_f0"), (nf, "_fx"))]
    entries = F.when(F.col("_k") == 1, F.array(ends[0], own, *ends[1:][:nf - 1])).otherwise(F.array(own))
    per_sample = (scored.withColumn("_e", entries).groupBy(key, "_rep")
                  .agg(F.first("_order").alias("_order"),
                       F.array_sort(F.flatten(F.collect_list("_e"))).alias("_c")))  # F + 1 entries per sample
    at = lambda i: F.element_at("_c", i)["_f"]
    phis = [(at(place[i].cast("int") + 1) - at(place[i].cast("int"))).alias(f) for i, f in enumerate(features)]
    per = per_sample.select(key, at(F.lit(1)).alias("_base"), at(F.lit(nf + 1)).alias("_fx"), *phis)
    agg = stored(per.groupBy(key).agg(F.avg("_base").alias("base_value"), F.first("_fx").alias("prediction"),
                                      *[F.avg(f).alias(f) for f in features]), "permutation")
    impacts = agg.select(key, *features).unpivot(key, list(features), "feature", "impact")
    return impacts, agg.select(key, "base_value", "prediction")
