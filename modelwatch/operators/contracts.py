"""Contracts (B4–B10, T13): plan-time column checks and per-row violation arrays.

Row checks never raise inside a task: each row gets an array of violations
(``array_compact(array(when …))``), which can be counted, exploded, or used to
split a table into good rows and a quarantine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.functions.numeric import NUMERIC_TEXT, to_number

# Fixed value: whole-number text.
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
# A whole number with an empty fraction also converts to int.
INTEGRAL_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"
# Fixed value: the contract type names and their Spark types (unknown names fall back to str).
TYPE_NAMES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}


@dataclass(frozen=True)
class ColumnSpec:
    type: str = "str"
    required: bool = True
    nullable: bool = False
    allowed: tuple | None = None


@dataclass(frozen=True)
class Contract:
    columns: Mapping[str, ColumnSpec] = field(default_factory=dict)
    nullable_overrides: frozenset = frozenset()   # relaxed columns (redacted / dropped in retraining rows)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Fail at plan time, naming every missing column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks required columns: {missing}")


def _integral(x: Column) -> Column:
    """A double without a fraction as bigint (``1.0E7`` is how Spark prints large ones)."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 9.0e15), x.try_cast("bigint"))


def coerce(c: Column, type_name: str) -> Column:
    """Contract coercion: NULL when the value does not convert (never raises)."""
    t = TYPE_NAMES.get(type_name, "string")
    s = c.cast("string")
    if t == "bigint":
        exact = F.regexp_replace(F.trim(s), r"\.0*$", "").try_cast("bigint")
        return F.when(s.rlike(INTEGRAL_TEXT), exact).otherwise(_integral(to_number(s)))
    if t == "double":
        return to_number(s)
    if t == "boolean":
        low = F.lower(F.trim(s))
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    return s


def violations(df: DataFrame, contract: Contract) -> Column:
    """An ``array<struct<column_name, check, value>>`` of every failed check in the row."""
    checks: list[Column] = []
    for name, spec in contract.columns.items():
        if name not in df.columns:
            continue
        raw = F.col(f"`{name}`")
        conv = coerce(raw, spec.type)
        nullable = spec.nullable or name in contract.nullable_overrides

        def item(check: str, cond: Column) -> Column:
            return F.when(cond, F.struct(F.lit(name).alias("column_name"), F.lit(check).alias("check_name"),
                                         raw.cast("string").alias("value")))

        checks.append(item("dtype", raw.isNotNull() & conv.isNull()))
        if not nullable:
            checks.append(item("not_nullable", raw.isNull()))
        if spec.allowed is not None:
            checks.append(item("isin", conv.isNotNull() & ~conv.isin(*spec.allowed)))
    if not checks:
        return F.array().cast("array<struct<column_name:string,check_name:string,value:string>>")
    return F.array_compact(F.array(*checks))


def missing_contract_columns(df: DataFrame, contract: Contract) -> list[str]:
    return sorted(n for n, s in contract.columns.items() if s.required and n not in df.columns)


def violation_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """Failures grouped by (column, check); missing required columns are reported with count NULL."""
    v = df.select(F.explode(violations(df, contract)).alias("v"))
    counts = v.groupBy("v.column_name", "v.check_name").agg(F.count(F.lit(1)).cast("bigint").alias("failures"))
    missing = missing_contract_columns(df, contract)
    if missing:
        spark = df.sparkSession
        extra = spark.createDataFrame([(m, "column_in_dataframe", None) for m in missing],
                                      "column_name string, check_name string, failures bigint")
        counts = counts.unionByName(extra)
    return counts


def checked(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` with its ``_violations``. A missing required column is a violation of every row."""
    found = violations(df, contract)
    absent = [F.struct(F.lit(m).alias("column_name"), F.lit("column_in_dataframe").alias("check_name"),
                       F.lit(None).cast("string").alias("value")) for m in missing_contract_columns(df, contract)]
    return df.withColumn("_violations", F.concat(found, F.array(*absent)) if absent else found)


def split_checked(tagged: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """B6 from :func:`checked` rows: (coerced good rows, quarantined rows with their violations)."""
    good = tagged.where(F.size("_violations") == 0).select(*[
        coerce(F.col(f"`{c}`"), contract.columns[c].type).alias(c) if c in contract.columns else F.col(f"`{c}`")
        for c in tagged.columns if c != "_violations"])
    return good, tagged.where(F.size("_violations") > 0)


def split_valid(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(coerced good rows, quarantined rows with their violations)."""
    return split_checked(checked(df, contract), contract)


def target_violations(df: DataFrame, target: str, allowed: Sequence = (0, 1)) -> DataFrame:
    """Rows whose target is outside the allowed set (NULL counts as invalid)."""
    return df.where(~F.coalesce(F.col(target).isin(*allowed), F.lit(False)))


def check_target(df: DataFrame, target: str, allowed: Sequence = (0, 1)) -> None:
    """B5 as a gate: raise with the offending values (one ``limit`` probe, not a full collect)."""
    bad = target_violations(df, target, allowed).select(target).distinct().limit(20).collect()
    if bad:
        raise ValueError(f"target holds values outside {list(allowed)}: {[r[0] for r in bad]}")


def scoring_contract(df: DataFrame, feature_schema: Sequence[str], target: str | None = None) -> DataFrame:
    """Missing feature → error; target present → error; select in recorded order (extras dropped)."""
    missing = sorted(set(feature_schema) - set(df.columns))
    if missing:
        raise ValueError(f"scoring rows lack features of the model: {missing}")
    if target is not None and target in df.columns:
        raise ValueError(f"scoring rows must not carry the target {target!r}")
    return df.select(*[F.col(f"`{c}`") for c in feature_schema])


def payload_check(df: DataFrame, payload: str, feature_types: Mapping[str, str]) -> DataFrame:
    """Per JSON payload, unknown fields, missing fields and fields of the wrong type.

    The document is parsed once per row (a projected column) and each list once. A JSON null is a wrong type;
    text that is no JSON object is invalid with ``parse_error``.
    """
    schema = F.array(*[F.lit(k) for k in feature_types])
    parsed = df.select("*", F.from_json(F.col(payload), "map<string,string>").alias("_m"))
    m = F.coalesce("_m", F.create_map().cast("map<string,string>"))
    bad = F.array_compact(F.array(*[
        F.when(F.map_contains_key(m, k) & coerce(m[k], t).isNull(), F.lit(k)) for k, t in feature_types.items()]))
    lists = parsed.select(
        "*",
        F.array_sort(F.array_except(F.map_keys(m), schema)).alias("_unknown"),
        F.when(F.col("_m").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array_sort(F.array_except(schema, F.map_keys(m)))).alias("_missing"),
        F.array_sort(bad).alias("_bad"),
    )
    return lists.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.array_join("_unknown", ",").alias("unknown_fields"),
        F.array_join("_missing", ",").alias("missing_fields"),
        F.array_join("_bad", ",").alias("bad_types"),
        F.col("_m").isNull().alias("parse_error"),
        (F.col("_m").isNotNull() & (F.size("_unknown") == 0) & (F.size("_missing") == 0)
         & (F.size("_bad") == 0)).alias("valid"),
    )


#: Fixed value: rows of the reference that type inference falls back to.
TYPE_SAMPLE_ROWS = 512


def infer_types(df: DataFrame) -> list[tuple[str, str]]:
    """B9 from a typed schema: bool, int, float, else str (checked in that order). Plan time."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.BooleanType):
            out.append((f.name, "bool"))
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out.append((f.name, "int"))
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            out.append((f.name, "float"))
        else:
            out.append((f.name, "str"))
    return out


def infer_text_types(df: DataFrame, columns: Sequence[str] | None = None, missing_widens: bool = False) -> DataFrame:
    """B9 for text tables: per column the narrowest of bool / int / float / str all non-NULL values fit.

    With ``missing_widens`` a missing value makes ``int`` a ``float`` and ``bool`` a ``str``, and a column without values is
    ``float`` (data frames of NumPy columns read text so). One aggregation: ``count_if(non-NULL and does not parse)`` per
    column and type.
    """
    cols = list(columns or df.columns)
    aggs = []
    for c in cols:
        s = F.col(f"`{c}`").cast("string")
        nn = s.isNotNull()
        low = F.lower(F.trim(s))
        aggs += [
            F.count_if(nn & ~low.isin("true", "false")).alias(f"{c}\u0001bool"),
            F.count_if(nn & ~s.rlike(INTEGER_TEXT)).alias(f"{c}\u0001int"),
            F.count_if(nn & ~s.rlike(NUMERIC_TEXT)).alias(f"{c}\u0001float"),
            F.count_if(nn).alias(f"{c}\u0001n"), F.count_if(~nn).alias(f"{c}\u0001null"),
        ]
    wide = df.agg(*aggs)
    rows = []
    for c in cols:
        def bad(t):
            return F.col(f"`{c}\u0001{t}`")
        gaps = F.lit(missing_widens) & (bad("null") > 0)
        kind = (F.when(bad("n") == 0, "float" if missing_widens else "str")
                .when(bad("bool") == 0, F.when(gaps, "str").otherwise("bool"))
                .when(bad("int") == 0, F.when(gaps, "float").otherwise("int"))
                .when(bad("float") == 0, "float").otherwise("str"))
        rows.append(F.struct(F.lit(c).alias("column_name"), kind.alias("inferred_type")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feature_types(features: Sequence[str], recorded: Mapping[str, str] | None = None, sample: DataFrame | None = None) -> dict[str, str]:
    """B9 with its fallbacks: the recorded types (``str`` for a feature they lack); without them those of the reference sample;
    all ``str`` when there is no sample or it lacks a feature.

    ``sample`` is the reference's first :data:`TYPE_SAMPLE_ROWS` rows. Text columns take the narrowest type that their
    values fit, others that of the schema. One row per feature comes to the driver.
    """
    if recorded is not None:
        return {c: recorded.get(c, "str") for c in features}
    if sample is None or not set(features) <= set(sample.columns):
        return dict.fromkeys(features, "str")
    rows = sample.select(*[F.col(f"`{c}`") for c in features])
    types = dict(infer_types(rows))
    text = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    found = {r["column_name"]: r["inferred_type"] for r in infer_text_types(rows, text, True).collect()} if text else {}
    return types | found


def cast_recorded_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``str`` → text; ``int`` / ``float`` → number with unparseable values as 0."""
    out = []
    for c in df.columns:
        t = types.get(c)
        col = F.col(f"`{c}`")
        if t == "str":
            out.append(col.cast("string").alias(c))
        elif t == "int":
            out.append(F.coalesce(to_number(col), F.lit(0.0)).cast("bigint").alias(c))
        elif t == "float":
            out.append(F.coalesce(to_number(col), F.lit(0.0)).alias(c))
        else:
            out.append(col)
    return df.select(*out)


def bundle_check(models: DataFrame, schema_col: str = "feature_schema", count_col: str = "feature_count") -> DataFrame:
    """Per model row, the reasons its bundle cannot be served (empty list = valid).

    The feature schema must be a non-empty list of non-empty names, and a recorded feature count must
    equal its length. Metrics may be absent, and names may repeat.
    """
    fs = F.col(schema_col)
    checks = [F.when(fs.isNull() | (F.size(fs) == 0), F.lit("empty_feature_schema")),
              F.when(F.exists(fs, lambda x: x.isNull() | (x == "")), F.lit("blank_feature_name"))]
    if count_col in models.columns:
        checks.append(F.when(F.col(count_col).isNotNull() & fs.isNotNull() & (F.col(count_col) != F.size(fs)),
                             F.lit("feature_count_mismatch")))
    if "has_metadata" in models.columns:
        checks.append(F.when(~F.coalesce("has_metadata", F.lit(False)), F.lit("metadata_missing")))
    return models.select("*", F.array_compact(F.array(*checks)).alias("reasons"))
