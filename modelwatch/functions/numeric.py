"""Scalar Column expressions: coercion, missing tests, histogram binning.

All of these stay JVM-side (built-in functions, no UDFs) so they run inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what pandas.to_numeric accepts as a plain decimal number
# (sign, digits, optional fraction, optional exponent), surrounding blanks allowed.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text → double; blank, unparseable, NaN or infinite text → NULL.

    ``try_cast`` alone is wider than wanted ('1d', 'NaN', 'inf' parse), so the
    text must also look like a decimal number.
    """
    s = col_(c).cast("string")
    return F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))


def to_number_or_zero(c: str | Column) -> Column:
    """``pd.to_numeric(errors="coerce").fillna(0)`` as one expression."""
    return F.coalesce(to_number(c), F.lit(0.0))


def is_missing(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """NULL, or NaN for floating columns (the pandas ``isna`` rule)."""
    x = col_(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def present_number(c: str | Column) -> Column:
    """True when a numeric value is neither NULL nor NaN (NaN sorts above all numbers in Spark)."""
    x = col_(c)
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def outer_edges(lo: Column, hi: Column) -> tuple[Column, Column]:
    """NumPy's histogram range rule: a constant column widens to ±0.5."""
    same = lo == hi
    return F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi)


def edge_at(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Edge ``i`` of ``numpy.linspace(lo, hi, bins + 1)``: ``i * step + lo``, last edge exactly ``hi``."""
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i == bins, hi).otherwise(i.cast("double") * step + lo)


def edges_array(lo: Column, hi: Column, bins: int) -> Column:
    """All ``bins + 1`` edges as an array (same arithmetic as :func:`edge_at`)."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: edge_at(i, lo, hi, bins))


def _edges_at_or_below(v: Column, lo: Column, hi: Column, bins: int, first: int, last: int) -> Column:
    """Number of edges ``e_first … e_last`` that are ``<= v``: a flat sum of comparisons."""
    terms = [(v >= edge_at(F.lit(i), lo, hi, bins)).cast("int") for i in range(first, last + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def bin_by_edges(v: str | Column, lo: Column, hi: Column, inner: list[Column]) -> Column:
    """Extended slot of ``v`` given the outer edges and the interior edges ``e_1 … e_(bins−1)``.

    Same rule as :func:`psi_bin`; the edges are precomputed columns (one row per
    group), so each data row only compares.
    """
    v = col_(v)
    count = F.lit(0)
    for e in inner:
        count = count + (v >= e).cast("int")
    return F.when(v < lo, F.lit(0)).when(v > hi, F.lit(len(inner) + 2)).otherwise(count + 1)


def psi_bin(v: str | Column, lo: Column, hi: Column, bins: int) -> Column:
    """Extended histogram slot of ``v`` against the edges of ``linspace(lo, hi, bins+1)``.

    0 = underflow (``v < e0``), 1..bins = interior bins ``[e_i, e_i+1)`` with the
    last one closed, bins+1 = overflow (``v > e_last``). Decided by comparison
    with the exact edge values (never by arithmetic alone), so values that sit
    on a floating edge land where ``numpy.histogram`` puts them. The expression
    is a flat sum of ``bins − 1`` comparisons, so it stays inside whole-stage codegen.
    """
    v = col_(v)
    inner = _edges_at_or_below(v, lo, hi, bins, 1, bins - 1) if bins > 1 else F.lit(0)
    return (
        F.when(v < lo, F.lit(0))
        .when(v > hi, F.lit(bins + 1))
        .otherwise(inner + 1)
    )


def unit_bin(p: str | Column, bins: int) -> Column:
    """Half-open bin of a probability on ``linspace(0, 1, bins+1)``; NULL outside ``[0, 1)``.

    p = 1.0 falls in no bin (the reference rule for calibration bins).
    """
    p = col_(p)
    lo, hi = F.lit(0.0), F.lit(1.0)
    inner = _edges_at_or_below(p, lo, hi, bins, 1, bins - 1) if bins > 1 else F.lit(0)
    return F.when((p >= 0.0) & (p < 1.0), inner)
