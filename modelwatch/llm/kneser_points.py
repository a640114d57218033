"""Interpolated modified Kneser-Ney over code points, as Spark tables sharded by history.

Every code point is a symbol of its own, so the tables grow with the corpus. N-grams of all documents are kept with their
trusted counts; joins sharded by the history give each its interpolated probability, and documents meet them in a join of
(document, n-gram, times). Only a bounded number of the most frequent n-grams is also broadcast and summed on the spot.
Texts fall into folds, and a text meets the probabilities of the other folds' trusted texts: no text is judged by counts of
itself or its copies. The models of all folds are columns of the same tables and go through the same joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import stored

#: Symbols of an n-gram, and bits of one (a code point + 1; 0 is the border of a text). The base distribution is even over
#: the code points that occur, and never over fewer than LEAST_SYMBOLS.
ORDER, WIDTH, LEAST_SYMBOLS = 4, 21, 64
#: Most frequent n-grams that are broadcast (28 bytes each).
CACHED = 1 << 16
#: Folds of texts (by a hash): as many models, each of the trusted texts of all folds but one.
FOLDS = 3
#: Parts of a nat in which costs are added up, as whole numbers: sums do not depend on the order.
UNIT = 1 << 20
_PIECE, _GROUP = 1 << 14, 1 << 20


def discounts(of: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times.

    Where a large corpus has no rare n-grams of an order left, half of each range is taken: a discount is never 0, so
    every history leaves some probability to what it has not been followed by."""
    n = [of.get(i, 0) for i in range(1, 5)]
    if not n[0]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for i in range(3):
        d = i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5
        out.append(float(min(max(d, 0.05 * (i + 1)), i + 1)))
    return out


def pieces(text: str) -> Iterator[np.ndarray]:
    """Symbols of the text in bounded pieces, each behind the ORDER - 1 symbols before it."""
    before = np.zeros(ORDER - 1, np.int64)
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at:at + _PIECE].encode("utf-32-le", "replace"), "<u4")
        s = np.concatenate([before, c.astype(np.int64) + 1])
        before = s[len(s) - ORDER + 1:]
        yield s


def distinct(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Histories (ORDER - 1 symbols of WIDTH bits), last symbols and counts of the n-grams of these pieces."""
    s = np.concatenate(parts)
    ends = np.concatenate([np.arange(len(p)) >= ORDER - 1 for p in parts])[ORDER - 1:]
    known, bits = None, int(s.max()).bit_length()
    if bits * ORDER > 63:  # number the symbols of these pieces
        known, s = np.unique(s, return_inverse=True)
        bits = len(known).bit_length()
        if bits * ORDER > 63:
            half = len(parts) // 2
            yield from distinct(parts[:half])
            yield from distinct(parts[half:])
            return
    code = s[:len(ends)]
    for j in range(1, ORDER):
        code = code << bits | s[j:j + len(ends)]
    code, n = np.unique(code[ends], return_counts=True)
    symbols = [code >> bits * (ORDER - 1 - j) & (1 << bits) - 1 for j in range(ORDER)]
    if known is not None:
        symbols = [known[x] for x in symbols]
    h = symbols[0]
    for x in symbols[1:-1]:
        h = h << WIDTH | x
    yield h, symbols[-1].astype(np.int32), n


def fold_of(key: Column | str = "__key") -> Column:
    """The fold of a text by its key (copies share it)."""
    return F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of bounded groups of (text, fold), each fold apart (-1: texts that are not trusted)."""
    waiting: dict[int, list[np.ndarray]] = {}
    held: dict[int, int] = {}

    def settle(fold: int) -> Iterator[pa.RecordBatch]:
        for h, s, n in distinct(waiting.pop(fold)):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), pa.array(np.full(len(h), fold, np.int32)), pa.array(n)],
                                             ["h", "s", "fold", "n"])
        held[fold] = 0

    for batch in batches:
        for text, fold in zip(batch.column(0), batch.column(1).to_pylist()):
            for piece in pieces(text.as_py() or ""):
                waiting.setdefault(fold, []).append(piece)
                held[fold] = held.get(fold, 0) + len(piece)
                if held[fold] > _GROUP:
                    yield from settle(fold)
    for fold in sorted(waiting):
        yield from settle(fold)


def grams(texts: DataFrame) -> DataFrame:
    """(h, s, times, n0, n1, ...) of rows (text, fold): how often an n-gram occurs in all texts, and per model in the trusted
    texts of the other folds."""
    n = [F.sum(F.when((F.col("fold") >= 0) & (F.col("fold") != i), F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(FOLDS)]
    counted = texts.select("text", "fold").mapInArrow(_count, "h long, s int, fold int, n long")
    return counted.groupBy("h", "s").agg(F.sum("n").alias("times"), *n)


def _suffix(symbols: int) -> Column:
    """The last symbols of the history."""
    return F.col("h").bitwiseAND(F.lit((1 << WIDTH * symbols) - 1).cast("long"))


def probabilities(grams: DataFrame) -> DataFrame:
    """(h, s, p0, p1, ...) for n-grams (h, s, n0, n1, ...) of documents, n the trusted count of each model (0: in none).

    Lower orders count in how many ways a trusted n-gram continues. Each order joins its n-grams to the totals of their histories
    and to the probability of the n-gram without its first symbol; at most one row per symbol meets a key.
    """
    models = range(FOLDS)
    tables = [grams.select("h", "s", *[f"n{i}" for i in models])]
    for order in range(ORDER - 1, 0, -1):
        tables.append(stored(tables[-1].groupBy(_suffix(order - 1).alias("h"), "s")
                             .agg(*[F.sum((F.col(f"n{i}") > 0).cast("long")).alias(f"n{i}") for i in models]), f"order{order}"))
    symbols = max(LEAST_SYMBOLS, tables[-1].count())
    lower = None
    for order, table in enumerate(reversed(tables), 1):
        few = table.agg(*[F.count_if(F.col(f"n{i}") == c).alias(f"{i}:{c}") for i in models for c in range(1, 5)]).first()
        rows, totals, shares = table, [], []
        for i in models:
            d, n, cut = discounts({c: few[f"{i}:{c}"] for c in range(1, 5)}), F.col(f"n{i}"), F.col(f"cut{i}")
            rows = rows.withColumn(f"cut{i}", F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2]))
            totals += [F.sum(n).alias(f"total{i}"), F.sum(cut).alias(f"freed{i}")]
            total, seen = F.col(f"total{i}"), F.col(f"total{i}") > 0
            shares += [F.when(seen, (n - cut) / total).otherwise(0.0).alias(f"share{i}"),
                       F.when(seen, F.col(f"freed{i}") / total).otherwise(1.0).alias(f"weight{i}")]
        histories = rows.groupBy("h").agg(*totals)
        rows = rows.join(F.broadcast(histories) if order == 1 else histories, "h").select("h", "s", *shares)
        back = [F.lit(1 / symbols)] * FOLDS
        if lower is not None:
            rows = rows.withColumn("lower", _suffix(order - 2)).join(
                lower.select(F.col("h").alias("lower"), "s", *[f"p{i}" for i in models]), ["lower", "s"])
            back = [F.col(f"p{i}") for i in models]
        lower = stored(rows.select("h", "s", *[(F.col(f"share{i}") + F.col(f"weight{i}") * back[i]).alias(f"p{i}") for i in models]),
                       f"p{order}")
    return lower


def _mixed(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    x = (h.astype(np.uint64) + s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _cache(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Hashes (sorted, each once), histories, symbols and costs (a row per model)."""
    h, s, *q = (rows.column(c).to_numpy() for c in ("h", "s", *(f"q{i}" for i in range(FOLDS))))
    x, at = np.unique(_mixed(h, s), return_index=True)
    return x, h[at], s[at], np.stack(q)[:, at]


def _score(batches: Iterator[pa.RecordBatch], cached) -> Iterator[pa.RecordBatch]:
    """Per text: a row with the cost of its broadcast n-grams (s = -1, h below 0), and (key, n-gram, times) of the others."""
    x, ch, cs, cq = cached.value
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            out: list[tuple[np.ndarray, ...]] = []
            keys, folds = part.column(0).to_pylist(), part.column(2).to_pylist()
            for i, text in enumerate(part.column(1)):
                text, cost, group = text.as_py() or "", 0, []
                if not text:
                    continue
                for k, piece in enumerate(pieces(text), 1):
                    group.append(piece)
                    if k * _PIECE < len(text) and len(group) * _PIECE < _GROUP:
                        continue
                    for h, s, n in distinct(group):
                        at = np.minimum(np.searchsorted(x, _mixed(h, s)), max(len(x) - 1, 0))
                        hit = (ch[at] == h) & (cs[at] == s) if len(x) else np.zeros(len(h), bool)
                        cost += int((cq[folds[i], at[hit]] * n[hit]).sum()) if len(x) else 0
                        rest = ~hit
                        out.append((np.full(int(rest.sum()), i), h[rest], s[rest], n[rest]))
                    group = []
                spread = -1 - (int.from_bytes(keys[i][:8], "big") >> 2)
                out.append((np.array([i]), np.array([spread]), np.array([-1], np.int32), np.array([cost])))
            if out:
                at, h, s, n = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)).cast(pa.binary()), pa.array(h), pa.array(s),
                                                  pa.array(n)], ["__key", "h", "s", "n"])


def costs(texts: DataFrame, logs: DataFrame) -> DataFrame:
    """(__key, __cost in UNIT parts of a nat) of rows (__key, text); copies of a text have one key and count once.

    ``logs`` (h, s, times, q0, q1, ...) is stored and holds every n-gram of the texts; a text takes the costs of its fold's model.
    """
    spark = texts.sparkSession
    q = [f"q{i}" for i in range(FOLDS)]
    top = logs.orderBy(F.desc("times"), "h", "s").limit(CACHED).select("h", "s", *q).toArrow()
    cached = spark.sparkContext.broadcast(_cache(top))
    rows = texts.select("__key", "text", fold_of().alias("fold")).mapInArrow(
        partial(_score, cached=cached), "__key binary, h long, s int, n long")
    own = F.coalesce(*[F.when(fold_of() == i, F.col(c)) for i, c in enumerate(q)], F.lit(1))
    return (rows.join(logs.select("h", "s", *q), ["h", "s"], "left").groupBy("__key")
            .agg(F.sum(F.col("n") * own).alias("sum"), F.sum((F.col("s") == -1).cast("long")).alias("copies"))
            .select("__key", (F.col("sum") / F.col("copies")).alias("__cost")))
