"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all documents to learn from. The weights are fitted by follow-the-regularised-leader
(FTRL-proximal) with elastic-net penalties on a bounded sample, and a temperature on held-back rows of it
calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField

from modelwatch.llm.common import append_columns, small_batches, stored

#: Hashed features, longest n-gram, and different texts that the fit takes at most (in expectation, shared by the languages).
BUCKET_BITS, LONGEST, FIT_ROWS = 14, 3, 3_000
#: Languages that are learned at most, those with the most different texts: the weights have a column for each.
FIT_LANGS = 256
UNKNOWN = "und"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_PIECE = 1 << 20


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text in lower case and how often they occur; ASCII that is no letter counts as a space."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    low = text.lower()
    for at in range(0, len(low), _PIECE):
        c = np.frombuffer(low[max(0, at - LONGEST + 1):at + _PIECE].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        c = np.where((c < 0x61) | ((c > 0x7A) & (c < 0x80)), np.uint64(0x20), c)
        lead = LONGEST - 1 if at else 0  # characters of the piece before: only as left context
        h = np.zeros(len(c), np.uint64)
        for n in range(1, LONGEST + 1):
            h = (h[:len(c) - n + 1] + c[n - 1:]) * _STEPS[n - 1]
            h = h ^ (h >> np.uint64(29))
            slots = h[max(0, lead - n + 1):] * _STEPS[0] >> np.uint64(64 - BUCKET_BITS)
            total += np.bincount(slots.astype(np.int64), minlength=len(total))
            if len(c) <= n:
                break
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    """Languages, IDF and weights per bucket, and the temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, found: np.ndarray, times: np.ndarray) -> np.ndarray:
        x = np.log1p(times) * self.idf[found]
        return x @ self.weights[found] / max(float(np.sqrt(x @ x)), 1e-12) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        """The most likely language (ties: the first by name) and its calibrated probability."""
        if not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        z = self.logits(*counts(text)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, size: int, epochs: int = 4,
             batch: int = 32, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
    """Weights (size x classes) and bias for sparse rows (features, values) by per-coordinate FTRL-proximal."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    w = np.zeros((size + 1, classes))  # the last row is the bias; it has no penalty
    order = np.random.default_rng(7)
    for _ in range(epochs):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = shuffled[at:at + batch]
            x = np.zeros((len(some), size + 1))
            for i, r in enumerate(some):
                x[i, rows[r][0]] = rows[r][1]
            x[:, size] = 1.0
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            logits = x @ w[used]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            g = x.T @ p / len(some)
            z[used] += g - (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha * w[used]
            n[used] += g * g
            first = np.where(used == size, 0.0, l1 / batch)[:, None]
            second = np.where(used == size, 0.0, l2 / batch)[:, None]
            w[used] = np.where(np.abs(z[used]) <= first, 0.0, -(z[used] - np.sign(z[used]) * first)
                               / ((beta + np.sqrt(n[used])) / alpha + second))
    return w[:size], w[size]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean() + 1e-3 * t * t)

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents each bucket occurs (bucket -1: documents)."""
    total, rows = np.zeros(1 << BUCKET_BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            total[counts(text.as_py() or "")[0]] += 1
            rows += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(total[found], rows))],
                                     ["bucket", "n"])


def _counted():
    def work(texts: list[str]) -> list[list]:
        found = [counts(t) for t in texts]
        return [[f.astype(np.int32) for f, _ in found], [n.astype(np.int32) for _, n in found]]

    return work


def fit(docs: DataFrame, learn: Column, rows: int = FIT_ROWS) -> Model:
    """Learn from the documents for which ``learn`` holds and text and lang are not null.

    Nothing else of them is used. Different texts of a language are sampled by a hash, copies once, so that languages have about equal
    shares of ``rows`` (20 texts at least); of more than ``FIT_LANGS`` languages those with the most different texts are learned (ties:
    the first by name). Without such documents the model knows no language.
    """
    small_batches(docs.sparkSession)
    base = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per_lang = base.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count()
    found = sorted(per_lang.orderBy(F.desc("count"), "lang").limit(FIT_LANGS).collect(), key=lambda r: r["lang"])
    size = 1 << BUCKET_BITS
    if not found:
        return Model([], np.zeros(size), np.zeros((size, 0)), np.zeros(0))
    df = base.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = dict(zip(df.column(0).to_pylist(), df.column(1).to_pylist()))
    n_docs = seen.pop(-1)
    idf = np.full(size, np.log(1 + n_docs), float)
    for bucket, n in seen.items():
        idf[bucket] = np.log((1 + n_docs) / (1 + n)) + 1
    langs = [r["lang"] for r in found]
    share = max(20, rows // len(langs))
    limits = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, share / r["count"]) * (1 << 30))) for r in found],
                                               "lang string, most long")
    chosen = (base.withColumn("h", F.xxhash64("text")).join(F.broadcast(limits), "lang")
              .where(F.pmod("h", F.lit(1 << 30)) < F.col("most")).dropDuplicates(["lang", "h"]))
    sample = append_columns(chosen.select("lang", "text", "h"), _counted,
                            [StructField("found", ArrayType(IntegerType())), StructField("times", ArrayType(IntegerType()))],
                            keep=["lang", "h"], as_bytes=False)
    sample = stored(sample, "langid").orderBy("h", "lang").toArrow().combine_chunks()
    y = np.array([langs.index(v) for v in sample.column("lang").to_pylist()], np.int64)
    data = []
    for f, t in zip(sample.column("found"), sample.column("times")):
        f, x = f.values.to_numpy(), np.log1p(t.values.to_numpy())
        x = x * idf[f]
        data.append((f, x / max(float(np.sqrt(x @ x)), 1e-12)))
    held = np.arange(len(data)) % 5 == 4
    w, b = fit_ftrl([d for d, h in zip(data, held) if not h], y[~held], len(langs), size)
    logits = np.array([x @ w[f] + b for (f, x), h in zip(data, held) if h]).reshape(-1, len(langs))
    return Model(langs, idf.astype(np.float32), w.astype(np.float32), b.astype(np.float32), temperature(logits, y[held]))


def _predict(model):
    return lambda texts: list(map(list, zip(*(model.value.predict(t) for t in texts)))) or [[], []]


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred and score, from the text alone.

    lang_pred is ``und`` with score 0 for null or empty texts, texts without a letter, or an empty model; columns with these
    names give way; repeated rows and null doc_ids stay rows of their own; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, partial(_predict, held), [StructField("lang_pred", StringType()),
                                                          StructField("score", DoubleType())], keep, as_bytes=False)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text leaves 2 modulo 4; a null doc_id is not held out, and not learned from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))
