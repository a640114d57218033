"""Quality rules: fixed rules on document statistics, then gradient-boosted trees over the same statistics.

The trees are fitted here (histogram splits, logistic loss, monotone constraints), flattened into node arrays and
scored for whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField

from modelwatch.llm.common import append_columns, stored

#: Labelled documents that a fit uses at most (in expectation; chosen by a hash of doc_id).
FIT_ROWS = 20_000
KEEP_FROM = 0.5

_SPACE = b" \t\n\r\x0b\x0c"
_INSIDE = bytes(range(0x80, 0xC0))  # bytes inside a UTF-8 character
_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())

#: Statistics that the trees see, with the sign of the effect that a larger value may have (0: any).
FEATURES = (("words", 0), ("word_length", 0), ("symbols", -1), ("repeat_lines", -1), ("repeat_words", -1),
            ("marks", -1), ("upper", 0), ("digits", 0), ("punctuation", 0), ("distinct_words", 0), ("line_words", 0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _number_of(text: bytes, kind: bytes) -> int:
    return len(text) - len(text.translate(None, kind))


def repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more (the first one included), and distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(words) < 4:
        return 0, len(seen)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, code, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[code] > 1)
    inside = np.zeros(len(words), bool)
    for j in range(3):
        inside[start + j] = True
    return int(inside.sum()), len(seen)


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five counts, and the trees' features."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE + _INSIDE))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    again, distinct = repeated(words)
    counts = [n, chars, _number_of(text, _SYMBOLS), len(lines) - len(set(lines)), again]
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    return counts, [float(np.log1p(n)), chars * per_word, counts[2] * per_word, counts[3] / max(len(lines), 1),
                    again * per_word, _number_of(text, _MARKS) * per_word, _number_of(text, _UPPER) * per_char,
                    _number_of(text, _DIGITS) * per_char, _number_of(text, _PUNCTUATION) * per_char,
                    distinct * per_word, n / max(len(lines), 1)]


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf points to itself, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """P(keep) of each row of features; a missing value (NaN) goes right."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2,
              bins: int = 64, ridge: float = 1.0, least: int = 20) -> Trees:
    """Boost trees on rows x and labels y (0 or 1). With sign 1 or -1, the score never falls or never rises in a feature:
    splits against the sign are not taken, and the halves' later values stay on their side of the split's middle.
    Without rows, or with one class only, the model is a constant."""
    share = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 1 - 1e-6
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def add(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), base)

        def grow(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = gradient[rows].sum(), weight[rows].sum()
            at = add(float(np.clip(g / (h + ridge), low, high)) * rate)
            best = None
            if level < depth and len(rows) >= 2 * least:
                for f, sign in enumerate(signs):
                    n = len(cuts[f]) + 1
                    if n < 2:
                        continue
                    gl, hl, nl = (np.cumsum(np.bincount(codes[rows, f], w, n))[:-1] for w in
                                  (gradient[rows], weight[rows], None))
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                    gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
                    bad = (nl < least) | (len(rows) - nl < least) | ((vr - vl) * sign < 0)
                    gain[bad] = 0
                    k = int(gain.argmax())
                    if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k, vl[k], vr[k])
            if best is None:
                score[rows] += nodes["value"][at]
                return at
            _, f, k, vl, vr = best
            middle = (vl + vr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs[f], ((low, high),) * 2)
            goes = codes[rows, f] <= k
            nodes["feature"][at], nodes["threshold"][at] = f, float(cuts[f][k])
            nodes["left"][at] = grow(rows[goes], gradient, weight, level + 1, *bounds[0])
            nodes["right"][at] = grow(rows[~goes], gradient, weight, level + 1, *bounds[1])
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), 0, -np.inf, np.inf))
    if not roots:
        roots.append(add(0.0))
    return Trees(*(np.array(nodes[k]) for k in ("feature", "threshold", "left", "right", "value")), np.array(roots), depth, base)


def _features():
    return lambda texts: [[statistics(t)[1] for t in texts]]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Fit the trees on labelled documents: about ``rows`` of them at most, chosen by a hash of doc_id over all labels.

    A document with several labels counts as kept only if all say so; null ids or labels are left out.
    """
    agreed = stored(labels.select("doc_id", F.col("quality").cast("int").alias("y")).dropna()
                    .groupBy("doc_id").agg(F.min("y").alias("y")), "labels")
    share = min(1.0, rows / max(1, agreed.count()))
    chosen = agreed.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = append_columns(some, _features, [StructField("x", ArrayType(DoubleType()))], keep=["doc_id", "y"]).drop("doc_id") \
        .orderBy("y", "x").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, found.column("y").to_numpy().astype(float), [s for _, s in FEATURES])


def _judge(model):
    trees = model.value

    def work(texts: list[bytes]) -> list:
        found = [statistics(t) for t in texts]
        counts = np.array([c for c, _ in found], np.int64)
        p = trees.probability(np.array([x for _, x in found]))
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        return [*counts.T, failed, p, ~failed & (p >= KEEP_FROM)]

    return work


def judge(docs: DataFrame, trees: Trees, keep: list[str] | None = None) -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed, and
    the trees give at least ``KEEP_FROM``. Null and empty texts have zero counts and fail; repeated rows and null
    doc_ids stay rows of their own; columns with these names give way; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)
    fields = [*(StructField(c, LongType()) for c in COUNTS), StructField("base_failed", BooleanType()),
              StructField("probability", DoubleType()), StructField("kept", BooleanType())]
    return append_columns(docs, partial(_judge, model), fields, keep)
