"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to them.

The field works on islands: runs of neighbouring words with a digit or an at-sign. Every segment of an island up to a
bounded size is scored as a whole (digits, groups, check sum, separators, border characters) for every type, and a
dynamic program over segment ends picks boundaries and types together. Its weights maximise the likelihood of islands from
the documents, labelled by the fixed patterns and by rewritten forms of what these found.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from modelwatch.llm.common import append_columns, small_batches, stored

KINDS = ("email", "ip", "card", "phone")
#: Different texts that the fit takes at most (in expectation, by a hash of the text), and different islands of each kind (or without
#: personal data) that it takes of theirs at most, by a hash again. Nothing else is bounded, and only the fit is.
FIT_DOCS, FIT_ISLANDS = 4_000, 60
#: A segment has at most so many tokens and characters.
MOST_TOKENS, MOST_CHARS = 24, 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|[^0-9A-Za-z\s]")
_NUMBERS = re.compile(r"[0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind and start; each kind is searched leftmost without overlap, in linear time."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def islands(text: str) -> list[tuple[int, int]]:
    """Runs of words with a trigger, joined over one space."""
    out: list[list[int]] = []
    m = _TRIGGER.search(text)
    while m:
        low = out[-1][1] if out else 0
        start = m.start()
        while start > low and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        if out and start - out[-1][1] == 1 and text[start - 1] == " ":
            out[-1][1] = end
        else:
            out.append([start, end])
        m = _TRIGGER.search(text, end)
    return [(a, b) for a, b in out]


def _features(s: str, before: str, after: str) -> list[float]:
    groups = _NUMBERS.findall(s)
    digits = "".join(groups)
    n, letters = len(digits), any(c.isalpha() for c in s)
    marks = set(_NUMBERS.sub("", s))
    at = s.count("@") + s.count("(at)") + s.count("[at]")
    quad = len(groups) == 4 and all(int(g) <= 255 for g in groups if len(g) <= 4) and max(map(len, groups)) <= 3
    return [1.0, n == 0, n < 7, 7 <= n <= 8, 9 <= n <= 15, 13 <= n <= 19, n > 19, s[0] == "+", "(" in s and not at,
            s.count("(") != s.count(")"), quad and not letters, quad and marks <= {".", " "}, len(groups) > 1,
            not letters and 13 <= n <= 19 and luhn(digits), not letters and 13 <= n <= 19 and not luhn(digits),
            letters, at == 1, at > 1, at == 1 and "." in s[s.rfind("@") + 1:], at == 0 and letters,
            not letters and marks <= {" ", "-"}, not letters and len(marks) > 1, "." in s and not letters,
            before.isalnum() or before in "+@", after.isalnum() or after == "@", len(s) > 40]


SIZE = len(_features("0", " ", " "))


@dataclass
class Lattice:
    """Candidate segments of one island: token starts and ends, and whole-span features."""

    begin: np.ndarray
    end: np.ndarray
    features: np.ndarray
    tokens: list[tuple[int, int]]
    by_end: list[np.ndarray]


def lattice(text: str, start: int, stop: int) -> Lattice:
    """All single tokens, and all longer segments that start and end like an entity and hold a trigger."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, stop)]
    begin, end, rows, by_end = [], [], [], [[] for _ in tokens]
    for i, (a, _) in enumerate(tokens):
        starts = text[a].isalnum() or text[a] in "+(_"
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            b = tokens[j][1]
            if j > i and (not starts or b - a > MOST_CHARS):
                break
            s = text[a:b]
            if j > i and not (s[-1].isalnum() and _TRIGGER.search(s)):
                continue
            by_end[j].append(len(begin))
            begin.append(i)
            end.append(j + 1)
            rows.append(_features(s, text[a - 1] if a else " ", text[b] if b < len(text) else " "))
    return Lattice(np.array(begin), np.array(end), np.array(rows, float), tokens, [np.array(x) for x in by_end])


@dataclass
class Field:
    """Weights by type (0: outside, then KINDS) and transition scores between neighbouring segments."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, x: Lattice) -> np.ndarray:
        """Score of each segment as each type; only single tokens can be outside."""
        out = x.features @ self.weights.T
        out[x.end - x.begin > 1, 0] = -np.inf
        return out

    def best(self, x: Lattice) -> list[Span]:
        """Entities (type index from 0, start, end) of the best segmentation; ties go to the earlier segment start."""
        n, k = len(x.tokens), len(self.weights)
        score = self.scores(x)
        total, back = np.full((n + 1, k), -np.inf), {}
        total[0] = 0.0
        for j in range(n):
            at = x.by_end[j]
            into = (total[x.begin[at]][:, :, None] + self.moves).max(axis=1) + score[at]
            pick = into.argmax(axis=0)
            total[j + 1] = into[pick, range(k)]
            back[j + 1] = at[pick]
        out, j, kind = [], n, int(total[n].argmax())
        while j:
            i = int(x.begin[back[j][kind]])
            if kind:
                out.append((kind - 1, x.tokens[i][0], x.tokens[j - 1][1]))
            kind, j = int((total[i] + self.moves[:, kind]).argmax()), i
        return out[::-1]

    def gradient(self, x: Lattice, gold: list[tuple[int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold path (segment, type) and its gradient in weights and moves."""
        n, k = len(x.tokens), len(self.weights)
        score = self.scores(x)
        ahead, rest = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        ahead[0, 0] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(n):
                at = x.by_end[j]
                into = _logsum(ahead[x.begin[at]][:, :, None] + self.moves, 1) + score[at]
                ahead[j + 1] = _logsum(into, 0)
            rest[n] = 0.0
            after: list[list] = [[] for _ in range(n + 1)]
            for j in range(n - 1, -1, -1):
                for s in x.by_end[j]:
                    after[x.begin[s]].append(_logsum(self.moves + (score[s] + rest[j + 1])[None, :], 1))
                if after[j]:
                    rest[j] = _logsum(np.array(after[j]), 0)
            whole = _logsum(ahead[n], 0)
            pair = np.exp(ahead[x.begin][:, :, None] + self.moves + (score + rest[x.end])[:, None, :] - whole)
        likelihood, weights, moves, before = -float(whole), -(pair.sum(axis=1).T @ x.features), -pair.sum(axis=0), 0
        for s, kind in gold:
            likelihood += score[s, kind] + self.moves[before, kind]
            weights[kind] += x.features[s]
            moves[before, kind] += 1
            before = kind
        return likelihood, weights, moves


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def fit_field(examples: list[tuple[str, list[Span]]], rounds: int = 25, rate: float = 0.5, ridge: float = 0.002) -> Field:
    """Maximise the likelihood of labelled island texts by AdaGrad. No examples give a field that finds nothing."""
    k = 1 + len(KINDS)
    field = Field(np.zeros((k, SIZE)), np.zeros((k, k)))
    field.weights[1:, 0] = -3.0
    data = []
    for text, spans in examples:
        x = lattice(text, 0, len(text))
        place = {(x.tokens[a][0], x.tokens[b - 1][1]): s for s, (a, b) in enumerate(zip(x.begin, x.end))}
        if not all((a, b) in place for _, a, b in spans):
            continue
        inside = {place[a, b]: kind + 1 for kind, a, b in spans}
        covered = [(a, b) for _, a, b in spans]
        gold = [(place[t], 0) for t in x.tokens if not any(a <= t[0] < b for a, b in covered)]
        data.append((x, sorted([*gold, *inside.items()], key=lambda g: x.begin[g[0]])))
    sums = np.full((k, SIZE), 1e-8), np.full((k, k), 1e-8)
    for _ in range(rounds if data else 0):
        gw, gm = -ridge * len(data) * field.weights, -ridge * len(data) * field.moves
        for x, gold in data:
            _, w, m = field.gradient(x, gold)
            gw, gm = gw + w, gm + m
        for total, g, value in ((sums[0], gw, field.weights), (sums[1], gm, field.moves)):
            total += g * g
            value += rate * g / np.sqrt(total)
    return field


def _rewritten(kind: int, s: str) -> list[str]:
    """Other ways to write what a fixed pattern found; they stay of the same kind."""
    digits = _NOT_DIGIT.sub("", s)
    if kind == 0:
        return [s.replace("@", "(at)"), s.replace("@", "[at]")]
    if kind == 1:
        return [s.replace(".", " . "), s.replace(".", "-")]
    if kind == 2:
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-9]} {digits[-9:-6]} {digits[-6:-3]} {digits[-3:]}"]


def _misses(kind: int, s: str) -> list[str]:
    """Numbers made of the same digits that are no personal data: versions, dates, amounts and counters."""
    digits = _NOT_DIGIT.sub("", s)
    if kind == 1:
        return [".".join(s.split(".")[:3]), "/".join(s.split(".")[:3])]
    if kind == 2:
        return [digits[:8], f"{digits[0]},{digits[1:4]}.{digits[4:6]}", f"20{digits[:2]}-0{digits[2]}-1{digits[3]}"]
    if kind == 3:
        return [f"20{digits[-2:]}-{digits[-4:-1]}-{digits[-5:-1]}", f"1{digits[-1]}.{digits[-2]}.20{digits[-3:-1]}", f"{digits[-3:-1]}-{digits[-5:-2]}"]
    return []


def labelled_islands(text: str) -> list[tuple[int, str, int, int]]:
    """(kind, island, start, end) of the islands of at most 200 characters that hold one span of the patterns, or none (kind -1)."""
    out = []
    spans = sorted(base_spans(text), key=lambda x: x[2])  # a span that meets an island ends after its start
    ends, longest = [x[2] for x in spans], max((e - s for _, s, e in spans), default=0)
    for a, b in islands(text):
        if b - a > 200:
            continue
        near = spans[bisect_right(ends, a):bisect_left(ends, b + longest)]
        here = [x for x in near if x[1] < b]
        if not here:
            out.append((-1, text[a:b], 0, 0))
        elif len(here) == 1 and a <= here[0][1] and here[0][2] <= b:
            kind, s, e = here[0]
            out.append((kind, text[a:b], s - a, e - a))
    return out


def examples_of(found: Iterable[tuple[int, str, int, int]]) -> list[tuple[str, list[Span]]]:
    """Labelled islands and, of those with a span, their rewritten forms and near misses."""
    out: list[tuple[str, list[Span]]] = []
    for kind, piece, s, e in found:
        out.append((piece, [(kind, s, e)] if kind >= 0 else []))
        if kind >= 0:
            out += [(piece[:s] + w + piece[e:], [(kind, s, s + len(w))]) for w in _rewritten(kind, piece[s:e])]
            out += [(piece[:s] + w + piece[e:], []) for w in _misses(kind, piece[s:e])]
    return out


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and those with the field's added; added spans meet no other span."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for a, b in islands(text):
        for k, s, e in field.best(lattice(text, a, b)):
            if not any(x < e and y > s for x, y in taken):
                added.append((k, s, e))
    return base, sorted(base + added)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first span's kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            if found := labelled_islands(text.as_py() or ""):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.string(), pa.int32(), pa.int32()))],
                                                 ["kind", "piece", "start", "end"])


def fit(docs: DataFrame, rows: int = FIT_DOCS, per_kind: int = FIT_ISLANDS) -> Field:
    """Fit the field on islands of about ``rows`` different texts at most, of any length.

    Islands are found in Spark; of each kind the ``per_kind`` different ones with the smallest hashes come to the driver, so neither
    copies nor one long text crowd out others. Without islands the field finds nothing.
    """
    small_batches(docs.sparkSession)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    share = min(1.0, rows / max(1, some.select(F.count_distinct("h")).first()[0]))
    chosen = some.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"])
    found = stored(chosen.select("text").mapInArrow(_islands, "kind int, piece string, start int, end int").distinct(), "islands")
    taken = []
    for kind in range(-1, len(KINDS)):
        few = found.where(F.col("kind") == kind).orderBy(F.xxhash64("piece"), "piece", "start").limit(per_kind)
        taken += [tuple(r) for r in few.collect()]
    return fit_field(examples_of(taken))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _find(model):
    def work(texts: list[str]) -> list[list]:
        out: list[list] = [[] for _ in range(len(KINDS) + 3)]
        for text in texts:
            base, spans = all_spans(text, model.value)
            counts = [sum(1 for s in base if s[0] == k) for k in range(len(KINDS))]
            for column, value in zip(out, (*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans),
                                           redact(text, spans))):
                column.append(value)
        return out

    return work


def find(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """Append n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans (all, as text) and redacted.

    Null and empty texts have no spans; repeated rows and null doc_ids stay rows of their own; columns with these names
    give way; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)
    fields = [*(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()),
              StructField("spans", StringType()), StructField("redacted", StringType())]
    return append_columns(docs, partial(_find, model), fields, keep, as_bytes=False)
