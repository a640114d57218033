"""Language-model scores by a class-based bigram model.

Every word belongs to a class; a word's probability is that of its class after the class before, times its share of its
class. The classes come from exchange clustering: words move, one round after the other, to the class that raises the
likelihood of the training text most. The most frequent words move on their own; all others move with the words of
their shape (ending), and words that training never saw take their shape's class. Emission counts are kept for every
training word, in a table that grows with the corpus; documents meet it in a join of (document, word, times), and only a
bounded number of frequent words is also broadcast and summed on the spot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from modelwatch.llm.common import held, small_batches, stored

#: Classes besides that of the text end (number 0), rounds of exchange, and parts of the units, one of which moves per round.
CLASSES, ROUNDS, PARTS = 64, 6, 2
#: Words that move on their own (at most), shapes of all others, and words whose counts are broadcast (at most, besides those).
UNITS, SHAPES, CACHED = 1 << 16, 1 << 12, 1 << 17
#: Parts of a decimal logarithm in which scores are added up, as whole numbers: sums do not depend on the order.
UNIT = 1 << 32
#: Distinct words, and neighbouring pairs, that a task holds before it hands on their counts; shapes of word ends that it keeps.
HELD_WORDS, HELD_PAIRS, KEPT = 1 << 17, 1 << 20, 1 << 16
#: Bytes of text (and one text more) that are split at a time, and length beyond which a word goes by a 128-bit hash.
PIECE, LONGEST = 1 << 20, 24
#: Parts into which first units are dealt (a part has at most units / DEALT of them), pairs in one stored row, and rows read at a time.
DEALT, ROW, ROWS = 1 << 12, 1 << 12, 1 << 7
#: Units whose surroundings travel in one row.
GROUP = 1 << 9
_DIGITS = bytes(0x39 if 0x30 <= b <= 0x39 else b for b in range(256))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, ...) in batches of about PIECE bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // PIECE)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)
        pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts after lower-casing A-Z, without the ends: which of the distinct words each one is,
    how many a text has, and the distinct words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary())
    size = pc.binary_length(words).to_numpy()
    full = size[at] > 0  # splitting leaves empty words at either end of a text
    before = np.append(0, np.cumsum(full))
    counts = np.diff(before[split.offsets.to_numpy()])
    if size.max(initial=0) > LONGEST:
        words = words.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(size > LONGEST):
            words[i] = b"long word %s %s" % (xxhash.xxh3_128_hexdigest(words[i]).encode(), words[i][-3:])
        words = pa.array(words, pa.binary())
    return at[full], counts, words


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts with these counts stand in a row of all texts with one end before, between and after them, and
    where each text's first pair (end and first word) starts."""
    starts = np.cumsum(counts) - counts + np.arange(len(counts))
    return np.arange(counts.sum()) + np.repeat(np.arange(len(counts)), counts) + 1, starts


def shape(word: bytes) -> int:
    """Words with the same last three bytes (any digit standing for all) share a shape."""
    return zlib.crc32(word[-3:].translate(_DIGITS)) % SHAPES


_shapes: dict[bytes, int] = {}  # by last three bytes: a worker meets few


def shapes_of(words: pa.Array) -> np.ndarray:
    """``shape`` of many words."""
    tails = pc.binary_slice(words, -3).dictionary_encode()
    found = tails.dictionary.to_pylist()
    if len(_shapes) > KEPT:
        _shapes.clear()
    for tail in found:
        if tail not in _shapes:
            _shapes[tail] = shape(tail)
    return np.array([_shapes[t] for t in found], np.int64)[tails.indices.to_numpy()]


def numbered(words: pa.Array, numbers: dict[bytes, int]) -> np.ndarray:
    """Numbers of known words; -1 - shape for all others."""
    at = np.fromiter(map(numbers.get, words.to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int64, len(words))
    others = np.flatnonzero(at < 0)
    at[others] = -1 - shapes_of(words.take(pa.array(others)))
    return at


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in texts (text, trained), pre-aggregated: (word, shape, n of all texts, c of training texts)."""
    waiting: list[pa.Table] = []
    size = 0

    def merged() -> pa.Table:
        found = pa.concat_tables(waiting).group_by("word", use_threads=False).aggregate([("n", "sum"), ("c", "sum")])
        return found.rename_columns(["word", "n", "c"])

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shapes = pa.array(shapes_of(table.column("word").combine_chunks()), pa.int32())
        yield from table.add_column(1, "shape", shapes).to_batches(max_chunksize=1 << 16)

    for batch in pieces(batches):
        at, counts, words = words_of(batch.column(0))
        trained = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), counts)
        n, c = np.bincount(at, minlength=len(words)), np.bincount(at[trained], minlength=len(words))
        used = pa.table({"word": words, "n": n, "c": c}).filter(pa.array(n > 0))
        waiting.append(used)
        size += len(used)
        if size > 2 * HELD_WORDS:
            waiting = [merged()]
            size = len(waiting[0])
            if size > HELD_WORDS:
                yield from counted(waiting.pop())
                size = 0
    if waiting:
        yield from counted(merged())


def frequent(vocabulary: DataFrame, count: str, most: int) -> Column:
    """Whether a word's count lies in the highest classes of counts that together hold at most ``most`` words."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 64).cast("int")
    sizes = vocabulary.where(F.col(count) > 0).groupBy(step.alias("step")).count().collect()  # at most 64 * 63 rows
    least, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return F.lit(False) if least is None else (F.col(count) > 0) & (step >= least)


def _totals(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _coded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for a pair: the part of its first unit, the rest of that, the second unit."""
    return a % DEALT << 50 | a // DEALT << 32 | b


def _decoded(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (code >> 32 & (1 << 18) - 1) * DEALT + (code >> 50), code & (1 << 32) - 1


def _binary(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The numbers between neighbouring cuts as the bytes of one value each."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """All numbers of a column that ``_binary`` made."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(kind) if len(column) else np.zeros(0, kind)


def _parts_of(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted pairs in order of their codes: a row per part."""
    part = code >> 50
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    cuts = np.append(first, len(code))
    yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), _binary(code, cuts), _binary(n, cuts)], ["part", "pairs", "n"])


def _pairs(batches: Iterator[pa.RecordBatch], name: str, words) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring units (0 is the end of a text, then the shapes, then the frequent words) by part of the first."""
    numbers = held(("brown units", name), lambda: dict(zip(words.value, range(1 + SHAPES, 1 + SHAPES + len(words.value)))))
    waiting, size = [], 0
    for batch in pieces(batches):
        at, counts, found = words_of(batch.column(0))
        unit = numbered(found, numbers)
        unit = np.where(unit < 0, -unit, unit)  # -1 - shape: unit 1 + shape
        row = np.zeros(len(at) + len(counts) + 1, np.int64)
        row[places(counts)[0]] = unit[at]
        waiting.append(_coded(row[:-1], row[1:]))
        size += len(row)
        if size > HELD_PAIRS:
            yield from _parts_of(*np.unique(np.concatenate(waiting), return_counts=True))
            waiting, size = [], 0
    if waiting:
        yield from _parts_of(*np.unique(np.concatenate(waiting), return_counts=True))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted pairs (a, b, n) by part of the first unit."""
    for batch in batches:
        a, b, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        if len(a):
            yield from _parts_of(*_totals(_coded(a, b), n))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair once, from rows (part, pairs, n) in order of the parts. Holds about HELD_PAIRS, and one part's pairs."""
    def rows(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.append(np.arange(0, len(code), ROW), len(code))
        if len(code):
            yield pa.RecordBatch.from_arrays([_binary(code, cuts), _binary(n, cuts)], ["pairs", "n"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            waiting.append((_numbers(part.column(1), np.int64), _numbers(part.column(2), np.int64)))
            size += len(waiting[-1][0])
            if size > HELD_PAIRS:
                code, n = _totals(*(np.concatenate(x) for x in zip(*waiting)))
                done = int(np.searchsorted(code, code[-1] >> 50 << 50))  # the last part may go on
                yield from rows(code[:done], n[:done])
                waiting, size = [(code[done:], n[done:])], 0
    if waiting:
        yield from rows(*_totals(*(np.concatenate(x) for x in zip(*waiting))))


def blocks(dealt: DataFrame) -> DataFrame:
    """Stored pairs, each once, ROW to a row (pairs, n); the pairs of a part of the first units lie in one file."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(dealt.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_merged, "pairs binary, n binary"), "brown-pairs")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(joint: np.ndarray) -> float:
    """Log-likelihood of the training text by class counts (followed by), but for a constant."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(1)).sum() - _xlogx(joint.sum(0)).sum())


def gains(joint: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, itself: float, logs: np.ndarray | None = None) -> np.ndarray:
    """Change of the likelihood by class to which a unit of class ``own`` might move (relative to being in none).

    right and left: how often each class follows the unit and comes before it, without ``itself`` (unit after itself); logs: the
    counts' ``x log x``, where known.
    """
    logs = (_xlogx(joint) if logs is None else logs).copy()
    rest = joint.copy()
    rest[own] -= right
    rest[:, own] -= left
    rest[own, own] -= itself
    logs[own], logs[:, own] = _xlogx(rest[own]), _xlogx(rest[:, own])
    after, before = np.flatnonzero(right), np.flatnonzero(left)
    a, b = rest[:, after], rest[before].T
    gain = (_xlogx(a + right[after]) - logs[:, after]).sum(1) + (_xlogx(b + left[before]) - logs[before].T).sum(1)
    here, alone = np.diagonal(rest), np.diagonal(logs)
    # the class with itself: all at once, not one after the other
    gain += _xlogx(here + right + left + itself) + alone - _xlogx(here + right) - _xlogx(here + left)
    # what comes before the unit stays in its own classes' row totals, what follows it in their column totals
    for total, mass in ((rest.sum(1) + left, right.sum() + itself), (rest.sum(0) + right, left.sum() + itself)):
        gain -= _xlogx(total + mass) - _xlogx(total)
    return gain


def _movers(units: int) -> int:
    """Places for the units of a part that moves: unit u has place u // PARTS."""
    return -(-units // PARTS)


def _surroundings(batches: Iterator[pa.RecordBatch], classes: np.ndarray, size: int, part: int | None) -> Iterator[pa.RecordBatch]:
    """A row with the class counts of a task's pairs (joint), and, by group of units of the part that moves next, how often classes
    follow a unit (side 0) and come before it (1), and itself after itself (2): (place in group, side, class) and n."""
    joint = np.zeros(size * size, np.int64)
    moving = part is not None
    around = np.zeros((_movers(len(classes)) if moving else 0) * 3 * size, np.int64)
    units = np.arange(len(classes))
    place = np.where((units > 0) & (units % PARTS == part), units // PARTS * 3 * size, -1) if moving else None
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            (a, b), n = _decoded(_numbers(rows.column(0), np.int64)), _numbers(rows.column(1), np.int64)
            ca, cb = classes[a], classes[b]
            joint += np.bincount(ca * size + cb, n, size * size).astype(np.int64)
            if moving:
                follows, comes = place[a], place[b]
                at, to = np.flatnonzero(follows >= 0), np.flatnonzero(comes >= 0)
                same = at[a[at] == b[at]]
                np.add.at(around, follows[at] + cb[at], n[at])
                np.add.at(around, comes[to] + size + ca[to], n[to])
                np.add.at(around, follows[same] + 2 * size + ca[same], n[same])
    fields = pa.schema([("group", pa.int32()), ("joint", pa.list_(pa.int64())), ("around", pa.binary()), ("n", pa.binary())])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([joint], fields.field(1).type), pa.array([None], pa.binary()),
                                      pa.array([None], pa.binary())], schema=fields)
    found = np.flatnonzero(around)
    if len(found):
        group = found // (GROUP * 3 * size)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        cuts = np.append(first, len(found))
        yield pa.RecordBatch.from_arrays([pa.array(group[first], pa.int32()), pa.nulls(len(first), fields.field(1).type),
                                          _binary((found % (GROUP * 3 * size)).astype(np.int32), cuts),
                                          _binary(around[found], cuts)], schema=fields)


def _exchange(batches: Iterator[pa.RecordBatch], joint: np.ndarray, classes: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    """Units that gain by moving (unit, class), by the rows (group, around, n) of their groups."""
    logs, size = _xlogx(joint), len(joint)
    groups: dict[int, np.ndarray] = {}  # at most as many as all units have
    for batch in batches:
        for i, group in enumerate(batch.column(0).to_pylist()):
            if group not in groups:
                groups[group] = np.zeros(GROUP * 3 * size)
            groups[group][_numbers(batch.column(1).slice(i, 1), np.int32)] += _numbers(batch.column(2).slice(i, 1), np.int64)
    for group, around in groups.items():
        moved: list[tuple[int, int]] = []
        sides = around.reshape(GROUP, 3, size)
        for place in np.flatnonzero(sides.any((1, 2))).tolist():
            unit = (group * GROUP + place) * PARTS + part
            own = int(classes[unit])
            right, left, itself = sides[place, 0], sides[place, 1], sides[place, 2].sum()
            right[own] -= itself
            left[own] -= itself
            gain = gains(joint, own, right, left, itself, logs)
            best = 1 + int(np.argmax(gain[1:]))
            if gain[best] > gain[own] + 1e-9:
                moved.append((unit, best))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in moved], pa.int32()), pa.array([c for _, c in moved], pa.int32())],
                                         ["unit", "class"])


def _around(pairs: DataFrame, classes: np.ndarray, size: int, part: int | None) -> DataFrame:
    """Stored rows of ``_surroundings`` of blocks of pairs: bounded by the units and classes for each task."""
    return stored(pairs.mapInArrow(partial(_surroundings, classes=classes.astype(np.int32), size=size, part=part),
                                   "group int, joint array<long>, around binary, n binary"), "brown-around")


def _joint(around: DataFrame, size: int) -> np.ndarray:
    joint = np.zeros(size * size)
    cells = around.where("joint is not null").select(F.posexplode("joint").alias("cell", "n"))
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 0").collect():  # at most size ** 2 rows
        joint[r["cell"]] = r["n"]
    return joint.reshape(size, size)


def exchange(pairs: DataFrame, classes: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes by unit and their counts, from blocks of pairs. A round moves a part of the units at once, by the counts before it;
    one that lowers the likelihood is taken back. Each round reads the pairs once."""
    kept: tuple[np.ndarray, np.ndarray] | None = None
    for turn in range(rounds + 1):
        around = _around(pairs, classes, size, turn % PARTS if turn < rounds else None)
        joint = _joint(around, size)
        if kept is not None and likelihood(joint) <= likelihood(kept[1]):
            classes, joint = kept  # taken back
            if turn < rounds:
                around = _around(pairs, classes, size, turn % PARTS)
        if turn == rounds:
            break
        kept = classes, joint
        moves = (around.where("group is not null").select("group", "around", "n").repartition("group")
                 .mapInArrow(partial(_exchange, joint=joint, classes=classes.astype(np.int32), part=turn % PARTS), "unit int, class int")
                 .toArrow())  # one row per unit at most
        classes = classes.copy()
        classes[moves.column("unit").to_numpy()] = moves.column("class").to_numpy()
    return classes, joint


def cluster(pairs: DataFrame, classes: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``exchange`` over rows of pairs (a, b, n)."""
    return exchange(blocks(pairs.mapInArrow(_dealt, "part int, pairs binary, n binary")), classes, size, rounds)


def discount(ones: float, twos: float) -> float:
    """Absolute discount from how many counts are 1 and 2."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def transitions(joint: np.ndarray) -> np.ndarray:
    """Probabilities of the next class, by class: absolute discounting, interpolated with the classes' own probabilities."""
    own = (joint.sum(0) + 1) / (joint.sum() + len(joint))
    d = discount(float((joint == 1).sum()), float((joint == 2).sum()))
    total = joint.sum(1, keepdims=True)
    cut = np.minimum(joint, d)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, (joint - cut) / total + cut.sum(1, keepdims=True) / total * own, own)


@dataclass
class Model:
    """train_tokens and distinct counts of the training text, classes of shapes, transitions, unseen (probability of a class's
    words that training never saw), and tables: lexicon (word, c, emission: of training words) and cached (word, class, c)."""

    train_tokens: int
    distinct: int
    end: int
    shape_class: np.ndarray
    transitions: np.ndarray
    unseen: np.ndarray
    share: float
    totals: np.ndarray
    lexicon: DataFrame
    cached: pa.Table
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def _class_column(units: DataFrame, classes: np.ndarray, vocabulary: DataFrame, spark: SparkSession) -> DataFrame:
    """Add class and unit to words: their own if they are units, else their shape's."""
    table = spark.createDataFrame(pa.table({"shape": np.arange(SHAPES, dtype=np.int32), "of_shape": classes[1:1 + SHAPES].astype(np.int32)}))
    return (vocabulary.join(F.broadcast(units), "word", "left").join(F.broadcast(table), "shape")
            .withColumn("class", F.coalesce("own", "of_shape")).withColumn("unit", F.col("own").isNotNull()).drop("own", "of_shape"))


def fit(docs: DataFrame, train: Column, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """A model of the rows of (text) for which ``train`` holds; the vocabulary's ``n`` counts all rows."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("trained"))
    vocabulary = stored(rows.mapInArrow(_vocabulary, "word binary, shape int, n long, c long").groupBy("word", "shape")
                        .agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "brown-vocabulary")
    end = rows.where("trained").count()
    known = vocabulary.where("c > 0").agg(F.count("*").alias("words"), F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("ones"),
                                          F.count_if(F.col("c") == 2).alias("twos")).first()
    top = vocabulary.where(frequent(vocabulary, "c", UNITS)).select("word", "c").toArrow()
    top = top.sort_by([("c", "descending"), ("word", "ascending")])
    words = top.column("word").to_pylist()
    of = np.full(1 + SHAPES + len(words), classes)
    of[0] = 0
    own = min(classes - 1, len(words))
    of[1 + SHAPES:1 + SHAPES + own] = np.arange(1, own + 1)
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(words)
    pairs = blocks(rows.where("trained").select("text").mapInArrow(partial(_pairs, name=name, words=shared), "part int, pairs binary, n binary"))
    of, joint = exchange(pairs, of, classes + 1, rounds)
    shared.destroy()  # its pairs are written
    units = spark.createDataFrame(pa.table({"word": pa.array(words, pa.binary()), "own": of[1 + SHAPES:].astype(np.int32)}),
                                  "word binary, own int")
    worded = _class_column(units, of, vocabulary, spark)
    share = discount(known["ones"], known["twos"])
    kinds = np.zeros(classes + 1)
    for r in worded.where("c > 0").groupBy("class").count().collect():  # a row per class
        kinds[r["class"]] = r["count"]
    totals = joint.sum(0)
    unseen = np.where(totals > 0, share * kinds / np.maximum(totals, 1), 1.0)
    table = stored(worded, "brown-words")
    cached = table.where(F.col("unit") | frequent(vocabulary, "n", CACHED)).select("word", "class", "c").toArrow()
    return Model((known["tokens"] or 0) + end, known["words"] + (end > 0), end, of[1:1 + SHAPES], transitions(joint), unseen, share, totals,
                 table.where("c > 0").select("word", "class", "c"), cached)


def _parts(x: np.ndarray) -> np.ndarray:
    return np.round(np.log10(x) * UNIT).astype(np.int64)


class Scorer:
    """Sums of a text's cached words and of its class transitions, and its other words."""

    def __init__(self, cached: pa.Table, model: dict):
        words, self.c = cached.column("word").to_pylist(), cached.column("c").to_numpy()
        self.numbers = dict(zip(words, range(len(words))))
        of = cached.column("class").to_numpy()
        self.classes = np.concatenate([of, model["shape_class"][::-1]])  # -1 - shape counts from the end
        totals, unseen = model["totals"], model["unseen"]
        known = np.where(self.c > 0, (self.c - model["share"]) / np.maximum(totals[of], 1), unseen[of])
        self.emission = np.concatenate([_parts(known), _parts(unseen[model["shape_class"]])[::-1]])
        self.base = np.concatenate([_parts(self.c + 1.0), np.zeros(SHAPES, np.int64)])
        self.known = np.concatenate([self.c > 0, np.zeros(SHAPES, bool)])
        self.next = _parts(model["transitions"])

    def __call__(self, texts: pa.Array, kind: pa.ListType) -> list[pa.Array]:
        """n_tokens, known, base, total and rest (of the type ``kind``) of texts."""
        at, counts, words = words_of(texts)
        (place, starts), mine = places(counts), numbered(words, self.numbers)[at]

        def sums(x: np.ndarray, pairs: np.ndarray | int = 0) -> pa.Array:
            row = np.zeros(len(at) + len(counts), np.int64)
            row[place - 1] = x
            return pa.array(np.add.reduceat(row + pairs, starts))  # every text has a pair

        of = np.zeros(len(at) + len(counts) + 1, np.int64)
        of[place] = self.classes[mine]
        others = np.flatnonzero(mine < 0)
        text = np.repeat(np.arange(len(counts)), counts)
        code, times = np.unique(text[others] << 32 | at[others], return_counts=True)
        found = pa.StructArray.from_arrays([words.take(pa.array(code & (1 << 32) - 1)), pa.array(times, pa.int64())],
                                           fields=list(kind.value_type))
        ends = np.searchsorted(code >> 32, np.arange(len(counts) + 1)).astype(np.int32)
        return [pa.array(counts + 1), sums(self.known[mine]), sums(self.base[mine]),
                sums(self.emission[mine], self.next[of[:-1], of[1:]]), pa.ListArray.from_arrays(pa.array(ends), found, type=kind)]


def _score(batches: Iterator[pa.RecordBatch], name: str, cached, model: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scorer = held(("brown", name), lambda: Scorer(cached.value, model))
    for part in pieces(batches):
        yield pa.RecordBatch.from_arrays([*part.columns[1:], *scorer(part.column(0), schema.field("rest").type)], schema=schema)


def score(docs: DataFrame, model: Model, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of every row's whole text.

    A text's tokens are its words (A-Z in lower case) and one end. base_score: add-one word probabilities, one place left for
    unseen words; score: the class model's, from the end of a text before to its own end; both are sums of decimal
    logarithms. Null and empty texts have one token. Repeated rows and null ids stay rows of their own; an empty
    table gives no rows; without training text all words are unseen and every class is equally likely.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [f"keep{i}" for i in range(len(keep))]
    source = docs.select(F.col("text").cast("string").alias("text"), *[c.alias(n) for n, c in zip(kept, keep.values())])
    fields = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in kept),
                        "n_tokens long, known long, base long, total long, rest array<struct<word: binary, times: long>>"])
    schema = to_arrow_schema(StructType.fromDDL(fields))
    cached = spark.sparkContext.broadcast(model.cached)
    small = {"shape_class": model.shape_class, "transitions": model.transitions, "unseen": model.unseen, "share": model.share, "totals": model.totals}
    rows = stored(source.mapInArrow(partial(_score, name=model.name, cached=cached, model=small, schema=schema), fields)
                  .withColumn("row", F.monotonically_increasing_id()), "brown-rows")
    cached.destroy()  # the rows are written
    tables = spark.createDataFrame([(i, float(t), float(u)) for i, (t, u) in enumerate(zip(model.totals, model.unseen))],
                                   "class int, of_class double, unseen double")
    # words beyond the broadcast ones count as unseen above; here those of the training text get their own figures
    more = F.round(F.log10((F.col("c") - model.share) / F.col("of_class")) * UNIT) - F.round(F.log10("unseen") * UNIT)
    lexicon = model.lexicon.join(F.broadcast(tables), "class").select(
        "word", F.round(F.log10(F.col("c") + 1.0) * UNIT).cast("long").alias("b"), more.cast("long").alias("e"))
    others = (rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.times").join(lexicon, "word").groupBy("row")
              .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.col("b")).alias("b"), F.sum(F.col("times") * F.col("e")).alias("e")))
    zero = F.lit(0).cast("long")
    whole = float(np.log10(model.train_tokens + model.distinct + 1))
    joined = rows.drop("rest").join(others, "row", "left")
    return joined.select(
        *[F.col(n).alias(c) for n, c in zip(kept, keep)], "n_tokens",
        (F.col("known") + F.coalesce("more", zero) + F.lit(int(model.end > 0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + F.coalesce("b", zero)) / UNIT + F.lit(float(np.log10(model.end + 1))) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        ((F.col("total") + F.coalesce("e", zero)) / UNIT).alias("score"))


def held_out() -> Column:
    """Documents that the registered query does not learn from; a null doc_id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
