"""Class-based scores against plain counting, and exchange against recomputed likelihoods."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modelwatch.llm import brown
from tests.llm.cases import awkward, empty, table

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TRAIN = lambda: F.col("doc_id").isNotNull() & ~brown.held_out()


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW)) + [None]


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def _texts(n, seed):
    """Sentences of determiner, noun and verb, so that classes help."""
    rnd = random.Random(seed)
    nouns, verbs = [f"noun{i}ka" for i in range(30)], [f"verb{i}et" for i in range(30)]
    say = lambda: f"{rnd.choice(['The', 'a'])} {rnd.choice(nouns)} {rnd.choice(verbs)}"
    return [" ".join(say() for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def _rows(docs, model):
    return brown.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": brown.held_out()}).collect()


@pytest.mark.parametrize("cached", [1 << 17, 0])
def test_equals_plain_sums(spark, monkeypatch, cached):
    monkeypatch.setattr(brown, "CACHED", cached)
    monkeypatch.setattr(brown, "UNITS", 20)          # most words go by shape, and through the join
    texts = _texts(120, 1) + ["", None, "unseen words ÜBER x" * 3]
    docs = table(spark, texts)
    model = brown.fit(docs, TRAIN(), classes=6, rounds=4)
    count = Counter(t for i, x in enumerate(texts) if not _held(i) for t in _tokens(x))
    total, distinct = sum(count.values()), len(count)
    assert (model.train_tokens, model.distinct) == (total, distinct)
    units = {r["word"]: r["class"] for r in model.cached.to_pylist()} | {r["word"]: r["class"] for r in model.lexicon.collect()}
    units = {bytes(w).decode(): c for w, c in units.items()}
    for r in _rows(docs, model):
        words = _tokens(texts[r["doc_id"]])
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)
        known = sum(count[w] > 0 for w in words)
        score, before = 0.0, 0
        for w in words:
            of = 0 if w is None else units.get(w, model.shape_class[brown.shape(w.encode())])
            share = 1.0 if w is None else (count[w] - model.share) / model.totals[of] if count[w] else model.unseen[of]
            score += math.log10(model.transitions[before, of]) + math.log10(share)
            before = of
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (_held(r["doc_id"]), len(words), known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-7) and r["score"] == pytest.approx(score, abs=1e-7)


def test_probabilities_add_up_and_classes_help_on_held_out_text(spark):
    docs = table(spark, _texts(300, 2))
    model = brown.fit(docs, TRAIN(), classes=8, rounds=6)
    assert np.allclose(model.transitions.sum(1), 1)
    mass = model.unseen.copy()
    for r in model.lexicon.collect():
        mass[r["class"]] += (r["c"] - model.share) / model.totals[r["class"]]
    assert np.allclose(mass[1:][model.totals[1:] > 0], 1)
    held = [r for r in _rows(docs, model) if r["held_out"]]
    assert sum(r["score"] for r in held) / sum(r["base_score"] for r in held) < 0.9
    # nouns and verbs are apart
    kinds = {}
    for r in model.lexicon.collect():
        kinds.setdefault(bytes(r["word"])[:4].decode(), set()).add(r["class"])
    assert not kinds["noun"] & kinds["verb"]


def test_gains_are_changes_of_the_likelihood():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, size = int(rng.integers(4, 9)), 4
        pairs = rng.integers(0, 4, (n, n)) * rng.integers(0, 2, (n, n))
        of = np.append(0, rng.integers(1, size, n - 1))

        def joint(of):
            out = np.zeros((size, size))
            np.add.at(out, (of[:, None].repeat(n, 1), of[None].repeat(n, 0)), pairs)
            return out

        unit = int(rng.integers(1, n))
        right, left = np.zeros(size), np.zeros(size)
        others = np.arange(n) != unit
        np.add.at(right, of[others], pairs[unit, others])
        np.add.at(left, of[others], pairs[others, unit])
        gain = brown.gains(joint(of), of[unit], right, left, float(pairs[unit, unit]))
        moved = []
        for c in range(1, size):
            there = of.copy()
            there[unit] = c
            moved.append(brown.likelihood(joint(there)))
        assert np.allclose(np.diff(moved), np.diff(gain[1:]), atol=1e-6)


def test_every_round_keeps_or_raises_the_likelihood(spark):
    texts = _texts(60, 7)
    count = Counter((a, b) for x in texts for a, b in zip(["", *x.split()], [*x.split(), ""]))
    number = {w: i for i, w in enumerate(["", *sorted({w for p in count for w in p} - {""})])}
    pairs = spark.createDataFrame([(number[a], number[b], n) for (a, b), n in count.items()], "a int, b int, n long")
    start = np.append(0, 1 + np.arange(len(number) - 1) % 5)
    before = None
    for rounds in range(4):
        of, joint = brown.cluster(pairs, start, 6, rounds)
        plain = np.zeros((6, 6))
        for (a, b), n in count.items():
            plain[of[number[a]], of[number[b]]] += n
        assert (plain == joint).all() and of[0] == 0 and of[1:].min() >= 1
        assert before is None or brown.likelihood(joint) >= before - 1e-9
        before = brown.likelihood(joint)


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = _rows(docs, brown.fit(docs, TRAIN()))
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(str((i, len(_tokens(t)))) for i, t in plain) == sorted(str((r["doc_id"], r["n_tokens"])) for r in rows)
    assert all(r["score"] < 0 and r["base_score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert _rows(empty(spark), brown.fit(empty(spark), TRAIN())) == []
    untrained = brown.fit(docs, F.lit(False))
    assert untrained.train_tokens == 0 and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in _rows(docs, untrained))


def test_rounds_store_rows_by_unit_group_not_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cells = [(int(a), int(b), int(n)) for (a, b), n in np.ndenumerate(rng.integers(0, 3, (120, 120))) if n]
    sizes = []
    real = brown.stored

    def counting(df, name):
        out = real(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(brown, "stored", counting)
    start = np.append(0, 1 + np.arange(119) % 5)
    of, joint = brown.cluster(spark.createDataFrame(cells, "a int, b int, n long"), start, 6, 4)
    assert [n for n, _ in sizes].count("brown-around") >= 5
    assert sum(n for _, n in sizes) < len(cells) / 10  # a row for every pair, or for every unit and class, is more
    plain = np.zeros((6, 6))
    for a, b, n in cells:
        plain[of[a], of[b]] += n
    assert (plain == joint).all() and brown.likelihood(joint) > brown.likelihood(_joint_of(cells, start))


def _joint_of(cells, of):
    joint = np.zeros((6, 6))
    for a, b, n in cells:
        joint[of[a], of[b]] += n
    return joint


def test_words_of_texts_are_those_of_the_pattern():
    rnd = random.Random(9)
    signs = [chr(i) for i in range(256)] + [" ", " ", "　", "İ", "Z", " ", " ", "\n"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 90))) for _ in range(300)] + ["", None, " ", "x" * 60 + " y"]
    cut = [p for b in (pa.array(texts[:150]), pa.array([], pa.string()), pa.array(texts[150:]))
           for p in brown.pieces(iter([pa.RecordBatch.from_arrays([b], ["text"])]))]
    found = []
    for batch in cut:
        at, counts, words = brown.words_of(batch.column(0))
        words, ends = words.to_pylist(), np.cumsum(counts)
        found += [[words[i] for i in at[e - n:e]] for e, n in zip(ends, counts)]
    assert len(found) == len(texts)
    for text, got in zip(texts, found):
        want = [w.encode() for w in _tokens(text)[:-1]]
        assert [w for w in got if not w.startswith(b"long word ")] == [w for w in want if len(w) <= brown.LONGEST] and len(got) == len(want)


def test_pairs_are_merged_and_surroundings_summed_in_small_pieces(monkeypatch):
    for name, value in (("HELD_PAIRS", 40), ("ROW", 5), ("ROWS", 3), ("DEALT", 8), ("GROUP", 4)):
        monkeypatch.setattr(brown, name, value)
    rng = np.random.default_rng(11)
    units, size, part = 50, 5, 1
    of = np.append(0, rng.integers(1, size, units - 1))
    plain, dealt = np.zeros((units, units), np.int64), []
    for _ in range(20):
        a, b, n = rng.integers(0, units, 60), rng.integers(0, units, 60), rng.integers(1, 9, 60)
        np.add.at(plain, (a, b), n)
        dealt += brown._dealt(iter([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])]))
    rows = pa.Table.from_batches(dealt).sort_by("part")
    merged = list(brown._merged(iter(rows.to_batches(max_chunksize=7))))
    code = np.concatenate([brown._numbers(m.column(0), np.int64) for m in merged])
    n = np.concatenate([brown._numbers(m.column(1), np.int64) for m in merged])
    a, b = brown._decoded(code)
    assert len(code) == (plain > 0).sum() and (plain[a, b] == n).all()
    found = list(brown._surroundings(iter(merged), of, size, part))
    joint = np.zeros((size, size))
    np.add.at(joint, (of[:, None].repeat(units, 1), of[None].repeat(units, 0)), plain)
    assert (np.array(found[0].column(1)[0].as_py()).reshape(size, size) == joint).all()
    groups = found[1].select(["group", "around", "n"])
    moved = {u: c for m in brown._exchange(iter([groups.slice(0, 2), groups.slice(2)]), joint, of, part)
             for u, c in zip(m.column(0).to_pylist(), m.column(1).to_pylist())}
    for unit in range(units):
        right, left, others = np.zeros(size), np.zeros(size), np.arange(units) != unit
        np.add.at(right, of[others], plain[unit, others])
        np.add.at(left, of[others], plain[others, unit])
        gain = brown.gains(joint, of[unit], right, left, float(plain[unit, unit]))
        best = 1 + int(np.argmax(gain[1:]))
        goes = unit % brown.PARTS == part and gain[best] > gain[of[unit]] + 1e-9
        assert moved.get(unit) == (best if goes else None)
