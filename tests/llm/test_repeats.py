"""Repeated strings against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from modelwatch.llm import repeats
from tests.llm.cases import awkward, empty, table


def _marked(raws, length, order=None):
    """Per text the bytes covered by a window that occurs elsewhere (order: that occurred earlier in it)."""
    times, seen = Counter(), set()
    for raw in raws:
        times.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    marks = {}
    for i in order or range(len(raws)):
        raw = raws[i]
        mark = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            window = raw[k:k + length]
            if (window in seen) if order else times[window] > 1:
                mark[k:k + length] = True
            seen.add(window)
        marks[i] = mark
    return [marks[i] for i in range(len(raws))]


def _expected(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), raw, mark in zip(rows, raws, _marked(raws, length)):
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        runs = int((np.diff(np.append(False, mark).astype(int)) == 1).sum())
        out.append(str((i, len(raw), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def _texts(n, seed=2):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "béta", "g", "delta ", "eps\n", "漢字", "zz"]
    shared = ["".join(rnd.choices(vocabulary, k=40)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = ["".join(rnd.choices(vocabulary, k=rnd.randint(0, 25)))]
        if rnd.random() < 0.6:
            s = rnd.choice(shared)
            parts += [s[rnd.randint(0, 20):], "".join(rnd.choices(vocabulary, k=rnd.randint(0, 9)))]
        out.append("".join(parts))
    return out + ["ab" * 150, "ab" * 150, "c" * 400, shared[0] + "x" + shared[0]]


def _got(docs, **kw):
    rows = repeats.remove_repeats(docs, **kw).collect()
    return sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in rows)


@pytest.mark.parametrize("hot", [1500, 6, 1])
def test_equals_counting(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_FRAGMENTS", hot)  # 6: some anchors are split; 1: all, down to single windows
    texts = _texts(60)
    assert _got(table(spark, texts), length=60) == _expected(list(enumerate(texts)), 60)


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 0)
    texts = _texts(30, 5)
    assert _got(table(spark, texts), length=60) == _expected(list(enumerate(texts)), 60)


def test_long_texts_in_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 1024)
    repeats._powers.cache_clear()
    raw = "".join(_texts(60, 8)).encode()
    runs = repeats.anchors(raw, 60)
    windows = [w for lo, hi, _, _ in runs.tolist() for w in range(lo, hi + 1)]
    assert windows == list(range(len(raw) - 59))
    repeats._powers.cache_clear()


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], (r["text"] or "")[:3000]) for r in docs.select("doc_id", "text").collect()]
    assert _got(table(spark, [t for _, t in rows], [i for i, _ in rows]), length=200) == _expected(rows, 200)
    whole = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert whole[8]["n_removed"] == whole[8]["n_bytes"] > 200_000 and whole[7]["n_spans"] == 1
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_keep_first_leaves_one_copy(spark):
    texts = _texts(40, 11)
    docs = table(spark, texts).coalesce(1)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs, length=60, keep_first=True).collect()}
    marks = _marked([t.encode() for t in texts], 60, order=range(len(texts)))
    first_of = {}
    for i, (t, mark) in enumerate(zip(texts, marks)):
        twin = first_of.setdefault(t, i)
        want = bytes(b for b, m in zip(t.encode(), marks[i]) if not m)
        if twin == i:
            assert kept[i] == want


@pytest.mark.parametrize("hot", [20, 1])
def test_keep_first_in_split_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_FRAGMENTS", hot)
    texts = _near_copies(60, 3)
    docs = table(spark, texts).coalesce(1)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs, length=100, keep_first=True).collect()}
    for i, (t, mark) in enumerate(zip(texts, _marked([t.encode() for t in texts], 100, order=range(len(texts))))):
        assert kept[i] == bytes(b for b, m in zip(t.encode(), mark) if not m)


def _near_copies(n, seed):
    """Copies of one text, each with a few words changed."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(80)]
    out = []
    for i in range(n):
        mine = list(words)
        for _ in range(rnd.randint(1, 3)):
            mine[rnd.randrange(len(mine))] = f"n{i}x{rnd.randrange(3)}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize("copies", [300, 600])
def test_near_copies_around_the_bound(spark, monkeypatch, copies):
    monkeypatch.setattr(repeats, "HOT_FRAGMENTS", 40)  # well below the different fragments of an anchor
    texts = _near_copies(copies, copies)
    assert _got(table(spark, texts), length=100) == _expected(list(enumerate(texts)), 100)


def test_subfragments_hold_every_window_once():
    rnd = random.Random(4)
    for level in (1, 2, repeats.SPLITS, repeats.SPLITS + 1):
        raw = bytes(rnd.choices(b"abc", k=300))
        runs = repeats.subfragments(raw, 60, level)
        assert [w for lo, hi, _, _ in runs for w in range(lo, hi + 1)] == list(range(241))


def test_longest_factors():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.integers(97, 99, (rng.integers(1, 25), 6)).astype(np.uint8)
        same = [[int(np.argmin(np.append(a == b, False))) for b in w] for a in w]
        earlier, later = repeats.longest_factors(w)
        assert earlier.tolist() == [max(same[i][:i], default=0) for i in range(len(w))]
        assert later.tolist() == [max(same[i][i + 1:], default=0) for i in range(len(w))]
