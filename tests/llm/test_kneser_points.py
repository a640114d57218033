"""The Kneser-Ney classifier over code points."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from modelwatch.llm import kneser, kneser_points
from modelwatch.llm.common import text_key
from tests.llm.cases import AWKWARD, awkward, empty, table


def _symbols(text):
    return [0] * (kneser_points.ORDER - 1) + [ord(c) + 1 for c in text]


def _plain_model(texts):
    """Interpolated modified Kneser-Ney by the textbook, every code point a symbol."""
    order = kneser_points.ORDER
    counts = [None] * (order + 1)
    counts[order] = Counter(tuple(s[i:i + order]) for s in map(_symbols, texts) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = [None] + [kneser_points.discounts(Counter(counts[n].values())) for n in range(1, order + 1)]
    after = [None] + [defaultdict(list) for _ in range(order)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            after[n][g[:-1]].append(c)

    def p(history, symbol):
        n = len(history) + 1
        lower = p(history[1:], symbol) if n > 1 else 1 / kneser_points.LEAST_SYMBOLS
        seen = after[n].get(history)
        if not seen:
            return lower
        cut = lambda c: cuts[n][min(c, 3) - 1] if c else 0.0
        c = counts[n].get((*history, symbol), 0)
        return (c - cut(c) + sum(map(cut, seen)) * lower) / sum(seen)

    return p


def _texts():
    rnd = random.Random(3)
    return ["".join(rnd.choices("abc de,\nÉé!1漢字語жщ\U0001f642", k=rnd.randint(1, 120))) for _ in range(60)]


def _folds(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["fold"] for r in rows.select("i", kneser_points.fold_of(text_key()).alias("fold")).orderBy("i").collect()]


def test_perplexity_equals_the_textbook_of_the_other_folds(spark, monkeypatch):
    texts = _texts()
    texts[5] = texts[4]  # copies
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    folds, k = _folds(spark, texts), kneser_points.ORDER - 1
    trusted = [i for i in range(60) if i % 3 and i % 7]
    assert set(folds) == set(range(kneser_points.FOLDS)) and folds[4] == folds[5]
    models = [_plain_model([texts[i] for i in trusted if folds[i] != f]) for f in range(kneser_points.FOLDS)]
    entropy = [-sum(math.log(models[f](tuple(s[i - k:i]), s[i])) for i in range(k, len(s))) / (len(s) - k)
               for f, s in zip(folds, map(_symbols, texts))]
    bins = sorted(math.ceil(round(entropy[i] * 1000, 2)) for i in trusted)
    most = bins[min(math.ceil((len(bins) + 1) * kneser.QUANTILE), len(bins)) - 1] / 1000
    for cached in (20, 1 << 16):  # most n-grams joined, and all broadcast
        monkeypatch.setattr(kneser_points, "CACHED", cached)
        got = {r["doc_id"]: r for r in kneser.classify(table(spark, texts), labels).collect()}
        assert np.allclose([got[i]["perplexity"] for i in range(60)], np.exp(entropy), rtol=1e-5)
        assert abs(math.log(got[0]["threshold"]) - most) < 0.003
        assert all(got[i]["kept"] == (got[i]["perplexity"] <= got[i]["threshold"]) for i in range(60))


def test_a_text_is_not_judged_by_counts_of_itself(spark):
    """Copies of an odd text are all trusted; its perplexity is that of a text that nobody has seen."""
    texts = _texts() + ["Q7 zx" * 9] * 20
    few = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    every = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    unseen, counted = ({r["doc_id"]: r["perplexity"] for r in kneser.classify(table(spark, texts), x).collect()} for x in (few, every))
    assert np.allclose(unseen[60], counted[60]) and len({counted[i] for i in range(60, 80)}) == 1


def test_letters_outside_latin_are_told_apart(spark):
    """All of these are one class of the folded table, so a model of it cannot see the difference."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("漢字語文", k=80)) for _ in range(60)] + ["".join(rnd.choices("жщюя", k=80)) for _ in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in kneser.classify(table(spark, texts), labels).collect()}
    assert sum(kept[i] for i in range(60)) >= 59 and not any(kept[i] for i in range(60, 65))


def test_ngrams_of_pieces_and_many_symbols(monkeypatch):
    text = "".join(map(chr, range(32, 0xd800))) + "\U0001f642ab" * 3
    s = _symbols(text)
    want = Counter(tuple(s[i:i + 4]) for i in range(len(s) - 3))
    for piece in (1 << 14, 7):
        monkeypatch.setattr(kneser_points, "_PIECE", piece)
        got = Counter()
        for h, last, n in kneser_points.distinct(list(kneser_points.pieces(text))):
            for a, b, c in zip(h.tolist(), last.tolist(), n.tolist()):
                got[(a >> 42, a >> 21 & 0x1fffff, a & 0x1fffff, b)] += c
        assert got == want


def test_code_points_of_awkward_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (6, None, 0), (None, 1, 0), (8, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = kneser.classify(awkward(spark), labels, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(AWKWARD)
    assert all((r["perplexity"] is None and not r["kept"]) == (not r["text"]) for r in rows)
    assert kneser.classify(empty(spark), labels).count() == 0


def test_thresholds_by_length_without_a_factor(spark):
    """Short texts scatter and long ones do not: each length class has its own quantiles, and nothing is added to them."""
    rows = [("en", 0.5 + i / 1000, 20) for i in range(1000)] + [("en", 1.0 + i / 10000, 2000) for i in range(1000)]
    rows += [("de", 3.0, 2000), (None, 3.0, 20)]
    scored = spark.createDataFrame(rows, "lang string, __entropy double, __chars int")
    got = {(r["__lang"], r["__band"]): (r["__most"], r["__least"]) for r in kneser._thresholds(scored, 0.995).collect()}
    assert ("de", 10) not in got  # too few documents
    assert np.allclose(got["en", 4], (1.495, 0.501)) and np.allclose(got["en", 10], (1.1, 1.0), atol=0.0011)
    assert np.allclose(got["", -1], (1.492, 0.503), atol=0.006)


def test_abnormally_predictable_text_goes(spark):
    """A common word over and over lies below the lower quantile; ordinary text between the quantiles stays."""
    rnd = random.Random(5)
    words = ["the"] * 12 + ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(40)]
    texts = [" ".join(rnd.choices(words, k=12)) for _ in range(599)] + ["the " * 14] * 2
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in kneser.classify(table(spark, texts), labels).collect()}
    assert not kept[599] and not kept[600] and sum(kept[i] for i in range(599)) >= 590
