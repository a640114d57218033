"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from modelwatch.llm import lexical
from tests.llm.cases import awkward, empty, table

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))


def _expected(docs, items, k):
    found = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in found:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in _terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [str((item, r, x[3], -x[0])) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _got(docs, items, k):
    return sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in lexical.search(docs, items, k).collect())


def _texts(n, seed):
    rnd = random.Random(seed)
    words = ["the", "of", "And", "Ünï", "漢字", *(f"w{i}" for i in range(200))]
    return [" ".join(rnd.choices(words, weights=[60, 40, 30, 10, 5] + [200 / (i + 3) for i in range(200)], k=rnd.choice([1, 5, 30, 200, 900])))
            for _ in range(n)]


@pytest.mark.parametrize("first,items_of_a_pass", [(64, 1000), (2, 3)])
def test_equals_scoring_everything(spark, monkeypatch, first, items_of_a_pass):
    monkeypatch.setattr(lexical, "PASS_ITEMS", items_of_a_pass)    # several passes
    texts = _texts(150, 1) + ["the the w1", "The THE w1", "the, the. w1!"] * 30     # ties, whole groups of them
    items = list(enumerate(_texts(8, 2) + ["the the of", "", None, "nothing of this kind", "zzz"]))
    assert _got(table(spark, texts), _items(spark, items), 5) == _expected(list(enumerate(texts)), items, 5)


def test_awkward_rows_and_repeated_items(spark):
    docs = awkward(spark).withColumnRenamed("item_id", "bound")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = [(1, "a plain text with word"), (1, "a plain text with word"), (None, "other words, again"), (3, None), (4, "1 2 3 x")]
    assert _got(docs, _items(spark, items), 3) == _expected(rows, items, 3)
    assert lexical.search(empty(spark), _items(spark, items)).count() == 0
    none = lexical.search(docs, _items(spark, []))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_never_below_scores():
    import pyarrow as pa

    rnd = random.Random(3)
    texts = _texts(60, 4) + [" ".join(["deep"] * n) for n in (1, 2, 3, 4, 7, 8, 12, 13, 24, 63, 64, 1000)]
    found = [Counter(_terms(t)) for t in texts]
    total = sum(sum(c.values()) for c in found)
    batch = pa.record_batch([pa.array([b"%d" % i for i in range(len(texts))], pa.binary()), pa.array(texts)], names=["key", "text"])
    query = [(0, b"the", 1, 500), (0, b"w3", 2, 4000), (0, b"deep", 1, 9000), (1, b"absent", 1, 9000)]
    q = lexical.Queries(pa.table({"item": [x[0] for x in query], "term": [x[1] for x in query], "times": [x[2] for x in query], "w": [x[3] for x in query]}))
    seen = 0
    for out in lexical._index(iter([batch])):
        for keys, ns, bits, slices in zip(*(out.column(c).to_pylist() for c in ("keys", "ns", "bits", "slices"))):
            if bits is None:
                continue
            bounds = list(q.bounds(bits, slices, np.array(ns), len(texts), total))
            for j, key in enumerate(keys):
                c = found[int(key)]
                m = 75 + 25 * sum(c.values()) * len(texts) // total
                exact = sum(w * n * (10 ** 9 * c[t.decode()] // (1000 * c[t.decode()] + 12 * m)) for i, t, n, w in query if i == 0)
                assert bounds[0][j] >= exact
                seen += 1
    assert seen == len(texts)
