"""SimHash against a plain all-pairs version."""

import random

import numpy as np
import pytest
import xxhash

from modelwatch.llm import simhash
from modelwatch.llm.graph import components
from tests.llm.cases import awkward, empty, table


def _fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(codes, distance):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def _expected(rows):
    codes = [_fingerprint(t) for _, t in rows]
    classes = _classes(codes, 3)
    least = {}
    for (i, _), c in zip(rows, classes):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted((str(i), f, str(least[c])) for (i, _), f, c in zip(rows, codes, classes))


def _check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), r["fp"] % 2 ** 64, str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == _expected(rows)


def _near_copies(n, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            words = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = rnd.choices(vocabulary, k=rnd.randint(1, 120))
        texts.append(" ".join(words))
    return texts


def test_near_copies(spark):
    _check(table(spark, _near_copies(250)))


def test_awkward_and_empty(spark):
    _check(awkward(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_index_finds_all_links(monkeypatch, distance):
    monkeypatch.setattr(simhash, "STEP_PAIRS", 200)
    rng = np.random.default_rng(distance)
    codes = rng.integers(0, 2 ** 64, 300, np.uint64)
    near = codes[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64))
    codes = np.unique(np.concatenate([codes, near, np.arange(40, dtype=np.uint64)]))
    starts = np.array([0, 7, 8, 100, 101, 102, 350])
    root = simhash.link(codes, starts, distance)
    for a, b in zip(starts, [*starts[1:], len(codes)]):
        assert (root[a:b] - a).tolist() == _classes([int(c) for c in codes[a:b]], distance)


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "KEY_ROWS", 3)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 62, 6)
    codes = sorted({int(b) ^ int(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False)) % 2 ** 63)
                    for b in base for _ in range(40)})
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    found = {r["node"]: r["root"] for r in components(simhash.similar(df, 3)).collect()}
    classes = _classes(codes, 3)
    assert [found.get(c, c) for c in codes] == [codes[i] for i in classes]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (101, 100)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(edges.where("a > 1000")).count() == 0


def test_one_of_each_keeps_one_row_of_a_group(spark):
    docs = awkward(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = len({(r["root"]) for r in simhash.near_duplicates(docs).collect()})
    assert kept.count() == groups
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 14").count() == 0
    assert simhash.one_of_each(empty(spark)).count() == 0
