"""Manifests against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from modelwatch.llm import merkle, queries
from tests.llm.cases import awkward, empty, table

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def _enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(leaves):
    """Root, and per leaf the siblings of each level with its place."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for i, a in enumerate(at):
            run, place = runs[a // 16], a % 16
            paths[i].append((place, "".join(run[:place] + run[place + 1:])))
        nodes, at = [H(*run) for run in runs], [a // 16 for a in at]
    return nodes[0], paths


def _expected(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = H(*map(_enc, (doc_id, source, lang, n, text)))
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None
        now = H(*map(_enc, (doc_id, source, lang, n, text.translate(low)))) if tampered else leaf
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, now, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s])[:], _tree([g[2] for g in sorted(groups[s])])) for s in names}
    root, tops = _tree([trees[s][1][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        leaves, (subroot, paths) = trees[s]
        for (_, _, leaf, now, doc_id), path in zip(leaves, paths):
            h = now
            for place, siblings in path + top:
                h = H(siblings[:64 * place], h, siblings[64 * place:])
            out.append(str((doc_id, leaf, subroot, root, H(*(x for _, x in path + top)), h, h == root)))
    return sorted(out)


def _got(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *a: docs)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(str(tuple(r[n] for n in names)) for r in queries.op11_merkle(spark, "").collect())


def _rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("n", [1, 16, 17, 300])
def test_equals_a_plain_tree(spark, monkeypatch, n):
    rnd = random.Random(n)
    rows = [(rnd.randrange(10 ** 6), rnd.choice(["Ab c", "É x", "", None, "lower"]), rnd.choice(["en", None]),
             rnd.choice(["s1", "s2", "é", "Z", "", None]) if n < 300 else f"s{rnd.randrange(40)}", rnd.choice([1, None])) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert _got(spark, docs, monkeypatch) == _expected(rows)


def test_groups_of_several_blocks(spark, monkeypatch):
    """One source of three blocks, one of a block exactly, one just above, and many small ones."""
    b = merkle.BLOCK
    source = F.expr(f"case when id < {2 * b + 3} then 'big' when id < {3 * b + 3} then 'even' when id < {4 * b + 4} then 'over' else concat('s', id % 4500) end")
    docs = spark.range(4 * b + 4 + 4500).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"),
                                                source.alias("source"), F.lit(3).alias("n_chars"))
    assert _got(spark, docs, monkeypatch) == _expected(_rows(docs))


def test_awkward_and_empty(spark, monkeypatch):
    docs = awkward(spark).withColumn("grp", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("leaf", F.lit(1))
    assert _got(spark, docs, monkeypatch) == _expected(_rows(docs))
    assert merkle.check(empty(spark)).count() == 0


def test_a_change_anywhere_shows(spark):
    docs = table(spark, [f"Text {i}" for i in range(40)])
    paths = merkle.manifest(docs, F.col("source"), [F.col("doc_id")], merkle.document_columns(F.col("text")), {"doc_id": F.col("doc_id")})
    bad = F.sha2(F.lit("other").cast("binary"), 256)
    assert paths.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert paths.where(merkle.folded(bad, F.col("path")) == F.col("root")).count() == 0


def test_witnesses_grow_while_appending():
    tree = merkle.Subtree()
    leaves = [H(str(i)) for i in range(40)]
    for i, node in enumerate(leaves):
        tree.append(node)
        assert len(tree.steps[0][0][1]) == min(i + 1, 16)       # the first leaf's run, extended by each later sibling
        assert len(tree.steps[0]) == (1 if i < 15 else 2)
    root = tree.finish(None)
    want, paths = _tree(leaves)
    assert root == want and [[(p["place"], p["siblings"]) for p in tree.path(i)] for i in range(40)] == paths
