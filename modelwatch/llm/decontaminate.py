"""Benchmark decontamination: short test items inside long documents, by containment of word shingles.

Containment t of an item with n distinct shingles in a document means that at most n - ceil(t n) shingles are missing. So
of the item's n - ceil(t n) + 1 smallest MinHash values at least one is in the document. Items are partitioned by size
(powers of two): a partition holds these bottom values, the largest of them bounds the values that a document
has to look up, and documents with too few shingles for its smallest item skip it. Candidates are
verified on the shingles themselves. The search has no misses, unlike banded MinHash, whose Jaccard similarity of a
short item and a long document is near 0.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from modelwatch.llm.common import append_columns, stored
from modelwatch.llm.words import HashSet, fold, gram_hashes, word_hashes

#: Item text of one broadcast block; larger benchmarks take several passes over the documents.
BLOCK_BYTES = 8 << 20

Search = Callable[[DataFrame, list[str]], DataFrame]


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


class Index:
    """Items of one block, partitioned by shingle width (items under ``shingle`` words are one shingle) and size."""

    def __init__(self, items: list[tuple[int | None, bytes]], shingle: int, threshold: float):
        self.items: list[tuple[int | None, set[bytes], int]] = []
        parts: dict[tuple[int, int], list] = defaultdict(list)
        for item, text in items:
            words = fold(text)
            width = min(shingle, len(words))
            if not width:
                continue
            grams = shingles(words, width)
            need = math.ceil(threshold * len(grams) - 1e-9)
            hashes = np.unique(gram_hashes(word_hashes(words), width))
            parts[width, len(grams).bit_length()].append((len(self.items), need, hashes[:len(hashes) - need + 1]))
            self.items.append((item, grams, need))
        self.parts = []
        for (width, _), members in sorted(parts.items()):
            owners = defaultdict(list)
            for at, _, sketch in members:
                for h in sketch.tolist():
                    owners[h].append(at)
            table = HashSet(np.array(list(owners), np.uint64))
            self.parts.append((width, min(m[1] for m in members), table.sorted[-1], table, dict(owners)))

    def search(self, text: bytes) -> list[tuple]:
        """(item_id, n_shingles, n_shared) of the items contained in a text."""
        words = fold(text)
        if not words:
            return []
        hashes, by_width, found = word_hashes(words), {}, set()
        for width, need, most, table, owners in self.parts:
            if len(words) < width + need - 1:
                continue
            if width not in by_width:
                by_width[width] = gram_hashes(hashes, width)
            grams = by_width[width]
            low = grams if most > np.uint64(3 << 62) else grams[grams <= most]
            for h in np.unique(low[table.positions(low)]).tolist():
                found.update((width, at) for at in owners[h])
        out, sets = [], {}
        for width, at in sorted(found, key=lambda x: x[1]):
            item, grams, need = self.items[at]
            if width not in sets:
                sets[width] = shingles(words, width)
            shared = len(grams & sets[width])
            if shared >= need:
                out.append((item, len(grams), shared))
        return out


def _search(items, shingle: int, threshold: float):
    index = Index(items.value, shingle, threshold)
    return lambda texts: [[index.search(t) for t in texts]]


_FOUND = StructField("__found", ArrayType(StructType([StructField("item_id", LongType()), StructField("n_shingles", LongType()),
                                                     StructField("n_shared", LongType())])))


def _items(items: DataFrame) -> tuple[DataFrame, int]:
    """The different items, and the number of blocks that hold them."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows, max(1, -(-size // BLOCK_BYTES))


def _pass(rows: DataFrame, block: int, blocks: int, shingle: int, threshold: float, run: Callable[[Search], DataFrame]) -> DataFrame:
    """``run`` with the search (a function that appends ``__found`` to documents) of one block of items.

    Of several blocks each is searched and written before the next one is gathered, and released then: the driver and the
    executors hold one block, of about ``BLOCK_BYTES``, at a time.
    """
    mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
    held = rows.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in mine])
    out = run(lambda df, keep: append_columns(df, partial(_search, held, shingle, threshold), [_FOUND], keep=keep))
    if blocks == 1:
        return out
    out = stored(out, "decontamination")
    held.destroy()
    return out


def contained(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every document that contains an item.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. An item
    with fewer words than a shingle is one shingle of all its words; one without words is in no document. Repeated items count
    once, repeated documents and null doc_ids are rows of their own; null texts are empty; empty tables give no rows.
    """
    def found(search: Search) -> DataFrame:
        return search(docs, ["doc_id"]).select("doc_id", F.explode("__found").alias("f")).select(
            "doc_id", "f.*", (F.col("f.n_shared") / F.col("f.n_shingles")).alias("containment"))

    rows, blocks = _items(items)
    return reduce(DataFrame.unionByName, (_pass(rows, b, blocks, shingle, threshold, found) for b in range(blocks)))


def clean(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no item, with all their columns.

    A null or empty text contains nothing and stays; repeated rows stay or go together; without items everything stays. Items count as
    in :func:`contained`.
    """
    rows, blocks = _items(items)
    kept = docs
    for block in range(blocks):
        kept = _pass(rows, block, blocks, shingle, threshold,
                     lambda search, df=kept: search(df, docs.columns).where(F.size("__found") == 0).drop("__found"))
    return kept.select(*[f"`{c}`" for c in docs.columns])


#: DuckDB twin of ``contained`` at five words and 0.8.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS it, item_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
s AS (SELECT it, item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2),
             lambda p: array_to_string(w[p:p + k - 1], ' ')))) AS s
      FROM (SELECT *, least(5, len(w)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT it, item_id, k, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT rn, doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2),
             lambda p: array_to_string(w[p:p + k - 1], ' ')))) AS s
      FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)
SELECT doc_id, n.item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM g JOIN s USING (k, s) JOIN n ON n.it = s.it
GROUP BY rn, doc_id, n.it, n.item_id, n HAVING count(*) * 5 >= n * 4
"""
