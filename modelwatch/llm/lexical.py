"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of about the same number of entries share a block. Its index is a bitmap of document rows per bit position of
their Bloom signatures, so that the rows that may hold a term come out of a few slices by AND. A term is entered once for each level
of its frequency that it reaches; weighted by the most that a frequency of that level can score, the slices add up to an upper bound of
every document for every query. Documents whose bound is below the score that a query's k-th best of a first, exactly scored
selection has are provably not among its k best; all others are scored exactly from their whole texts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.common import held, small_batches, stored
from modelwatch.llm.words import fold

#: Least frequencies of the levels; a term is entered in all that it reaches.
LEVELS = (1, 2, 3, 5, 8, 13, 24, 64)
#: Bits of a signature per entry (at least), hash positions of an entry, and bytes of a block's slices (at most, about).
BITS, HASHES, BLOCK_BYTES = 8, 4, 1 << 20
#: Documents of a block (at most), of a first selection per query, and queries and their terms of one pass over the index.
BLOCK_DOCS, FIRST, PASS_ITEMS, PASS_TERMS = 512, 64, 1000, 20_000
#: Distinct terms that a task holds before it hands on their counts, and bytes of candidates that are broadcast.
HELD_TERMS, BROADCAST_BYTES = 1 << 18, 16 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_INDEX = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("keys", pa.list_(pa.binary())), ("ns", pa.list_(pa.int64())),
                    ("bits", pa.int64()), ("slices", pa.large_binary())])


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX[0]
    x = (x ^ x >> np.uint64(27)) * _MIX[1]
    return x ^ x >> np.uint64(31)


def entries(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Hashes of (term, level)."""
    return _scrambled(hashes + levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def places(entry: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Bit positions (HASHES, entry) in signatures of powers of two of bits."""
    step = entry << np.uint64(32) | entry >> np.uint64(32) | np.uint64(1)
    mask = np.asarray(bits, np.uint64) - np.uint64(1)
    return np.stack([(entry + np.uint64(i) * step) >> np.uint64(20) & mask for i in range(HASHES)]).astype(np.int64)


class Block:
    """Documents of one size class on their way to a block of slices."""

    def __init__(self, bits: int):
        self.bits, self.keys, self.ns, self.rows = bits, [], [], []
        self.most = min(BLOCK_DOCS, max(8, BLOCK_BYTES * 8 // bits // 8 * 8))

    def add(self, key: bytes, n: int, at: np.ndarray) -> bool:
        self.rows.append(at.astype(np.int32))
        self.keys.append(key)
        self.ns.append(n)
        return len(self.keys) >= self.most

    def batch(self) -> pa.RecordBatch:
        width = (len(self.keys) + 7) // 8
        slices = np.zeros((self.bits, width), np.uint8)
        for i, at in enumerate(self.rows):
            slices[at, i >> 3] |= np.uint8(128 >> (i & 7))
        return pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([None], pa.int64()),
                                           pa.array([self.keys], pa.list_(pa.binary())), pa.array([self.ns], pa.list_(pa.int64())),
                                           pa.array([self.bits]), pa.array([slices.tobytes()], pa.large_binary())], schema=_INDEX)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents (key, text): blocks of the index, and document frequencies of terms, pre-aggregated."""
    open_blocks: dict[int, Block] = {}
    df: Counter = Counter()

    def counted() -> pa.RecordBatch:
        n = len(df)
        return pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64()),
                                           *(pa.nulls(n, f.type) for f in list(_INDEX)[2:])], schema=_INDEX)

    def added(docs: list[tuple[bytes, int, Counter]]) -> Iterator[pa.RecordBatch]:
        """Enter some documents (key, n, frequencies) at once."""
        sizes = np.array([len(tf) for _, _, tf in docs])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(tf for _, _, tf in docs)), np.uint64, sizes.sum())
        levels = np.searchsorted(LEVELS, np.fromiter(chain.from_iterable(tf.values() for _, _, tf in docs), np.int64, sizes.sum()),
                                 side="right")
        ends = np.cumsum(levels)
        level = np.arange(ends[-1]) - np.repeat(ends - levels, levels)
        cuts = ends[np.cumsum(sizes) - 1]
        counts = np.diff(cuts, prepend=0)
        bits = [max(64, 1 << int(BITS * c - 1).bit_length()) for c in counts.tolist()]
        at = places(entries(np.repeat(hashes, levels), level), np.repeat(np.array(bits, np.uint64), counts))
        for (key, n, _), b, lo, hi in zip(docs, bits, (cuts - counts).tolist(), cuts.tolist()):
            block = open_blocks.setdefault(b, Block(b))
            if block.add(key, n, at[:, lo:hi].ravel()):
                yield open_blocks.pop(b).batch()

    for batch in batches:
        waiting, terms = [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = fold((text.as_py() or "").encode())
            if not words:
                continue
            tf = Counter(words)
            df.update(tf.keys())
            waiting.append((key, len(words), tf))
            terms += len(tf)
            if terms >= 1 << 14:
                yield from added(waiting)
                waiting, terms = [], 0
            if len(df) >= HELD_TERMS:
                yield counted()
                df.clear()
        if waiting:
            yield from added(waiting)
    for block in open_blocks.values():
        yield block.batch()
    if df:
        yield counted()


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def length_factor(n: np.ndarray | int, docs: int, length: int):
    return 75 + 25 * n * docs // length


class Queries:
    """The queries of one pass: their terms' weights and hashes, and per query its terms and how often it has each."""

    def __init__(self, rows: pa.Table):
        items, terms = rows.column("item").to_pylist(), rows.column("term").to_pylist()
        weights, times = rows.column("w").to_pylist(), rows.column("times").to_pylist()
        number: dict[bytes, int] = {}
        parts: dict[int, list[tuple[int, int]]] = {}
        self.weight: list[int] = []
        for item, term, w, n in zip(items, terms, weights, times):
            if term not in number:
                number[term] = len(number)
                self.weight.append(w)
            parts.setdefault(item, []).append((number[term], n))
        self.number, self.items = number, list(parts)
        self.terms = [np.array([t for t, _ in p]) for p in parts.values()]
        self.factor = [np.array([self.weight[t] * n for t, n in p], np.int64) for p in parts.values()]
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        self.place = {item: i for i, item in enumerate(self.items)}

    def bounds(self, bits: int, slices: bytes, ns: np.ndarray, docs: int, length: int) -> Iterator[np.ndarray]:
        """Per query: upper bounds of the block's documents."""
        table = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        m = length_factor(ns, docs, length)
        best = [np.zeros(len(ns), np.int64)]  # by level reached: the most that a frequency below the next level scores
        for j in range(len(LEVELS)):
            best.append(contribution(np.int64(LEVELS[j + 1] - 1), m) if j + 1 < len(LEVELS) else np.full(len(ns), 1_000_000))
        reached = np.zeros((len(self.number), len(ns)), np.uint8)
        live = np.arange(len(self.number))
        for j in range(len(LEVELS)):
            at = places(entries(self.hashes[live], np.full(len(live), j)), bits)
            rows = table[at[0]]
            for k in range(1, HASHES):
                rows &= table[at[k]]
            some = rows.any(axis=1)
            live, rows = live[some], rows[some]
            if not len(live):
                break
            hit = np.unpackbits(rows, axis=1, count=len(ns)).astype(bool) & (reached[live] == j)
            reached[live] += hit
        best_of = np.stack(best)
        most = best_of[reached, np.arange(len(ns))[None, :]]
        for terms, factor in zip(self.terms, self.factor):
            yield factor @ most[terms]


def _search(batches: Iterator[pa.RecordBatch], name: str, queries, floors, docs: int, length: int) -> Iterator[pa.RecordBatch]:
    """(key, item, bound) of the index's documents that may score: the FIRST best bounds of each query in this task, or, with
    ``floors`` (by query), all bounds that reach them."""
    q = held(("lexical", name), lambda: Queries(queries.value))
    if floors is None:
        top = [(np.empty(0, np.int64), []) for _ in q.items]
    else:
        floor = np.array([max(1, floors.value.get(item, 1)) for item in q.items], np.int64)
    for batch in batches:
        for keys, ns, bits, slices in zip(*(batch.column(c).to_pylist() for c in range(4))):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, bound in enumerate(q.bounds(bits, slices, np.array(ns, np.int64), docs, length)):
                if floors is not None:
                    hit = np.flatnonzero(bound >= floor[i])
                    out.append((hit, np.full(len(hit), q.items[i]), bound[hit]))
                    continue
                some = np.argsort(-bound, kind="stable")[:FIRST]
                some = some[bound[some] > 0]
                b = np.concatenate([top[i][0], bound[some]])
                best = np.argsort(-b, kind="stable")[:FIRST]
                all_keys = top[i][1] + [keys[s] for s in some.tolist()]
                top[i] = (b[best], [all_keys[s] for s in best.tolist()])
            if out:
                at, items, bound = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(at)), pa.array(items), pa.array(bound)],
                                                 ["key", "item", "bound"])
    if floors is None:
        for item, (bound, keys) in zip(q.items, top):
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([item] * len(keys), pa.int64()),
                                                  pa.array(bound)], ["key", "item", "bound"])


def _exact(batches: Iterator[pa.RecordBatch], name: str, queries, docs: int, length: int) -> Iterator[pa.RecordBatch]:
    """Exact scores (doc_id, item, score) of documents (doc_id, text, items)."""
    q = held(("lexical", name), lambda: Queries(queries.value))
    for batch in batches:
        ids, items, scores = [], [], []
        for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = fold((text.as_py() or "").encode())
            m = length_factor(len(words), docs, length)
            score_of = np.zeros(len(q.number), np.int64)
            for term, n in Counter(words).items():
                at = q.number.get(term)
                if at is not None:
                    score_of[at] = 1_000_000_000 * n // (1000 * n + 12 * m)
            for item in wanted:
                i = q.place[item]
                ids.append(doc_id)
                items.append(item)
                scores.append(int(q.factor[i] @ score_of[q.terms[i]]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(items, pa.int64()),
                                          pa.array(scores, pa.int64())], ["doc_id", "item", "score"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, term, n) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for term, n in Counter(fold((text or "").encode())).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))],
                                         ["item", "term", "times"])


def _best(rows: DataFrame, k: int, by: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each item (item_id, text): item_id, rank, doc_id, score.

    Terms are words of letters, digits and characters beyond ASCII, A-Z in lower case. A score sums, over an item's terms with repeats,
    w * (10^9 tf div (1000 tf + 12 m)); w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L; N counts the documents
    with a term, L all their terms, n one document's. Only scores above 0 are returned; equal ones rank by doc_id, null first. Null,
    empty and wordless texts are in no result. Repeated rows are documents, and repeated items queries, of their own;
    an empty table of either kind gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))
    keyed = docs.select("doc_id", text.alias("text"), key.alias("key"))
    made = stored(keyed.select("key", "text").mapInArrow(
        _index, "term binary, df long, keys array<binary>, ns array<long>, bits long, slices binary"), "lexical-index")
    index = made.where(F.col("bits").isNotNull()).select("keys", "ns", "bits", "slices")
    total = index.select(F.size("keys").cast("long").alias("docs"), F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n).alias("terms")
                         ).agg(F.sum("docs"), F.sum("terms")).first()
    number = stored(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()),
                    "lexical-items")
    queries = number.select("item", "text").mapInArrow(_terms, "item long, term binary, times long")
    n, length = total[0] or 0, total[1] or 0
    frequent = made.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = stored(queries.join(frequent, "term").select("item", "term", "times", w.alias("w")), "lexical-queries")
    # passes of bounded numbers of items and terms
    sizes = weighted.groupBy("item").agg(F.count("*").alias("terms"))
    part = F.floor(F.col("start") / PASS_TERMS + F.col("nth") / PASS_ITEMS)
    order = Window.partitionBy("shard").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    shards = (sizes.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(max(1, sizes.count() // (4 * PASS_ITEMS)))))
              .withColumn("start", F.coalesce(F.sum("terms").over(order), F.lit(0)))
              .withColumn("nth", F.count("*").over(order)).select("item", "shard", part.alias("part")))
    weighted = stored(weighted.join(shards, "item"), "lexical-passes").select("shard", "part", "item", "term", "times", "w")
    results = []
    for one in weighted.select("shard", "part").distinct().orderBy("shard", "part").toLocalIterator():
        mine = weighted.where((F.col("shard") == one["shard"]) & (F.col("part") == one["part"]))
        results.append(_one_pass(keyed, index, mine, n, length, k))
    if not results:
        none = F.lit(None).cast(docs.schema["doc_id"].dataType)
        return number.select("item_id", F.lit(0).alias("rank"), none.alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    best = results[0]
    for rows in results[1:]:
        best = best.unionByName(rows)
    return best.join(number.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _one_pass(keyed: DataFrame, index: DataFrame, weighted: DataFrame, docs: int, length: int, k: int) -> DataFrame:
    """The k best (item, rank, doc_id, score) of a bounded number of queries (stored)."""
    spark = keyed.sparkSession
    context = spark.sparkContext
    queries = context.broadcast(weighted.select("item", "term", "times", "w").toArrow())
    sizes = {"name": uuid.uuid4().hex, "queries": queries, "docs": docs, "length": length}

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = stored(pairs.groupBy("key").agg(F.collect_set("item").alias("items")), "lexical-wanted")  # as many as the pass has
        size = wanted.agg(F.sum(F.size("items") * 8 + 40)).first()[0] or 0
        found = keyed.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "key")
        out = found.select("doc_id", "text", "items").mapInArrow(
            partial(_exact, **sizes), f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, item long, score long")
        return stored(out.where("score > 0"), "lexical-scores")

    def searched(floors) -> DataFrame:
        return index.mapInArrow(partial(_search, floors=floors, **sizes), "key binary, item long, bound long")

    first = scored(_best(searched(None), FIRST, [F.desc("bound"), "key"]))
    kth = _best(first, k, [F.desc("score"), "doc_id"]).where(F.col("rank") == k).select("item", "score").collect()  # one row per query
    floors = context.broadcast({r["item"]: r["score"] for r in kth})
    best = stored(_best(scored(searched(floors)), k, [F.desc("score"), "doc_id"])
                  .select("item", "rank", "doc_id", "score"), "lexical-best")
    queries.destroy()  # everything that used them is written
    floors.destroy()
    return best


#: DuckDB twin of the registered query.
SQL = r"""
WITH words AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT rn, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(w) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000.0::DOUBLE * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL),
m AS (SELECT rn, doc_id, 75 + (25 * n * docs) // terms AS m FROM d, total),
scores AS (SELECT item, item_id, rn, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (rn) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM ranked WHERE rank <= 20
"""
