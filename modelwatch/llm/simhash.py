"""Near-duplicates by SimHash, linked through Gray-ordered hierarchical indexes.

Fingerprints within ``d`` bits agree in at least one of ``d + 1`` bit blocks, so each fingerprint goes to one
index per block, keyed by the block's value; keys that hold too many fingerprints are split again by
a block of the bits that remain. Within a task the fingerprints of a key stand in Gray-code order. Runs of
neighbours share most bits; a run's shared bits become a node (mask, pattern), nodes are grouped
again, and every node keeps only the bits its parent does not have. A search adds the differing bits from the
root down and drops a whole group once the sum is over ``d``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from modelwatch.llm.common import append_columns, broadcast_if, stored, text_key
from modelwatch.llm.graph import components

FAN_OUT, CHUNK_ROWS = 8, 1 << 16
#: Pairs of codes that one step of a search has in memory at most (beyond those of a single code).
STEP_PAIRS = 1 << 20
#: A key with more fingerprints than this is split by further bits.
KEY_ROWS = 4096
#: Rows (24 bytes) up to which the chosen documents' keys are broadcast.
CHOSEN_ROWS = 300_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash: a bit is set if over half of the shingles' XXH64 (seed 42) have it; no words give 0."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    return lambda texts: [[fingerprint(t, shingle) for t in texts]]


def _runs(starts: np.ndarray, n: int) -> np.ndarray:
    """First positions of the groups of FAN_OUT neighbours, never across a key's start."""
    length = np.diff(np.append(starts, n))
    within = np.arange(n) - np.repeat(starts, length)
    return np.flatnonzero(within % FAN_OUT == 0)


def _levels(codes: np.ndarray, starts: np.ndarray) -> list[dict]:
    """Index levels from the roots (one node per key) down to the single codes."""
    levels = [{"own": np.full(len(codes), _ALL), "pat": codes, "first": np.arange(len(codes) + 1)}]
    every, some, keys = codes, codes, starts
    while len(levels[-1]["pat"]) > len(starts):
        n = len(every)
        first = _runs(keys, n)
        every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
        mask = ~(every ^ some)
        levels[-1]["own"] = levels[-1]["own"] & ~np.repeat(mask, np.diff(np.append(first, n)))
        keys = np.searchsorted(first, keys)
        levels.append({"own": mask, "pat": every & mask, "first": np.append(first, n)})
    for below, level in zip(levels, levels[1:]):
        level["begin"] = below["begin"][level["first"][:-1]] if "begin" in below else level["first"][:-1]
    levels[0]["begin"] = np.arange(len(codes))
    return levels[::-1]


def link(codes: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """The smallest linked position for each code; codes stand by key, then by Gray rank.

    Two codes of one key within ``distance`` bits get the same label (transitively).
    """
    root = np.arange(len(codes))
    if not len(codes):
        return root
    levels = _levels(codes, starts)
    key_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    sizes = np.diff(np.append(starts, len(codes)))[key_of]
    steps = np.cumsum(sizes) // STEP_PAIRS  # many codes of small keys, or few of large ones, at a time
    for at, end in zip(*(np.searchsorted(steps, np.unique(steps), side=s) for s in ("left", "right"))):
        q = np.arange(at, end)
        q = q[sizes[q] > 1]
        node, acc = key_of[q], np.zeros(len(q), np.int64)
        for depth, level in enumerate(levels):
            acc = acc + np.bitwise_count((codes[q] ^ level["pat"][node]) & level["own"][node])
            near = (acc <= distance) & (level["begin"][node] <= q)
            q, node, acc = q[near], node[near], acc[near]
            if depth + 1 == len(levels):
                break
            first = level["first"]
            n = first[node + 1] - first[node]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            node = np.repeat(first[node], n) + offset
            q, acc = np.repeat(q, n), np.repeat(acc, n)
        a, b = root[q], root[node]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b], axis=0)
        if len(pairs):
            _unite(root, pairs)
    return root


def _unite(root: np.ndarray, pairs: np.ndarray) -> None:
    """Merge the labels of each pair, keeping every entry of ``root`` the smallest of its class."""
    parent = np.arange(len(root))
    while len(pairs):
        np.minimum.at(parent, pairs[:, 0], pairs[:, 1])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        pairs = np.sort(parent[pairs], axis=1)[:, ::-1]
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    root[:] = parent[root]


def _link_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come by key and Gray rank; a chunk ends at a key's end."""
    keys, codes = np.empty(0, np.int64), np.empty(0, np.uint64)

    def linked(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        root = link(c, np.flatnonzero(np.append(True, k[1:] != k[:-1])), distance)
        near = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(c[near].view(np.int64)), pa.array(c[root[near]].view(np.int64))],
                                          ["a", "b"])

    for batch in batches:
        keys = np.append(keys, batch.column(0).to_numpy())
        codes = np.append(codes, batch.column(1).to_numpy().view(np.uint64))
        if len(keys) >= CHUNK_ROWS and keys[0] != keys[-1]:
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield linked(keys[:cut], codes[:cut])
            keys, codes = keys[cut:], codes[cut:]
    if len(keys):
        yield linked(keys, codes)


def _blocks(rows: DataFrame, bits: int, parts: int) -> DataFrame:
    """One row per block of the ``bits`` low bits of ``rest``: the block joins the key, the others are the new rest."""
    width = -(-bits // parts)
    made = []
    for i in range(parts):
        low = max(0, bits - width * (i + 1))
        high = bits - width * i
        value = F.shiftrightunsigned("rest", low).bitwiseAND((1 << (high - low)) - 1)
        upper = F.shiftleft(F.shiftrightunsigned("rest", high), low) if high < 64 else F.lit(0)
        left = upper.bitwiseOR(F.col("rest").bitwiseAND((1 << low) - 1))
        made.append(F.struct(F.xxhash64("key", F.lit(i), value).alias("key"), left.alias("rest")))
    return rows.withColumn("x", F.explode(F.array(*made))).select("code", "x.key", "x.rest")


def similar(codes: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``code`` within ``distance`` bits, as forests.

    Every link lies within a key of the index. A key with over ``KEY_ROWS`` fingerprints is split again by the bits
    that its key does not hold; two fingerprints of one key that are ``distance`` bits apart agree
    in one block of those too, so nothing is lost.
    """
    parts = distance + 1
    width = -(-64 // parts)
    rows = _blocks(codes.select("code", F.lit(0).cast("long").alias("key"), F.col("code").alias("rest")), 64, parts)
    bits, done = 64 - width, []
    while bits >= 4 * parts:
        hot = stored(rows.groupBy("key").count().where(F.col("count") > KEY_ROWS).select("key"), "hot")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "key", "left_anti").select("key", "code"))
        rows = stored(_blocks(rows.join(hot, "key"), bits, parts), "split")
        bits -= -(-bits // parts)
    done.append(rows.select("key", "code"))
    keyed = done[0]
    for more in done[1:]:
        keyed = keyed.unionByName(more)
    gray = F.col("code")
    for shift in (1, 2, 4, 8, 16, 32):  # rank of a code in Gray order
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, shift))
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = gray.bitwiseXOR(-(1 << 63))  # as unsigned
    return (keyed.repartition(n, "key").sortWithinPartitions("key", rank)
            .mapInArrow(partial(_link_batches, distance=distance), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), key (128-bit text key), root (fingerprint of the group), component_id.

    component_id is the smallest doc_id reachable over links of ``distance`` or fewer bits. Equal
    fingerprints are one node, so copies never meet in pairs. Null or empty texts have fingerprint 0 and
    link like any other; a null doc_id is never the smallest (a group with none but null gets null);
    repeated rows come back repeated; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", "text", text_key("text").alias("key"))
    rows = stored(append_columns(keyed, partial(_fingerprints, shingle), [StructField("fp", LongType())],
                                 keep=["doc_id", "key"]), "fingerprints")
    codes = stored(rows.groupBy(F.col("fp").alias("code")).agg(F.min("doc_id").alias("least")), "codes")
    found = components(similar(codes, distance))
    rooted = stored(codes.join(found, codes["code"] == found["node"], "left")
                    .select("code", "least", F.coalesce("root", "code").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = rooted.join(smallest, "root").select(F.col("code").alias("fp"), "root", "component_id")
    return rows.join(of_code, "fp").select("doc_id", "fp", "key", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest doc_id (null last), then text key.

    Of rows with equal doc_id and text the smallest by all columns stays.
    """
    rows = stored(near_duplicates(docs, shingle, distance).select("root", "doc_id", "key"), "groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f"))
    times = rows.groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    chosen = stored(first.select("f.doc_id", "f.key").alias("c").join(
        times.alias("t"), (F.col("c.key") == F.col("t.key")) & F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")))
        .select(F.col("c.doc_id").alias("__id"), F.col("c.key").alias("__key"), F.col("times").alias("__times")), "chosen")
    found = docs.join(broadcast_if(chosen, CHOSEN_ROWS), (text_key("text") == F.col("__key"))
                      & F.col("doc_id").eqNullSafe(F.col("__id")))
    again = found.where("__times > 1").groupBy("__id", "__key").agg(F.min(F.struct(*docs.columns)).alias("f"))
    return found.where("__times = 1").select(*docs.columns).unionByName(again.select("f.*"))
