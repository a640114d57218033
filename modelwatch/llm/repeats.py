"""Repeated strings: every string of ``length`` bytes that also starts elsewhere, by suffix order and
longest-previous-factor arrays over blocks of suffixes that can match.

Two equal windows of ``length`` bytes have the same smallest k-gram hash (their anchor) at the same place. The windows
of one anchor form a run, and a run's text is a fragment. Runs of equal fragments are repeated as a whole. Fragments
that share an anchor but differ are brought together by anchor: their windows are sorted as suffixes
(to depth ``length``), and from the previous and next smaller positions in that order follow the longest
match with an earlier place, and, mirrored, with a later one.

An anchor with many different fragments is split by further anchors: within a fragment, windows that are equal also have the
same smallest k-gram by any other hash, so the fragment's runs by that hash are smaller fragments of smaller groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from modelwatch.llm.common import append_columns, broadcast_if, stored, text_key

GRAM = 32
#: An anchor with more different fragments than this is split by further anchors, this many times; what is then left goes by window.
HOT_FRAGMENTS, SPLITS = 1500, 8
#: Hot anchors up to which their list (8 bytes each) is broadcast.
BROADCAST_ANCHORS = 1_000_000
#: Windows of a block; spans and keys up to which the marked documents' table is broadcast.
BLOCK_WINDOWS, BROADCAST_SPANS, BROADCAST_KEYS = 150_000, 1_000_000, 250_000
_CHUNK = 1 << 19
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd) base modulo 2^64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(_CHUNK + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers()[0][:len(data)], out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * _MIX
    return h ^ (h >> np.uint64(32))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    p, n = _prefix(data), len(data) - size + 1
    return _mixed((p[size:] - p[:n]) * _powers()[1][:n])


def _runs(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last windows (of ``width`` k-grams) with the same smallest hash at the same place, and that place."""
    # sliding minimum over the k-grams of each window; the place breaks ties leftmost
    low, span = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < width:
        low = np.minimum(low[:span - width], low[width - span:])
    place = (low & np.uint64(0xFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return first, np.append(first[1:], len(place)) - 1, place[first]


def _fragments(p: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the texts of runs, from the prefix sums of the whole."""
    return _mixed((p[last + length] - p[first]) * _powers()[1][first] + (last - first).astype(np.uint64)).view(np.int64)


def anchors(text: bytes, length: int) -> np.ndarray:
    """Rows (first window, last window, anchor hash, fragment hash) of the runs of a text's windows."""
    if len(text) < length:
        return np.empty((0, 4), np.int64)
    step, out = _CHUNK - length, []
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, len(text) - length + 1, step):
        data = whole[at:at + step + length - 1]
        p, n = _prefix(data), len(data) - GRAM + 1
        h = _mixed((p[GRAM:] - p[:n]) * _powers()[1][:n])
        first, last, place = _runs(h, length - GRAM + 1)
        anchor = h[place].view(np.int64) >> 32
        out.append(np.stack([first + at, last + at, anchor, _fragments(p, first, last, length)], axis=1))
    return np.concatenate(out)


def subfragments(text: bytes, length: int, level: int) -> list[tuple[int, int, int, int]]:
    """(first window, last window, anchor hash, fragment hash) of a fragment's runs by the smallest k-gram of another hash; beyond
    ``SPLITS`` every window is a run, with its own hash for an anchor."""
    data = np.frombuffer(text, np.uint8)
    p = _prefix(data)
    if level > SPLITS:
        first = last = np.arange(len(data) - length + 1)
        found = _fragments(p, first, last, length)
        return list(zip(first.tolist(), last.tolist(), found.tolist(), found.tolist()))
    n = len(data) - GRAM + 1
    h = _mixed(_mixed((p[GRAM:] - p[:n]) * _powers()[1][:n]) + np.uint64(level * int(_MIX) % (1 << 64)))
    first, last, place = _runs(h, length - GRAM + 1)
    return list(zip(first.tolist(), last.tolist(), h[place].view(np.int64).tolist(), _fragments(p, first, last, length).tolist()))


def longest_factors(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest match of each window with an earlier and with a later one (window order is position order).

    Windows are rows of bytes, matches are counted to a window's length. In suffix order the best earlier match
    stands at the previous or the next smaller position, at the least common prefix on the way there.
    """
    n, size = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{size}").ravel(), kind="stable")
    rows = windows[order]
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), size, np.argmin(same, axis=1)) if n > 1 else np.empty(0, np.int64)
    earlier = _smaller(order, common)
    later = _smaller(n - 1 - order, common)[::-1]  # mirrored: larger positions become smaller
    return earlier, later


def _smaller(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """By position: the larger of the common prefixes with the previous and next smaller positions in suffix order."""
    best = [0] * len(order)
    places, prefixes = order.tolist(), common.tolist()
    stack: list[tuple[int, int]] = []  # (position, common prefix with the entry below)
    for i, here in enumerate(places):
        shared = prefixes[i - 1] if i else 0
        while stack and stack[-1][0] > here:
            position, below = stack.pop()
            best[position] = max(below, shared)  # previous smaller: below; next smaller: here
            shared = min(shared, below)
        stack.append((here, shared))
    while stack:
        position, below = stack.pop()
        best[position] = max(best[position], below)
    return np.array(best, np.int64)


def _decide(batches: Iterator[pa.RecordBatch], length: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of fragments, by anchor: windows that match elsewhere, as (row, start, end) byte spans."""
    held: dict[str, list] = {"anchor": [], "fragment": [], "row": [], "at": [], "times": [], "text": []}
    windows = 0

    def block(n: int) -> pa.RecordBatch:
        order = sorted(range(n), key=lambda i: (held["row"][i], held["at"][i]))
        data = [np.frombuffer(held["text"][i], np.uint8) for i in order]
        counts = [len(d) - length + 1 for d in data]
        owner = np.repeat(np.arange(len(order)), counts)
        hashes = np.concatenate([window_hashes(d, length) for d in data])
        starts = np.concatenate([np.arange(c) for c in counts])
        # a window whose hash is alone matches nothing
        _, code, times = np.unique(hashes, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[code] > 1)
        out = []
        for part in _parts(some, code[some]):
            rows = np.stack([data[owner[w]][starts[w]:starts[w] + length] for w in part])
            earlier, later = longest_factors(rows)
            hit = (earlier if keep_first else np.maximum(earlier, later)) >= length
            out.append(part[hit])
        hit = np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)
        fragment = np.array(order, np.int64)[owner[hit]]
        if not keep_first:
            alone = np.array(held["times"])[fragment] == 1
            hit, fragment = hit[alone], fragment[alone]
        begin = np.array(held["at"], np.int64)[fragment] + starts[hit]
        row = np.array(held["row"], np.int64)[fragment]
        new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(begin) != 1))) if len(hit) else hit
        ends = np.append(new[1:], len(hit)) - 1 if len(hit) else hit
        return pa.RecordBatch.from_arrays([pa.array(row[new]), pa.array(begin[new]), pa.array(begin[ends] + length)],
                                          ["row", "start", "end"])

    for batch in batches:
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            anchor, fragment = columns["anchor"][i], columns["fragment"][i]
            if held["anchor"] and (anchor, fragment) == (held["anchor"][-1], held["fragment"][-1]):
                continue  # the same fragment of a repeated row
            if windows > BLOCK_WINDOWS and anchor != held["anchor"][-1]:
                yield block(len(held["row"]))
                held = {k: [] for k in held}
                windows = 0
            for name, column in columns.items():
                held[name].append(column[i])
            windows += len(columns["text"][i]) - length + 1
    if held["row"]:
        yield block(len(held["row"]))


def _parts(some: np.ndarray, code: np.ndarray, most: int = 20_000) -> list[np.ndarray]:
    """Windows in parts of bounded size; those of one hash stay together."""
    if not len(some):
        return []
    order = np.argsort(code, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(code[order]) != 0, True)) + 1
    cuts, at = [], 0
    for end in ends.tolist():
        if end - at > most:
            cuts.append(end)
            at = end
    return [np.sort(p) for p in np.split(some[order], cuts) if len(p)]


def _anchor_rows(length: int):
    def work(texts: list[bytes]) -> list[list]:
        found = [anchors(t, length) for t in texts]
        kind = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int32()), ("fragment", pa.int64())])
        flat = np.concatenate(found) if found else np.empty((0, 4), np.int64)
        values = pa.StructArray.from_arrays([pa.array(flat[:, i], t.type) for i, t in enumerate(kind)], fields=list(kind))
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        return [[len(t) for t in texts], pa.ListArray.from_arrays(offsets, values)]

    return work


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Fragment texts of the wanted runs of each document."""
    names = ["anchor", "fragment", "row", "at", "times", "text"]
    for batch in batches:
        rows: list[tuple] = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            rows += [(w["anchor"], w["fragment"], w["row"], w["lo"], w["times"], raw[w["lo"]:w["hi"] + length])
                     for w in wanted]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _split(batches: Iterator[pa.RecordBatch], length: int, level: int) -> Iterator[pa.RecordBatch]:
    """Smaller fragments of the fragments of hot anchors, under anchors of both."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows: list[tuple] = []
            part = batch.slice(start, 256)
            for anchor, row, at, times, text in zip(*(part.column(i).to_pylist() for i in range(5))):
                for lo, hi, under, fragment in subfragments(text, length, level):
                    key = under if level > SPLITS else xxhash.xxh64_intdigest(b"%d %d" % (anchor, under)) - (1 << 63)
                    rows.append((key, fragment, row, at + lo, times, hi - lo + length, None if level > SPLITS else text[lo:hi + length]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)],
                                             ["anchor", "fragment", "row", "at", "times", "size", "text"])


_PIECES = "anchor long, fragment long, row long, at int, times long, size int, text binary"


def _different(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Marks (row, start, end) in fragments that share an anchor but differ: stored (anchor, fragment, row, at, times, text).

    Blocks by anchor decide; fragments of hot anchors are split until their anchors are not hot. Of equal smaller
    fragments all places are marked, and the first goes on.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["anchor", "fragment", "row", "at", "times", "text"]
    pieces, found = texts.select(F.col("anchor").cast("long").alias("anchor"), *columns[1:]), []
    for level in range(1, SPLITS + 2):
        sizes = pieces.groupBy("anchor").agg(F.count("*").alias("variants"))
        hot = stored(sizes.where(F.col("variants") > HOT_FRAGMENTS).select("anchor"), "hot")
        crowded = broadcast_if(hot, BROADCAST_ANCHORS)
        blocks = (pieces.join(crowded, "anchor", "left_anti").select(*columns).repartition(n, "anchor").sortWithinPartitions("anchor", "fragment"))
        found.append(blocks.mapInArrow(partial(_decide, length=length, keep_first=keep_first), "row long, start long, end long"))
        if hot.isEmpty():
            break
        split = (pieces.join(crowded, "anchor", "left_semi").dropDuplicates(["anchor", "fragment"]).select("anchor", "row", "at", "times", "text")
                 .mapInArrow(partial(_split, length=length, level=level), _PIECES))
        small = stored(split, "split")
        same = stored(small.groupBy("anchor", "fragment").agg(F.count("*").alias("n"), F.sum("times").alias("times"),
                                                              F.min(F.struct("row", "at", "text")).alias("f")), "same")
        again = same.where("n > 1").select("anchor", "fragment", F.col("f.row").alias("row0"), F.col("f.at").alias("at0"))
        places = small.join(again, ["anchor", "fragment"]).where("row <> row0 or at <> at0" if keep_first else "times = 1")
        found.append(places.select("row", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("size")).cast("long").alias("end")))
        if level > SPLITS:
            break  # windows by themselves: equal ones are found
        pieces = same.select("anchor", "fragment", "f.row", "f.at", "times", "f.text")
    marks = found[0]
    for rows in found[1:]:
        marks = marks.unionByName(rows)
    return marks


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a document (row, [(start, end)]) as maximal spans."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = []
        for marks in batch.column(1).to_pylist():
            out: list[dict] = []
            for m in sorted(marks, key=lambda m: m["start"]):
                if out and out[-1]["end"] >= m["start"]:
                    out[-1]["end"] = max(out[-1]["end"], m["end"])
                else:
                    out.append(m)
            spans.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["row", "spans"])


def repeated_spans(keyed: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(key, doc_id, n_bytes, spans) of the distinct documents among rows (doc_id, text, key).

    spans: merged [start, end) byte spans of the windows that occur elsewhere (``keep_first``: that occur earlier, in
    the order of the stored table, so that one copy of each string stays).
    """
    kind = StructType([StructField("lo", IntegerType()), StructField("hi", IntegerType()),
                       StructField("anchor", IntegerType()), StructField("fragment", LongType())])
    per_doc = stored(append_columns(keyed, partial(_anchor_rows, length),
                                    [StructField("n_bytes", LongType()), StructField("runs", ArrayType(kind))],
                                    keep=["doc_id", "key"]).withColumn("row", F.monotonically_increasing_id()), "runs")
    runs = per_doc.select("row", F.explode("runs").alias("r")).select("row", "r.*")
    # equal fragments: a count and the first place; then which anchors have several fragments
    fragments = runs.groupBy("anchor", "fragment").agg(F.count("*").alias("times"),
                                                       F.min(F.struct("row", "lo", "hi")).alias("first"))
    mixed = (runs.groupBy("anchor").agg(F.min("fragment").alias("least"), F.max("fragment").alias("most"))
             .where("least <> most").select("anchor", F.lit(True).alias("mixed")))
    kinds = stored(fragments.join(mixed, "anchor", "left").where("times > 1 or mixed")
                   .select("anchor", "fragment", "times", F.coalesce("mixed", F.lit(False)).alias("mixed"), "first.*"), "fragments")
    whole = (runs.join(kinds.where("times > 1").select("anchor", "fragment", F.col("row").alias("row0"),
                                                       F.col("lo").alias("lo0")), ["anchor", "fragment"]))
    if keep_first:
        whole = whole.where("row <> row0 or lo <> lo0")
    whole = whole.select("row", F.col("lo").cast("long").alias("start"), (F.col("hi") + length).cast("long").alias("end"))
    # different fragments of one anchor: their texts, by the documents that hold the first place of each
    owners = per_doc.select("row", "key", "doc_id")
    wanted = stored(kinds.where("mixed").join(owners, "row").groupBy("key", "doc_id").agg(F.collect_list(
        F.struct("anchor", "fragment", "row", "lo", "hi", "times")
    ).alias("wanted")), "wanted")
    source = keyed.select("key", "doc_id", "text")
    keys = wanted.select("key")
    if keys.count() <= BROADCAST_KEYS:  # 16 bytes each: keeps other documents out of the shuffle
        source = source.join(F.broadcast(keys.distinct()), "key", "left_semi")
    held = (source.alias("d").join(wanted.alias("w"), (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
            .select("text", "wanted").mapInArrow(partial(_cut, length=length), "anchor int, fragment long, row long, at int, "
                                                 "times long, text binary"))
    marks = whole.unionByName(_different(stored(held, "texts"), length, keep_first))
    merged = (marks.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("marks"))  # a document's runs: bounded by its length
              .mapInArrow(_merge, "row long, spans array<struct<start: bigint, end: bigint>>"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (per_doc.select("row", "key", "doc_id", "n_bytes").join(merged, "row", "left")
            .groupBy("key", "doc_id", "n_bytes").agg(F.min_by(F.coalesce("spans", none), "row").alias("spans")))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[list] = [[], [], []]
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw, at, kept = (text or "").encode(), 0, []
            for s in spans or []:
                kept.append(raw[at:s["start"]])
                at = s["end"]
            data = b"".join([*kept, raw[at:]])
            for column, value in zip(made, (len(raw) - len(data), data, hashlib.sha256(data).hexdigest())):
                column.append(value)
        kinds = [pa.int64(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(c, t) for c, t in zip(made, kinds))],
                                         [*batch.schema.names[2:], "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 200, keep_first: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans, kept (bytes left) and kept_sha256.

    Removes each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same or another
    document; with ``keep_first`` one copy of every string stays. Texts are taken as UTF-8 and matches never cross
    documents. Null and empty texts, and those shorter than ``length``, lose nothing. Rows with equal doc_id and text each count
    as an occurrence and get equal results. An empty table gives no rows.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", text_key())
    marked = stored(repeated_spans(keyed, length, keep_first).where(F.size("spans") > 0).select("key", "doc_id", "spans"), "spans")
    if (marked.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS and marked.count() <= BROADCAST_KEYS:
        marked = F.broadcast(marked)
    joined = keyed.alias("d").join(marked.alias("m"), (F.col("d.key") == F.col("m.key"))
                                   & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left")
    rows = joined.select("text", "m.spans", "d.doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                         F.when(F.col("m.spans").isNull(), 0).otherwise(F.size("m.spans")).cast("long").alias("n_spans"))
    return rows.mapInArrow(_apply, StructType([*rows.schema.fields[2:], StructField("n_removed", LongType())])
                           .add("kept", "binary").add(StructField("kept_sha256", StringType())))
