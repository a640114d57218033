"""Merkle manifest of a table: a tree of SHA-256 digests per group, a tree over the groups, and every row's witness.

Rows are appended in order to aligned subtrees. A run of open siblings is at the same time the partial witness of every row
below it: each sibling that completes extends it, and a full run closes into its parent, whose own run is the next
step of all of them. Subtrees of ``ARITY ** BLOCK_LEVELS`` rows are built in tasks of their own; their roots
are appended again, level by level, until a group has one root, and last come the groups' roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.common import small_batches, stored

#: Children of a node, and levels of the subtree that one task builds (16 ** 3 = 4096 rows).
ARITY, BLOCK_LEVELS = 16, 3
BLOCK = ARITY ** BLOCK_LEVELS
#: Rows up to which the table of part offsets is broadcast (about 50 bytes each).
BROADCAST_ROWS = 250_000
_STEP = pa.struct([("place", pa.int32()), ("siblings", pa.string())])
PATH = "array<struct<place: int, siblings: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Subtree:
    """An aligned subtree that grows by appending; every node appended has a witness that is complete once the tree is."""

    def __init__(self) -> None:
        self.runs: list[list[str]] = [[]]  # digests of the open run of each level
        self.spans: list[list[tuple[int, int]]] = [[]]  # the appended nodes below each of them
        self.steps: list[list[tuple[int, list[str]]]] = []  # per appended node: its place in each run on the way up

    def append(self, node: str) -> None:
        n = len(self.steps)
        self.steps.append([])
        self._add(0, node, n, n + 1)

    def _add(self, level: int, node: str, first: int, end: int) -> None:
        if level == len(self.runs):
            self.runs.append([])
            self.spans.append([])
        run = self.runs[level]
        for i in range(first, end):
            self.steps[i].append((len(run), run))  # the run is shared: later siblings extend it
        run.append(node)
        self.spans[level].append((first, end))
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, spans = self.runs[level], self.spans[level]
        self.runs[level], self.spans[level] = [], []
        self._add(level + 1, digest("".join(run)), spans[0][0], spans[-1][1])

    def finish(self, levels: int | None) -> str:
        """Close what is open below ``levels`` (None: until one node remains) and return the root."""
        level = 0
        while level < levels if levels is not None else len(self.runs[level]) > 1 or any(self.runs[level + 1:]):
            if self.runs[level]:
                self._close(level)
            level += 1
        root = self.runs[level].pop()
        for steps in self.steps:
            steps.pop()  # the root's own place
        return root

    def path(self, i: int) -> list[dict]:
        return [{"place": place, "siblings": "".join(run[:place] + run[place + 1:])} for place, run in self.steps[i]]


def _grow(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted nodes (grp, block, pos, digest, alone): the blocks' roots, or each node's path within its block."""
    names = ["grp", "pos", "digest"] if kind == "roots" else ["grp", "pos", "path"]
    at, tree, seen, alone = None, Subtree(), [], False

    def settle() -> pa.RecordBatch:
        root = tree.finish(None if alone else BLOCK_LEVELS)
        if kind == "roots":
            columns = [pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([root])]
        else:
            columns = [pa.array([at[0]] * len(seen)), pa.array(seen, pa.int64()),
                       pa.array([tree.path(i) for i in range(len(seen))], pa.list_(_STEP))]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for grp, block, pos, node, only in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (grp, block):
                if at is not None:
                    yield settle()
                at, tree, seen = (grp, block), Subtree(), []
            tree.append(node)
            seen.append(pos)
            alone = only
    if at is not None:
        yield settle()


def _by_block(nodes: DataFrame, *columns: str) -> DataFrame:
    """Rows of a block side by side, in order; ``alone`` says that the group has no other block."""
    blocks = F.floor(F.col("pos") / BLOCK).alias("block")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (nodes.select("grp", blocks, "pos", *columns, (F.col("total") <= BLOCK).alias("alone"))
            .repartition(n, "grp", "block").sortWithinPartitions("grp", "block", "pos"))


def _roots(nodes: DataFrame, name: str) -> DataFrame:
    """(grp, pos, digest, total) of the blocks' roots, by their place among the group's blocks."""
    rows = _by_block(nodes, "digest").mapInArrow(partial(_grow, kind="roots"), "grp string, pos long, digest string")
    totals = nodes.groupBy("grp").agg(F.ceil(F.max("total") / BLOCK).alias("total"))
    return stored(rows.join(totals, "grp"), name)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0) and ``total`` by grp to stored rows. Parts are cut by range over (grp, order), so that a group of any
    size is spread, and offsets come from a row per (grp, part)."""
    parts = stored(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
                   .withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ranked")
    sizes = parts.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("seq").alias("seq0"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
                     .withColumn("total", F.sum("n").over(Window.partitionBy("grp"))).drop("n"), "offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return parts.join(offsets, ["grp", "part"]).select(*rows.columns, (F.col("before") + F.col("seq") - F.col("seq0")).alias("pos"),
                                                       "total")


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stored nodes (grp, pos, digest, total): the groups' roots (grp, digest), and every node's (grp, pos, path) below them."""
    tables = [nodes]
    while (tables[-1].agg(F.max("total")).first()[0] or 0) > 1:
        tables.append(_roots(tables[-1], f"roots{len(tables)}"))
    paths = None
    for table in reversed(tables[:-1]):
        own = _by_block(table, "digest").mapInArrow(partial(_grow, kind="paths"), f"grp string, pos long, path {PATH}")
        if paths is not None:
            up = paths.select("grp", F.col("pos").alias("block"), F.col("path").alias("rest"))
            own = (own.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(up, ["grp", "block"])
                   .select("grp", "pos", F.concat("path", "rest").alias("path")))
        paths = stored(own, "paths")
    if paths is None:
        paths = nodes.select("grp", "pos", F.array().cast(PATH).alias("path"))
    return tables[-1].select("grp", "digest"), paths


def _witness(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of blocks, each behind a row (pos -1) with what its block's root has above it: rows with their whole path."""
    fixed = ["grp", "block", "pos", "digest", "alone", "path", "subroot", "root"]
    at, tree, waiting, above = None, Subtree(), [], {}

    def settle() -> Iterator[pa.RecordBatch]:
        tree.finish(None if above["alone"] else BLOCK_LEVELS)
        for start in range(0, len(waiting), 256):
            rows = waiting[start:start + 256]
            paths = [tree.path(start + i) + above["path"] for i in range(len(rows))]
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(paths, pa.list_(_STEP)), pa.array([above["subroot"]] * len(rows)),
                                              pa.array([above["root"]] * len(rows))], [*names, "path", "subroot", "root"])

    kinds: list[pa.DataType] = []
    for batch in batches:
        kinds = [batch.schema.field(c).type for c in names]
        columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in dict.fromkeys([*fixed, *names])}
        for i in range(batch.num_rows):
            if columns["pos"][i] < 0:
                if at is not None:
                    yield from settle()
                at, tree, waiting = (columns["grp"][i], columns["block"][i]), Subtree(), []
                above = {c: columns[c][i] for c in ("alone", "path", "subroot", "root")}
            else:
                tree.append(columns["digest"][i])
                waiting.append(tuple(columns[c][i] for c in names))
    if at is not None:
        yield from settle()


def field(column: Column) -> Column:
    """A value as it enters a digest: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    def up(h: Column, step: Column) -> Column:
        cut = step["place"] * 64
        return F.sha2(F.concat(F.substring(step["siblings"], F.lit(1), cut), h,
                               F.substring(step["siblings"], cut + 1, F.length(step["siblings"]))).cast("binary"), 256)

    return F.aggregate(path, start, up)


def manifest(rows: DataFrame, group: Column, order: list[Column], columns: list[Column],
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: the ``carry`` columns, leaf, subroot (of its group), root (of the table) and path.

    A leaf is the digest of ``columns``. A group's leaves ascend by ``order`` (nulls first, ties by leaf); while several nodes remain,
    every ``ARITY`` consecutive ones become the digest of their digests as hex text (the last run: fewer, even one). The groups' roots,
    ordered by the group's text (null first), lead to the root alike; a lone node is its own root. path: from the leaf to the root, the
    leaf's place in each run and its siblings' digests, concatenated from left to right. Nulls in any column are values of their own,
    empty texts are not null, repeated rows are leaves of their own, and an empty table gives no rows.
    """
    carry = carry or {}
    small_batches(rows.sparkSession)
    carried = [f"carry{i}" for i in range(len(carry))]
    orders = [f"order{i}" for i in range(len(order))]
    text = group.cast("string")
    base = stored(rows.select(F.coalesce(F.concat(F.lit("="), text), F.lit("-")).alias("grp"),  # "-" < "="
                              *[c.alias(n) for n, c in zip(orders, order)], leaf(columns).alias("digest"),
                              *[c.alias(n) for n, c in zip(carried, carry.values())]), "leaves")
    leaves = stored(ranked(base, [*orders, "digest"]).drop(*orders), "positions")
    blocks = _roots(leaves, "blocks")
    subroots, below = _climb(blocks)
    subroots = stored(subroots, "subroots")
    groups = stored(ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"]), "groups")
    top, across = _climb(groups)
    across = (groups.join(across, ["grp", "pos"]).join(top.select("grp", F.col("digest").alias("root")), "grp")
              .select(F.col("name").alias("grp"), F.col("path").alias("rest"), F.col("digest").alias("subroot"), "root"))
    above = (below.join(blocks.select("grp", "pos", (F.col("total") == 1).alias("alone")), ["grp", "pos"]).join(across, "grp")
             .select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "alone",
                     F.concat("path", "rest").alias("path"), "subroot", "root"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = (leaves.select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "digest", *carried)
             .unionByName(above, allowMissingColumns=True).repartition(n, "grp", "block").sortWithinPartitions("grp", "block", "pos"))
    kinds = ", ".join(f"{c} {leaves.schema[c].dataType.simpleString()}" for c in carried)
    out = lined.mapInArrow(partial(_witness, names=[*carried, "digest"]),
                           f"{kinds + ', ' if kinds else ''}digest string, path {PATH}, subroot string, root string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(carried, carry)], F.col("digest").alias("leaf"), "subroot", "root", "path")


def document_columns(text: Column) -> list[Column]:
    return [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]


def check(docs: DataFrame, every: int = 5) -> DataFrame:
    """Proofs of a documents table after some texts were lower-cased (A-Z) where ``every`` divides crc32(doc_id as text).

    doc_id, leaf, subroot, root and path of the original; folded_root: what the present row's leaf leads to; verified:
    whether that is the root. A null doc_id is not tampered with, and neither is a null text.
    """
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    present = F.when(altered, leaf(document_columns(low)))  # null: the original leaf
    rows = manifest(docs, F.col("source"), [F.col("doc_id")], document_columns(F.col("text")), {"doc_id": F.col("doc_id"), "present": present})
    rows = rows.withColumn("folded_root", folded(F.coalesce("present", "leaf"), F.col("path")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).drop("present")


def sql(levels: int = 5, every: int = 5) -> str:
    """DuckDB twin of the registered query, for up to 16 ** levels rows of a source and sources."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def enc(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    ctes = [f"""tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY i) AS t
                FROM range(256) r(i))""",
            f"""d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce('=' || source, '-') AS grp, {hashed('text')} AS leaf,
                CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                     lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {every} = 0
                     THEN {hashed(low)} ELSE {hashed('text')} END AS present FROM documents, tab)""",
            "a0 AS (SELECT rn, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h FROM d)"]

    def climb(prefix: str) -> None:
        for i in range(levels):
            ctes.append(f"""{prefix}r{i} AS (SELECT grp, pos // {ARITY} AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n
                            FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {prefix}{i}) GROUP BY grp, pos // {ARITY})""")
            ctes.append(f"""{prefix}{i + 1} AS (SELECT grp, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h
                            FROM {prefix}r{i})""")

    def fold(prefix: str, source: str, pos: str) -> str:
        """Steps of rows (rn, grp, pos, proof, own, present) through one tree."""
        for i in range(levels):
            place = f"(CAST(s.{pos} AS BIGINT) // {ARITY ** i} % {ARITY})"
            before, after = f"array_to_string(hs[1:{place}], '')", f"array_to_string(hs[{place} + 2:], '')"
            ctes.append(f"""{prefix}f{i} AS (SELECT s.* EXCLUDE (proof, present), proof || CASE WHEN n > 1 THEN {before} || {after} ELSE '' END AS proof,
                            CASE WHEN n > 1 THEN sha256({before} || present || {after}) ELSE present END AS present
                            FROM {source} s JOIN {prefix}r{i} r ON r.grp = s.{'grp' if prefix == 'a' else 'one'}
                            AND r.run = s.{pos} // {ARITY ** (i + 1)})""")
            source = f"{prefix}f{i}"
        return source

    climb("a")
    ctes.append(f"b0 AS (SELECT '' AS grp, grp AS name, row_number() OVER (ORDER BY grp) - 1 AS pos, h FROM a{levels})")
    climb("b")
    ctes.append("s AS (SELECT d.*, a0.pos AS pos, b0.pos AS gpos, b0.h AS subroot, '' AS one, '' AS proof FROM d JOIN a0 USING (rn) JOIN b0 ON b0.name = d.grp)")
    last = fold("b", fold("a", "s", "pos"), "gpos")
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, present AS folded_root, present = b.h AS verified
FROM {last} CROSS JOIN b{levels} b"""
