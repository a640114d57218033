"""Helpers of the document operators: Arrow maps, shared scratch tables, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from modelwatch.session import ensure_checkpoint_dir

#: Rows of one Arrow batch handed to Python, and rows that one call of an operator sees.
BATCH_ROWS, STEP_ROWS = 1024, 256

Worker = Callable[[list], list]

_held: dict[tuple, object] = {}
_asked: list[tuple] = []


def held(key: tuple, make: Callable[[], object]) -> object:
    """The large object that this Python worker keeps between tasks: one at a time, so that a worker that serves
    several operators in turn (as in a pipeline) holds the tables of the last one only."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    _asked.append(key)
    return _held[key]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small (a worker holds one at a time), and hand workers this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "modelwatch.zip")  # Spark's file server sends it on
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that outlive lost executors. The folder name is fresh for each call.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a *stored* table of narrow rows when its counted size allows, else shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


def text_key(text: Column | str = "text") -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def _run(batches: Iterator[pa.RecordBatch], make: Callable[[], Worker], keep: int, schema: pa.Schema,
         as_bytes: bool) -> Iterator[pa.RecordBatch]:
    work = None
    for batch in batches:
        if work is None:
            _asked.clear()
            work = make()
            if not _asked:
                _held.clear()  # of an operator that ran here before
        for start in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(start, STEP_ROWS)
            texts = part.column(keep)
            if as_bytes:
                texts = pc.cast(texts, pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
            empty = b"" if as_bytes else ""
            columns = work([empty if t is None else t for t in texts.to_pylist()])
            del texts
            made = [pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                    for c, f in zip(columns, list(schema)[keep:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(i).cast(schema.field(i).type) for i in range(keep)] + made,
                                             schema=schema)
        pa.default_memory_pool().release_unused()


def append_columns(df: DataFrame, make: Callable[[], Worker], fields: list[StructField],
                   keep: list[str] | None = None, text: str = "text", as_bytes: bool = True) -> DataFrame:
    """Append per-document columns made in Python from one text column, without a shuffle.

    ``make`` builds, once per task, a function from a list of texts (bytes, or str with
    ``as_bytes=False``; null arrives as empty) to one list per field. ``keep`` names the input columns
    that stay (default: all); one with the name of a new field gives way to it.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = StructType([df.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    return source.mapInArrow(partial(_run, make=make, keep=len(kept), schema=arrow, as_bytes=as_bytes), schema)
