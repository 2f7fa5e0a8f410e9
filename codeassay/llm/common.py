"""Helpers the training-data operators share."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from codeassay.session import discard, stable

__all__ = ["ASCII_LOWER", "by_text", "discard", "fresh", "in_batches", "order_id", "ranges", "release", "remainder", "row_digest", "shared", "small_batches", "stable", "struct_of", "table", "worker_cache"]

#: Arguments of ``translate`` that lower-case A-Z and nothing else.
ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The id that a row without one sorts and compares by: after every other.
NULL_ID = 2**63 - 1
#: Text that a task takes apart at a time.
BATCH_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(doc_id: str = "doc_id") -> Column:
    """The id as a long; a null id counts as the largest."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def row_digest(text: str = "text") -> Column:
    """Tells rows apart that share an id: rows equal in id and text are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def struct_of(kind: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


def ranges(keys: DataFrame, by: Sequence[str]) -> list[tuple[tuple, tuple]]:
    """First and last key of each partition of a range partitioning, in order.

    One row per partition comes to the driver, whatever the number of rows. Unlike partition
    numbers, these bounds are the same in every later job.
    """
    key = F.struct(*by)
    parts = keys.select(*by).repartitionByRange(*by).groupBy(F.spark_partition_id().alias("part"))
    ends = parts.agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    return sorted((tuple(r.low), tuple(r.high)) for r in ends)


def by_text(fn: Callable[[list[bytes | None]], list], kind: T.DataType) -> Callable[..., Column]:
    """A column function over texts: ``fn`` gets a batch of UTF-8 texts and returns its results.

    Structs are returned as tuples.
    """
    arrow = to_arrow_type(kind)
    names = [f.name for f in arrow] if isinstance(kind, T.StructType) else None

    def run(texts: pa.Array) -> pa.Array:
        found: list = []
        for start in range(0, len(texts), 500):  # a batch's texts are not taken out all at once
            found += fn(texts.slice(start, 500).cast(pa.binary()).to_pylist())
        if names is None:
            return pa.array(found, type=arrow)
        columns = [pa.array([r[k] for r in found], type=arrow.field(k).type) for k in range(len(names))]
        return pa.StructArray.from_arrays(columns, fields=list(arrow))

    return F.arrow_udf(run, kind)


def worker_cache(key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task, until another one is asked for.

    (Functions travel by value, so a module's own variables would not last.)
    """
    import sys
    import types

    kept = sys.modules.setdefault("_codeassay_worker_cache", types.ModuleType("_codeassay_worker_cache"))
    if getattr(kept, "held", (None,))[0] != key:
        kept.held = (None, None)
        kept.held = (key, make())
    return kept.held[1]


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of ``value``, which tasks load once; its class travels with it."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    loaded: list[object] = []

    def get() -> object:
        if not loaded:
            loaded.append(pickle.loads(packed.value))
        return loaded[0]

    return get


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs.

    It does so when the driver's JVM finds their plans to be garbage, which may take long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started inside hand tasks at most so many rows at a time: rows of long texts or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold BATCH_BYTES of strings or bytes each, or one row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    before = np.cumsum(sizes) - sizes
    cuts = np.flatnonzero(np.diff(before // BATCH_BYTES)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def in_batches(
    df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str
) -> DataFrame:
    """``mapInArrow`` over plain columns: ``rows`` maps an iterator of batches to one of results.

    A batch is a dict of lists; strings arrive as UTF-8 bytes (which are what words are cut from).
    A batch has at most BATCH_BYTES of texts, or one row. Nothing is kept between batches unless
    ``rows`` keeps it.
    """
    target = T.DataType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in (part for whole in batches for part in _parts(whole)):
            yield {
                name: (col.cast(pa.binary()) if pa.types.is_string(col.type) else col).to_pylist()
                for name, col in zip(batch.schema.names, batch.columns, strict=True)
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(plain(batches)):
            columns = [
                c if isinstance(c := out[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, target)
