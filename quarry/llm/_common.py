"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, filesystem  # noqa: F401
from quarry.shipping import ship

#: Text handled at once inside a task; longer single texts form a block of their own.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a given table; other columns (clashing names included) are never read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the
    lineage, survives lost executors, and later passes do not recompute it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest(rows: DataFrame, key: Column, n: int, total: int, name: str, *ties: Column) -> DataFrame:
    """The ``n`` rows of smallest ``key``, a 64-bit hash; ``total`` is about how many rows
    there are. Only rows below a bound that leaves about twice ``n`` are ordered, so the
    task that takes the first ``n`` does not grow with the partitions; the bound is raised
    until enough rows lie below it."""
    share = 2 * n / max(1, total)
    while share < 1:
        near = stored(rows.filter(key <= F.lit(int(share * (1 << 64)) - (1 << 63))), name)
        if near.count() >= n:
            return near.orderBy(key, *ties).limit(n)
        share *= 4
    return rows.orderBy(key, *ties).limit(n)


def prepare(df: DataFrame) -> SparkSession:
    """Make the package importable in Python workers; returns the session."""
    spark = df.sparkSession
    ship(spark)
    return spark


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text",
           max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose text column holds about ``max_bytes``, so the
    Python objects of one slice stay small whatever the batch size is."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype("int64") + 1)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for other stages, and what
    it keeps for itself counts beside the memory of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere the allocator decides
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts of a batch as Python strings; null counts as the empty text."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def keep(docs: DataFrame, decide: Callable[[list[str]], list[bool]]) -> DataFrame:
    """Rows of ``docs`` whose text ``decide`` keeps, with all columns, in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.filter(pa.array(decide(texts_of(block)), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
