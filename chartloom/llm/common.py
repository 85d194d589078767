"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartloom.session import scratch_folder

#: White space as tokenizers see it (Unicode White_Space), for a character class.
WHITE = "\t-\r \x85\xa0  -     　"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it again: lineage ends at files that every
    executor can reach, so a lost executor costs only its running tasks."""
    path = scratch_folder(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000):
    """Fewer rows in an Arrow batch for what runs inside, where rows are whole texts or sets of hashes:
    a batch stands twice in the JVM's and twice in Python's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_of(column: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def worker_store(name: str, make: Callable[[], object]) -> object:
    """A value kept for the life of a Python worker.

    Task functions travel by value, so globals of this package are new in each task; tokenizers and
    caches are costly enough to keep between tasks. Nothing in the store changes a result.
    """
    store = sys.modules["sys"].__dict__.setdefault("_chartloom_store", {})
    if name not in store:
        store[name] = make()
    return store[name]


def give_back() -> None:
    """Returns a worker's free memory to the machine after a task; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: list[str], most_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts sum up to about ``most_chars``, so that one Arrow batch of long texts
    is never expanded into Python objects at once."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def parts_of(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of a text or binary column, so that only a slice at a
    time becomes Python objects."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def binary_views(column: pa.Array, kind) -> Iterator[np.ndarray]:
    """Each value of a binary column without nulls as an array over the column's own memory."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
        yield np.frombuffer(raw[start:end].tobytes(), kind) if start % 8 else raw[start:end].view(kind)
