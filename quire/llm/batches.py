"""Sizes of Arrow batches, and the memory of workers between them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


@contextmanager
def _during(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows in what runs meanwhile; the session's own setting comes back after it."""
    return _during(spark, ROWS, rows)


def batch_bytes(spark: SparkSession, size: int = BATCH_BYTES):
    """Arrow batches that end with the row that brings them to ``size`` bytes, in what runs meanwhile.

    By rows alone a batch of wide rows, such as blocks, takes a partition's size in the executor, in direct buffers
    that double as they grow, and in the worker again.
    """
    return _during(spark, BYTES, size)


def give_back() -> None:
    """Freed memory goes back to the system: workers are used again, and each would keep the most that a task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)
