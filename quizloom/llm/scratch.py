"""Intermediate tables in the folder that all executors share, and the size of batches that go to Python."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from quizloom.sources.scratch import new_dir, remove, shared_dir, store, stored

__all__ = ["new_dir", "remove", "shared_dir", "small_batches", "store", "stored"]

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs inside hand Python so many rows at once at most: rows that hold whole texts or shingle sets are large."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
