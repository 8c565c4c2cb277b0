"""Helpers for ``mapInArrow`` operators: small slices of batches, and one object per worker built from shipped bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

from threadloom.session import ship_package

SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           most: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut batches into slices of few rows and bytes, with the texts of each slice."""
    for batch in batches:
        at, rows = 0, batch.num_rows
        column = batch.column(text)
        while at < rows:
            n = min(most, rows - at)
            while n > 1 and column.slice(at, n).nbytes > SLICE_BYTES:
                n //= 2
            yield batch.slice(at, n), column.slice(at, n).to_pylist()
            at += n


def file_broadcast(spark: SparkSession, path: str):
    """A vocabulary file's bytes for all workers. Its size is that of the vocabulary, not of the data."""
    ship_package(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_built: dict[tuple[str, str], Any] = {}


def built_once(kind: Callable[..., Any], content: bytes, *args) -> Any:
    """``kind(content, *args)``, kept for later tasks of this worker until it builds another.

    Workers outlive a stage: one that goes from operator to operator holds the tables and caches of the last only.
    """
    key = (kind.__qualname__, hashlib.sha256(content + repr(args).encode()).hexdigest())
    if key not in _built:
        _built.clear()
        _built[key] = kind(content, *args)
    return _built[key]


def forget_built() -> None:
    """For operators that build nothing: what an earlier one left in this worker goes before they need memory."""
    if _built:
        _built.clear()
        pa.default_memory_pool().release_unused()


class Memo(dict):
    """A dict that computes missing values and forgets all of them when it holds ``most``. Long keys are not kept."""

    def __init__(self, compute: Callable[[str], Any], most: int = 400_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key: str):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
