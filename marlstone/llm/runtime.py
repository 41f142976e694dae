"""What the operators share: code on the executors, tables that cut lineage, size checks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

from marlstone.scratch import drop, hinted, materialize, release, ship

__all__ = ["chunks", "drop", "give_back", "hinted", "materialize", "partitions", "release", "ship", "tidy", "worker_cache"]

_cache: tuple[str, Any] = ("", None)


def worker_cache(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: of one operator at a time, so that the caches of
    the stages that a worker has served don't add up."""
    global _cache
    if _cache[0] != key:
        _cache = ("", None)
        give_back()
        _cache = (key, make())
    return _cache[1]


def give_back() -> None:
    """Return what is no longer used to the system, or a worker keeps what its largest stage took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, with memory given back behind a task, as Spark keeps idle workers."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first, texts as bytes) of runs of about `most` bytes; null is empty."""
    held, size, start = [], 0, 0
    for i, x in enumerate(column):
        b = x.as_py() or b""
        held.append(b)
        size += len(b)
        if size >= most:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held
