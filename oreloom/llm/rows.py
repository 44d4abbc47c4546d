"""Arrow batch helpers for operators that run Python on whole texts."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext

#: Characters of text handled at once inside a batch; bounds Python memory, not results.
CHUNK_CHARS = 2_000_000


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list]]:
    """(first row, end row, values) slices of a batch holding about ``most`` characters each."""
    values = batch.column(batch.schema.get_field_index(column))
    n, start = len(values), 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist() if n else []
    total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most or i + 1 - start >= 2048:
            yield start, i + 1, values.slice(start, i + 1 - start).to_pylist()
            start, total = i + 1, 0
    if start < n:
        yield start, n, values.slice(start).to_pylist()


def pieces(array: pa.Array, most: int = CHUNK_CHARS) -> Iterator[list]:
    """Values of an array of texts, about ``most`` characters at once."""
    for _, _, values in chunks(pa.RecordBatch.from_arrays([array], ["text"]), "text", most):
        yield values


def released(found: Iterator) -> Iterator:
    """``found``; gives buffers back at the end, as workers live on between tasks."""
    yield from found
    pa.default_memory_pool().release_unused()


def task_base() -> int:
    """First of 2^33 row numbers that no other task of the stage uses."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 33


def per_worker(key: tuple, make: Callable[[], object]):
    """``make()``, once per Python worker process and key: tasks that follow reuse it.

    For encoders, whose memory is bounded and whose results don't depend on what they saw.
    """
    held = sys.modules.setdefault("_oreloom_worker", types.ModuleType("_oreloom_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
