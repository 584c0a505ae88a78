"""Arrow helpers: move texts in and out of tasks in pieces of bounded size."""

from __future__ import annotations

import ctypes
import gc
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from panelloom.operators import batches as arrow

SLICE_BYTES = 4 << 20
BATCH_BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, after the session's Arrow batches are held to `BATCH_BYTES`; executors keep buffers of their size."""
    return arrow.small_batches(df, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece take about `size` bytes (one row at least)."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch[column].cast(pa.binary()))
        start = used = 0
        for at, n in enumerate(lengths.to_pylist()):
            if used and used + (n or 0) > size:
                _USED[0] = time.monotonic()
                yield batch.slice(start, at - start)
                start, used = at, 0
            used += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
        _USED[0] = time.monotonic()


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch[column].cast(pa.binary()).to_pylist()]


IDLE_SECONDS = 4.0
_KEPT: dict = {}
_USED = [0.0]


def kept(key: tuple, make):
    """One object that a worker keeps from task to task, until it has had no task for some seconds."""
    _USED[0] = time.monotonic()
    found = _KEPT.get(key)  # a reference of its own: the table may be cleared meanwhile
    if found is None:
        _KEPT.clear()
        found = _KEPT[key] = make()
        give_back()  # what only its making took
        threading.Thread(target=_drop_idle, daemon=True).start()
    return found


def _drop_idle() -> None:
    while _KEPT:
        time.sleep(IDLE_SECONDS / 4)
        if time.monotonic() - _USED[0] > IDLE_SECONDS:
            forget()


def forget() -> None:
    """Drop what an operator before this one has kept in the worker, and give its memory back."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """The function of a task over Arrow batches; at its end the worker gives back what it has freed.

    Spark takes an executor's workers in turn, so there are more of them than tasks at a time, and each would
    wait with the most that any of its tasks has held.
    """
    def task(batches):
        yield from run(batches)
        give_back()

    return task


class Bounded(dict):
    """A cache that starts anew when it holds `limit` entries; it only saves time."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
