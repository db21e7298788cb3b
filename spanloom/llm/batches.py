"""Arrow batches of bounded sizes, and bounded caches of a worker."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession


#: spans that a worker remembers
CACHE_ENTRIES = 400_000
#: what tasks of one kind leave to the next of their kind on the same worker
lasting: list[dict] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands workers at most 1,000 rows or 8 MB of whole texts at a time: an
    executor holds several copies of a batch outside its heap.  Smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back(keep: dict | None = None) -> None:
    """At the end of a task: return to the system what this worker's allocators keep, and forget what tasks
    of other kinds left; the worker lives on."""
    for held in lasting:
        if held is not keep:
            held.clear()
    pa.default_memory_pool().release_unused()
    _trim(0)


def make_room(cache: dict, more: int = 1) -> None:
    """Forget the older half of a full cache; what is frequent comes back at once."""
    if len(cache) + more > CACHE_ENTRIES:
        rest = dict(islice(cache.items(), len(cache) // 2, None)) if len(cache) // 2 + more <= CACHE_ENTRIES else {}
        cache.clear()
        cache.update(rest)


def parts(b: pa.RecordBatch, column: int = 1, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a text or binary column each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        done = ends[at - 1] if at else 0
        k = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield b.slice(at, k - at)
        at = k
