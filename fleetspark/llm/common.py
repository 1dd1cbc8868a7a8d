"""What several operators of this subpackage share: lineage cuts and chunks of Arrow rows."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from fleetspark.sources.storage import cut, shared_folder

__all__ = ["chunks", "cut", "plain_strings", "release", "shared_folder", "text_bytes", "tidy"]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps before the next step writes its own.

    The cleaner acts when the driver's collector finds a shuffle unreachable; a long job with a
    small driver heap otherwise keeps every step's files to its end. It works in the background.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def tidy() -> None:
    """Called by a task's Python part when it is through: gives what Arrow and the allocator hold free back to the
    machine, as Spark keeps the worker for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plain_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls (a null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def text_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of each text) of what ``plain_strings`` returns."""
    if len(strings) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int, most_rows: int = 50_000) -> Iterator[pa.Table]:
    """The rows in order, in tables of about ``most_bytes`` of text; a longer text has one of its own."""
    held: list[pa.RecordBatch] = []
    n_bytes = n_rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), most_bytes - n_bytes, side="right")
            room = int(min(room, most_rows - n_rows, batch.num_rows - at))
            if room == 0 and not held:
                room = 1
            if room:
                held.append(batch.slice(at, room))
                n_bytes += int(sizes[at : at + room].sum())
                n_rows += room
                at += room
            if at < batch.num_rows or n_bytes >= most_bytes or n_rows >= most_rows:
                yield pa.Table.from_batches(held)
                held, n_bytes, n_rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
