"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.session import cut

#: Bytes that separate words, as in the class [\x20\x09-\x0D].
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the written table.

    A lost executor then costs at most the work since the last settled table. The shuffle files
    behind the write are given up as soon as it ends, so that phases of a job do not add up on disk.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return cut(df)
    finally:
        conf.set(_CLEAN, before)


def give_back() -> None:
    """Return memory that this worker no longer uses. Called at the start of a batch or group: workers live
    on through later ones and later stages, and two of them share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column in one array, and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts = starts.astype(np.int64)
    return flat[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text each; one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(text))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (finalizer of splitmix64), element-wise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_for(size: int, each: int, least: int = 1) -> int:
    return max(least, -(-size // each))
