"""Small helpers for tasks that read text columns as Arrow batches."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

GROUP_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text is the empty text, other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


@lru_cache(1)
def _libc():
    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


def release() -> None:
    """Give memory that is no longer used back, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def tidy(run):
    """A task function over batches that leaves no unused memory behind."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


def raw(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its rows in them."""
    release()
    column = pc.cast(column, pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return memoryview(data if data is not None else b""), offsets


def groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, so that working arrays stay small; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def crc_rest(column: str, modulus: int):
    """Remainder of the CRC-32 of the id written in decimal digits."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
