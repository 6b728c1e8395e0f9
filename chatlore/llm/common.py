"""Helpers shared by the text operators: reading, byte words, hashes, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore.session import scratch_path

#: Rows handled at once inside a task, so that Python holds few texts at a time.
SLICE_ROWS = 256
#: Multiplier of the rolling window hash (odd, so that it has an inverse mod 2**64).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns the operators work on, whatever else ``docs`` holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_ref() -> Column:
    """A 64-bit name of a document row (its id and whole text): equal rows share it, a repeated
    ``doc_id`` with another text does not."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D (what ``bytes.split`` does)."""
    return text.split() if text else []


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the rolling hash's multiplier and its inverse, grown as longer texts come."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(1 << 16, 2 * n)
            cls.up, cls.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64))), dtype=np.uint64)
                                for x in (_BASE, _INVERSE))
        return cls.up, cls.down


class RollingHash:
    """Hashes of any windows of a sequence of 64-bit word hashes."""

    def __init__(self, h: np.ndarray):
        up, self._down = _Powers.to(len(h))
        self._sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:len(h)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def every(self, width: int) -> np.ndarray:
        """All windows of ``width`` words in order."""
        n = len(self._sums) - width
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n])


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))
