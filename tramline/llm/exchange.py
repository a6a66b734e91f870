"""What tasks send each other as columns of bytes: packed arrays, keys dealt to parts by their range, chunks of rows kept in buckets."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from tramline.llm.common import BATCH_BYTES, BATCH_SETTING, shared_dir


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of equal length, their bytes turned so that like ones stand together, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), 1)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data), [], 0
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.frombuffer(raw[at : at + size], np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n))
        at += size
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, packed as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8")[0], dtype=np.uint64)


def cuts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where ascending 64-bit keys pass from one part to the next: part p has keys[cuts[p]:cuts[p + 1]]."""
    bounds = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)]])


def chunk_numbers():
    """Numbers for the chunks that a task makes, unlike those of other tasks; to be called in the task."""
    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << 32)


def bucketed(df: DataFrame, column: str, label: str) -> DataFrame:
    """df written bucketed and sorted by the column, as plain files in the shared folder: joins by it don't move it again.

    Arrow batches are cut by their bytes meanwhile, so that long texts don't make large ones.
    """
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    buckets, before = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        df.write.option("path", shared_dir(spark, label)).bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    written = spark.table(name)
    written.schema  # noqa: B018  resolves the table before its name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return written
