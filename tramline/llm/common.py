"""Shared helpers: the shared folder, tables that cut lineage, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: A word, as a regular expression of Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the Arrow batches that tasks exchange with Python while a table is written.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
#: Rows up to which a table that was written out and counted may be broadcast.
BROADCAST_ROWS = 20_000


def fresh(taken, *names: str) -> list[str]:
    """The names, each with underscores added until it equals none of the taken ones in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def set_aside(docs: DataFrame, *names: str):
    """(docs, back): columns of docs called like one of the names get others; back(df) selects all columns of docs from df under their own names."""
    held = dict(zip(docs.columns, fresh(names, *docs.columns), strict=True))
    back = lambda df: df.select(*[F.col(f"`{held[c]}`").alias(c) for c in docs.columns])
    return docs.select(*[F.col(f"`{c}`").alias(held[c]) for c in docs.columns]), back


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local session gets a temporary folder; a
    cluster has to name one, so that no executor writes to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: one evaluation, no lineage.

    Meanwhile Arrow batches are cut by their bytes, so that long texts don't make large ones.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, label), spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small: broadcast only after its rows were counted, else a merge join.

    right should be a written table, so that counting it is cheap.
    """
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def tidy(f):
    """f for mapInArrow, giving back what memory its task freed: Spark keeps Python workers from stage to stage."""

    def run(it):
        yield from f(it)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def slices(it, rows: int = 1_000):
    """The batches of it in pieces of a bounded number of rows."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def same_columns(docs: DataFrame, columns) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in columns])
