"""Loops over DataFrames: cutting lineage in the shared folder, and iterating until nothing changes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of spark.checkpoint.dir, without lineage.

    Where the setting is missing a local session gets a temporary folder; a
    cluster has to name one that all executors share.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str = "rows") -> DataFrame:
    """df computed once, written as Parquet below spark.checkpoint.dir and read back: for large tables, of which each use reads only its columns."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df for the right side of a join: broadcast if it has at most so many rows, which are counted, else merged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def until_stable(start: DataFrame, step, rounds: int) -> DataFrame:
    """step(all rows so far, rows new in the last round) -> all rows; repeated until no row is new, rounds times at most.

    Rows are compared as a whole, so step must return them in a canonical form.
    """
    now = cut(start)
    new = now
    for _ in range(rounds):
        after = cut(step(now, new))
        new = cut(after.exceptAll(now))
        now = after
        if new.isEmpty():
            return now
    raise RuntimeError(f"rows still change after {rounds} rounds")


def shared_folder(spark, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.getCheckpointDir():
            cut(spark.range(1))  # sets the folder of a local session, or raises
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
