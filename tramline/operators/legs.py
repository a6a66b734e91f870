"""Legs of paths: runs on one trip, times of walks, and summaries. legs: (path_id, pos, o, d, dep, arr, trip_id, is_flex)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(paths: DataFrame, key: str = "path_id") -> DataFrame:
    return paths.select(key, F.posexplode("legs").alias("pos", "leg")).select(key, "pos", "leg.*")


def islands(legs: DataFrame, key: str = "path_id", value: str = "trip_id") -> DataFrame:
    """legs with island: the number of the run of equal values that a leg belongs to, from 0."""
    by = Window.partitionBy(key).orderBy("pos")
    change = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)), 0).otherwise(1)
    return legs.withColumn("_c", change).withColumn("island", (F.sum("_c").over(by) - 1).cast("int")).drop("_c")


def collapsed(legs: DataFrame, key: str = "path_id", value: str = "trip_id") -> DataFrame:
    """One row per run on one trip: its ends, times, and the first and last leg that make it up."""
    run = islands(legs, key, value).groupBy(key, "island", value)
    return run.agg(
        F.min_by("o", "pos").alias("o"), F.max_by("d", "pos").alias("d"), F.min_by("dep", "pos").alias("dep"), F.max_by("arr", "pos").alias("arr"), F.min("pos").alias("first_leg"), F.max("pos").alias("last_leg"), F.count("*").alias("legs")
    )


def walks_in_sequence(legs: DataFrame, key: str = "path_id") -> DataFrame:
    """legs with walks begun as soon as the leg before them ends; walks before the first ride end as it leaves."""
    by = Window.partitionBy(key).orderBy("pos")
    long = F.when(F.col("is_flex"), F.col("arr") - F.col("dep")).otherwise(0)
    seen = legs.withColumn("_sum", F.sum(long).over(by)).withColumn("_len", long)
    ride_arr = F.last(F.when(~F.col("is_flex"), F.struct("arr", "_sum")), ignorenulls=True).over(by)
    ahead = F.last(F.when(~F.col("is_flex"), F.struct("dep", "_sum")), ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("pos")))
    seen = seen.withColumn("_back", ride_arr).withColumn("_ahead", ahead)
    begin = F.when(F.col("_back").isNotNull(), F.col("_back.arr") + F.col("_sum") - F.col("_back._sum") - F.col("_len")).when(F.col("_ahead").isNotNull(), F.col("_ahead.dep") - (F.col("_ahead._sum") - F.col("_sum")) - F.col("_len")).otherwise(F.col("_sum") - F.col("_len"))
    dep = F.when(F.col("is_flex"), begin).otherwise(F.col("dep")).cast("int")
    arr = F.when(F.col("is_flex"), begin + F.col("_len")).otherwise(F.col("arr")).cast("int")
    return seen.select(*[dep.alias(c) if c == "dep" else arr.alias(c) if c == "arr" else F.col(c) for c in legs.columns])


def walks_at_last_moment(legs: DataFrame, key: str = "path_id") -> DataFrame:
    """legs with walks put right before the next ride; those after the last ride stay as they are."""
    back = Window.partitionBy(key).orderBy(F.desc("pos"))
    long = F.when(F.col("is_flex"), F.col("arr") - F.col("dep")).otherwise(0)
    seen = legs.withColumn("_sum", F.sum(long).over(back)).withColumn("_len", long)
    seen = seen.withColumn("_next", F.last(F.when(~F.col("is_flex"), F.struct("dep", "_sum")), ignorenulls=True).over(back))
    end = F.col("_next.dep") - (F.col("_sum") - F.col("_next._sum") - F.col("_len"))
    moved = F.col("is_flex") & F.col("_next").isNotNull()
    dep, arr = F.when(moved, end - F.col("_len")).otherwise(F.col("dep")).cast("int"), F.when(moved, end).otherwise(F.col("arr")).cast("int")
    return seen.select(*[dep.alias(c) if c == "dep" else arr.alias(c) if c == "arr" else F.col(c) for c in legs.columns])


def broken(legs: DataFrame, key: str = "path_id") -> DataFrame:
    """Legs that don't begin where the one before ends, or arrive earlier than it."""
    by = Window.partitionBy(key).orderBy("pos")
    bad = (F.col("o") != F.lag("d").over(by)) | (F.col("arr") < F.lag("arr").over(by))
    return legs.withColumn("_bad", F.coalesce(bad, F.lit(False))).filter("_bad").drop("_bad")


def summaries(legs: DataFrame, key: str = "path_id") -> DataFrame:
    """(path_id, o, d, dep, arr, legs, total): where and when a path begins and ends."""
    return legs.groupBy(key).agg(
        F.min_by("o", "pos").alias("o"), F.max_by("d", "pos").alias("d"), F.min_by("dep", "pos").alias("dep"), F.max_by("arr", "pos").alias("arr"), F.count("*").alias("legs"), (F.max_by("arr", "pos") - F.min_by("dep", "pos")).alias("total")
    )


def without_boundary(legs: DataFrame) -> DataFrame:
    return legs.filter(~F.col("o").isin("START") & ~F.col("d").isin("END"))
