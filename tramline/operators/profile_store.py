"""A kept store of profiles: what was closed once is read again, only what is missing is closed.

Below its folder a store has, for each version of a network and each run that completed it,

    profiles/version=.../run=.../part=...   o, d, dep, arr, is_flex, legs
    origins/version=.../run=...             o

An origin counts as known once its run has written its origins, which it does last. What a run
that was lost on the way has left in profiles belongs to no known origin and is never read; an origin
that two runs closed at once is read from one of them. A closure gives all
destinations of an origin, so origins are what is missing or known.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import profiles
from tramline.operators.lineage import cut, small
from tramline.operators.steps import STEP

#: Directories of a run, by a hash of the origin: a look-up reads those of its origins. Part of the layout.
PARTS = 32
_LEG = "struct<o:string,d:string,dep:int,arr:int,trip_id:string,is_flex:boolean>"
_ROWS = f"o string, d string, dep int, arr int, is_flex boolean, legs array<{_LEG}>, run string, part int"


def network_version(steps: DataFrame) -> str:
    """A name for the steps, equal for equal rows in any order: their number and sums of two hashes."""
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *STEP).cast("decimal(20,0)"))
    n, a, b = steps.agg(F.count("*"), hashed(1), hashed(2)).first()
    return f"{n}.{int(a or 0)}.{int(b or 0)}"


def _part(o):
    return F.pmod(F.xxhash64(o), F.lit(PARTS)).cast("int")


def known_origins(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(o, run): the origins whose profiles the store has, each with the run to read it from."""
    try:
        rows = spark.read.schema("o string, run string").parquet(f"{folder}/origins/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], "o string, run string")
    return rows.groupBy("o").agg(F.min("run").alias("run"))


def complete(steps: DataFrame, origins: DataFrame, folder: str, version: str | None = None, rounds: int = 1000) -> int:
    """Close and append the profiles of the origins (stop_id) that the store lacks; their number. With none, nothing is closed."""
    version = version or network_version(steps)
    known = known_origins(steps.sparkSession, folder, version)
    missing = cut(origins.select(F.col("stop_id").alias("o")).filter("o is not null").distinct().join(known.hint("merge"), "o", "left_anti"))
    lacking = missing.count()
    if lacking:
        run = uuid.uuid4().hex
        found = profiles.closure(steps, missing.withColumnRenamed("o", "stop_id"), rounds=rounds).select("o", "d", "dep", "arr", "is_flex", "legs")
        found.withColumn("part", _part("o")).repartition("part", "o").write.partitionBy("part").parquet(f"{folder}/profiles/version={version}/run={run}")
        missing.write.parquet(f"{folder}/origins/version={version}/run={run}")
    return lacking


def kept(pairs: DataFrame, folder: str, version: str) -> DataFrame:
    """(o, d, dep, arr, is_flex, legs): the profiles of pairs (o, d) as far as the store has them; only the directories of their origins are read."""
    spark = pairs.sparkSession
    wanted = cut(pairs.select("o", "d").distinct().join(known_origins(spark, folder, version).hint("merge"), "o").withColumn("part", _part("o")))
    parts = [r["part"] for r in wanted.select("part").distinct().collect()]  # PARTS at most
    if not parts:
        return spark.createDataFrame([], _ROWS).drop("run", "part")
    rows = spark.read.schema(_ROWS).parquet(f"{folder}/profiles/version={version}").filter(F.col("part").isin(parts))
    return rows.join(small(wanted), ["run", "part", "o", "d"], "left_semi").drop("run", "part")


def kept_profiles(steps: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """The minimal paths of pairs (o, d) in the network of steps, read from the store after it was completed."""
    steps = cut(steps.select(*STEP))
    version = network_version(steps)
    complete(steps, pairs.select(F.col("o").alias("stop_id")), folder, version)
    return kept(pairs, folder, version)
