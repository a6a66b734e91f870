"""As-of joins by one shuffle, one sort and a window: the next row of the other side, and connections of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators.steps import minimal_cover

#: Seconds of a day that a task sorts at once for one pair of stops.
SPAN = 3 * 3600


def asof_next(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False, span: int | None = None) -> DataFrame:
    """left with columns of the first right row of equal keys at or after (strict: after) its time; null if none.

    Both sides are laid together and sorted by (keys, time) backwards, so that the
    window only looks at rows it has passed: a key's rows are read once, and there is
    no range join and no product. Of right rows at the same time the one that is least
    in columns counts. Rows with a null key or time find nothing.

    span cuts the times of a key into pieces of so many units, each sorted by a task
    of its own, so that one key with most of the rows is split; the first right row of
    every piece goes on to the pieces before it.
    """
    payload = F.struct(F.col(right_time), *[F.col(c) for c in columns])
    kept = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 if strict else 0).alias("_k"), F.struct(*kept).alias("_l"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_r"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0 if strict else 1).alias("_k"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    both, piece = a.unionByName(b), []
    if span:
        piece = ["_piece"]
        both = both.withColumn("_piece", F.floor(F.col("_t") / span).cast("long"))
        both = both.unionByName(_carried(both, keys, columns))
    back = Window.partitionBy(*keys, *piece).orderBy(F.col("_t").desc_nulls_last(), F.desc("_k"), *[F.col(f"_r.{c}").desc_nulls_last() for c in columns])
    seen = both.withColumn("_next", F.when(F.col("_t").isNotNull(), F.last("_r", ignorenulls=True).over(back))).filter("_l is not null")
    return seen.select(*keys, "_l.*", F.col(f"_next.{right_time}").alias(f"next_{right_time}"), *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def _carried(both: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each piece of a key's times with left rows the first right row of the pieces after it, as a row at its end: one a piece."""
    first = both.filter("_r is not null").groupBy(*keys, "_piece").agg(F.min(F.struct("_t", *[F.col(f"_r.{c}").alias(f"_{i}") for i, c in enumerate(columns)], "_r")).alias("_f"))
    # Of left rows only the pieces count, which need no sort; a piece's own right row comes after it.
    asked = both.filter("_l is not null").select(*keys, "_piece").distinct()
    later = Window.partitionBy(*keys).orderBy(F.col("_piece").desc_nulls_last(), F.col("_r").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    pieces = asked.unionByName(first.select(*keys, "_piece", "_f._r"), allowMissingColumns=True)
    held = pieces.withColumn("_next", F.last("_r", ignorenulls=True).over(later)).filter("_r is null and _next is not null and _piece is not null").withColumn("_r", F.col("_next"))
    kinds = dict(zip(both.columns, both.schema.fields, strict=True))
    # After every other row of the piece: the row's own time is that of a later one.
    return held.select(*keys, F.col("_r").getField(both.schema["_r"].dataType.fieldNames()[0]).cast(kinds["_t"].dataType).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(kinds["_l"].dataType).alias("_l"), "_r", "_piece")


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str) -> DataFrame:
    """left with last_<right_time>: the latest time of a right row of equal keys at or before its own; null if none."""
    a = left.withColumn("_t", F.col(left_time)).withColumn("_k", F.lit(1)).withColumn("_r", F.lit(None).cast(right.schema[right_time].dataType))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_k"), F.col(right_time).alias("_r"))
    order = Window.partitionBy(*keys).orderBy("_t", "_k")
    seen = a.unionByName(b, allowMissingColumns=True).withColumn(f"last_{right_time}", F.last("_r", ignorenulls=True).over(order))
    return seen.filter("_k = 1").select(*left.columns, f"last_{right_time}")


def connections(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = (), cover: bool = True) -> DataFrame:
    """Steps o -> d over one change: each step of first with the best step of second that leaves its end.

    first, second: minimal covers with columns o, d, dep, arr, trip_id, is_flex;
    keys: further columns of first that keep groups apart and ride along. The
    result has via, first_trip and second_trip besides. Rides catch the earliest
    ride at or after their arrival; walks combine with every step; the minimal
    cover then keeps the latest leave of what is left.
    """
    keys = list(keys)
    ride1, walk1 = first.filter("not is_flex"), first.filter("is_flex")
    ride2, walk2 = second.filter("not is_flex"), second.filter("is_flex")
    a = ride1.select(*keys, "o", F.col("d").alias("via"), "dep", F.col("arr").alias("at"), F.col("trip_id").alias("first_trip"))
    ends = second.select(F.col("o").alias("via"), "d").distinct()
    # Each arrival is looked up once for every stop that can be reached from there.
    looked = asof_next(
        a.join(ends, "via"), ride2.select(F.col("o").alias("via"), "d", F.col("dep").alias("leave"), "arr", "trip_id"), ["via", "d"], "at", "leave", ["arr", "trip_id"], span=SPAN
    ).filter("next_leave is not null")
    rides = looked.select(*keys, "o", "via", "d", "dep", F.col("next_arr").alias("arr"), "first_trip", F.col("next_trip_id").alias("second_trip"), F.lit(False).alias("is_flex"))

    def product(x, y):
        p = x.select(*keys, "o", F.col("d").alias("via"), F.col("dep").alias("dep1"), F.col("arr").alias("arr1"), F.col("is_flex").alias("f1"), F.col("trip_id").alias("first_trip"))
        q = y.select(F.col("o").alias("via"), "d", F.col("dep").alias("dep2"), F.col("arr").alias("arr2"), F.col("is_flex").alias("f2"), F.col("trip_id").alias("second_trip"))
        flex, dep, arr = C.merged_step(F.col("f1"), F.col("dep1"), F.col("arr1"), F.col("f2"), F.col("dep2"), F.col("arr2"))
        return p.join(q, "via").select(*keys, "o", "via", "d", dep.alias("dep"), arr.alias("arr"), "first_trip", "second_trip", flex.alias("is_flex"))

    every = rides.unionByName(product(walk1, second)).unionByName(product(ride1, walk2)).filter("o <> d")
    every = every.withColumn("trip_id", F.concat_ws(">", "first_trip", "second_trip"))
    return minimal_cover(every, (*keys, "o", "d"), ("via", "trip_id")) if cover else every


def next_departures(queries: DataFrame, rides: DataFrame) -> DataFrame:
    """queries (query_id, stop, at) with, for each stop reached from there, the first ride at or after that time."""
    ends = rides.select(F.col("o").alias("stop"), "d").distinct()
    right = rides.select(F.col("o").alias("stop"), "d", F.col("dep").alias("leave"), "arr", "trip_id")
    found = asof_next(queries.join(ends, "stop"), right, ["stop", "d"], "at", "leave", ["arr", "trip_id"], span=SPAN).filter("next_leave is not null")
    return found.select("query_id", "stop", "at", "d", F.col("next_leave").alias("dep"), F.col("next_arr").alias("arr"), F.col("next_trip_id").alias("trip_id"))


def best_next(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """current (id, stop, at) with the step that arrives first at each d, a ride or a walk; a ride wins a tie.

    Equal stops and times are looked up once, and their steps joined back: what is sorted for each destination
    grows with the stops and times of a day, not with those who ask. Only ids with several rows are ranked after that.
    """
    # Dealt by id, so that equal rows and the rows of an id are found after one shuffle.
    asked = current.select("id", "stop", "at").repartition("id").distinct().withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    found = _first_steps(current.select("stop", "at").distinct(), candidates).withColumnRenamed("stop", "_stop").withColumnRenamed("at", "_at")

    def joined(which: str) -> DataFrame:
        return asked.filter(which).join(found.hint("merge"), (F.col("stop") == F.col("_stop")) & F.col("at").eqNullSafe(F.col("_at"))).select("id", "d", "dep", "arr", "trip_id", "is_flex")

    rank = F.row_number().over(Window.partitionBy("id", "d").orderBy(F.asc_nulls_last("arr"), "is_flex", "trip_id"))
    return joined("_n = 1").unionByName(joined("_n > 1").withColumn("_r", rank).filter("_r = 1").drop("_r"))


def _first_steps(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """asked (stop, at), distinct, with the step (dep, arr, trip_id, is_flex) that arrives first at each d."""
    walk = F.struct((F.col("arr") - F.col("dep")).alias("w"), "trip_id")
    ends = candidates.groupBy(F.col("o").alias("stop"), "d").agg(F.min(F.when(F.col("is_flex"), walk)).alias("_walk"))
    rides = candidates.filter("not is_flex").select(F.col("o").alias("stop"), "d", F.col("dep").alias("leave"), "arr", "trip_id")
    # By a merge join, which leaves rows of a stop together: they compress better than those of a broadcast.
    seen = asof_next(asked.join(ends.hint("merge"), "stop"), rides, ["stop", "d"], "at", "leave", ["arr", "trip_id"], span=SPAN)
    on_foot = F.col("at") + F.col("_walk.w")
    step = lambda dep, arr, trip, flex: F.struct(dep.alias("dep"), arr.alias("arr"), trip.alias("trip_id"), F.lit(flex).alias("is_flex"))
    ride, walked = step(F.col("next_leave"), F.col("next_arr"), F.col("next_trip_id"), False), step(F.col("at"), on_foot, F.col("_walk.trip_id"), True)
    best = F.when(F.col("next_leave").isNotNull() & (F.col("_walk").isNull() | (F.col("next_arr") <= on_foot)), ride).when(F.col("_walk").isNotNull(), walked)
    return seen.withColumn("_best", best).filter("_best is not null").select("stop", "at", "d", "_best.*")
