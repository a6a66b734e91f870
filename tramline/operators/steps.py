"""Steps between stops: from stop times, by walking, minimal covers, and steps merged over connections.

A step is a row (o, d, dep, arr, trip_id, is_flex). A walk is flexible: it may
begin at any time and is kept as dep = 0, arr = its seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators.lineage import cut

STEP = ["o", "d", "dep", "arr", "trip_id", "is_flex"]


def from_stop_times(stop_times: DataFrame) -> DataFrame:
    """Rides between consecutive stop times of a trip: they leave at the departure and end at the next arrival."""
    by = Window.partitionBy("trip_id").orderBy("stop_sequence")
    rows = stop_times.select(F.col("stop_id").alias("o"), F.lead("stop_id").over(by).alias("d"), F.col("departure").alias("dep"), F.lead("arrival").over(by).alias("arr"), "trip_id")
    return rows.filter("d is not null").withColumn("is_flex", F.lit(False))


def positions(stops: DataFrame, latitude: float = C.REFERENCE_LATITUDE) -> DataFrame:
    """(stop_id, x, y) in metres."""
    return stops.select("stop_id", C.metres_x(F.col("stop_lon"), latitude).alias("x"), C.metres_y(F.col("stop_lat")).alias("y"))


def near_pairs(points: DataFrame, limit: float, others: DataFrame | None = None) -> DataFrame:
    """(o, d, metres): pairs of different points at most limit apart, in both directions; d from others, if given.

    Points meet through cells of the limit's size: each point is put in its cell,
    the other one in the nine cells about its own.
    """
    cell = lambda c: F.floor(F.col(c) / limit).cast("long")
    left = points.select(F.col("stop_id").alias("o"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = (points if others is None else others).select(F.col("stop_id").alias("d"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(around).alias("i")).select("*", F.explode(around).alias("j"))
    right = right.select("d", "x2", "y2", (F.floor(F.col("x2") / limit).cast("long") + F.col("i")).alias("cx"), (F.floor(F.col("y2") / limit).cast("long") + F.col("j")).alias("cy"))
    metres = C.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return left.join(right.hint("merge"), ["cx", "cy"]).filter(F.col("o") != F.col("d")).withColumn("metres", metres).filter(F.col("metres") <= limit).select("o", "d", "metres")


def walking(stops: DataFrame, limit: float = 500.0, speed: float = 1.0) -> DataFrame:
    """Walks between stops at most limit metres apart; none if the speed isn't positive."""
    pairs = near_pairs(positions(stops), limit)
    if speed <= 0:
        pairs = pairs.limit(0)
    return pairs.select("o", "d", F.lit(0).alias("dep"), C.walk_seconds(F.col("metres"), max(speed, 1e-9)).alias("arr"), F.concat(F.lit("walk:"), "o", F.lit(":"), "d").alias("trip_id"), F.lit(True).alias("is_flex"))


def minimal_cover(steps: DataFrame, keys: tuple[str, ...] = ("o", "d"), tie: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """The steps that no other one of the same keys replaces; other columns ride along.

    Of walks the last shortest stays. A ride stays if no later one arrives as early
    and no walk is as short. tie makes the order of equal rides total: the last stays.
    """
    # Walks come first, the shortest before others, then rides from the last to the first: one sort, and
    # each row only needs rows before it.
    long = F.col("arr") - F.col("dep")
    order = Window.partitionBy(*keys).orderBy(F.desc("is_flex"), F.when(F.col("is_flex"), long), F.desc("dep"), "arr", *[F.desc(t) for t in tie])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = steps.withColumn("_walk", F.min(F.when(F.col("is_flex"), long)).over(before)).withColumn("_later", F.min(F.when(~F.col("is_flex"), F.col("arr"))).over(before)).withColumn("_rank", F.row_number().over(order))
    ride = ~F.col("is_flex") & (F.col("_later").isNull() | (F.col("arr") < F.col("_later"))) & (F.col("_walk").isNull() | (long < F.col("_walk")))
    return seen.filter(ride | (F.col("is_flex") & (F.col("_rank") == 1))).drop("_walk", "_later", "_rank")


def with_later_arrival(rides: DataFrame, keys: tuple[str, ...] = ("o", "d"), tie: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """rides with later: the earliest arrival of those after them in the order of a cover; null for the last."""
    back = Window.partitionBy(*keys).orderBy(F.desc("dep"), "arr", *[F.desc(t) for t in tie])
    return rides.withColumn("later", F.min("arr").over(back.rowsBetween(Window.unboundedPreceding, -1)))


def in_order(steps: DataFrame) -> DataFrame:
    """steps with place: their order in a pair, walks first, then by departure, the latest arrival before others."""
    return steps.withColumn("place", F.row_number().over(Window.partitionBy("o", "d").orderBy(F.desc("is_flex"), "dep", F.desc("arr"), "trip_id")))


def unrepresentable(steps: DataFrame, width: int = 120, low: int = -32_768, high: int = 32_767) -> DataFrame:
    """steps whose departure has no bucket of width seconds in 16 bits."""
    return steps.filter(~F.floor(F.col("dep") / width).between(low, high))


def dominated(rides: DataFrame) -> DataFrame:
    """Rides that another one of the same stops replaces, by the definition; quadratic in a pair's rides, for tests."""
    a, b = rides.alias("a"), rides.alias("b")
    better = (F.col("b.dep") >= F.col("a.dep")) & (F.col("b.arr") <= F.col("a.arr"))
    later = (F.col("b.dep") > F.col("a.dep")) | (F.col("b.arr") < F.col("a.arr")) | (F.col("b.trip_id") > F.col("a.trip_id"))
    return a.join(b, (F.col("a.o") == F.col("b.o")) & (F.col("a.d") == F.col("b.d")) & better & later, "left_semi")


def boundary(stops: DataFrame, start: str = "START", end: str = "END") -> DataFrame:
    """Edges of no duration from the start to every stop and from every stop to the end."""
    rows = stops.select(F.explode(F.array(F.struct(F.lit(start).alias("o"), F.col("stop_id").alias("d")), F.struct(F.col("stop_id").alias("o"), F.lit(end).alias("d")))).alias("e"))
    return rows.select("e.o", "e.d", F.lit(0).alias("dep"), F.lit(0).alias("arr"), F.lit("boundary").alias("trip_id"), F.lit(True).alias("is_flex"))


def nearest_stop(stops: DataFrame, limit: float = 2000.0) -> DataFrame:
    """(stop_id, metres): the distance to the nearest other stop. Stops without one within limit look twice as far, until all have one."""
    points = cut(positions(stops))
    if points.limit(2).count() < 2:
        return points.select("stop_id", F.lit(0.0).alias("metres")).limit(0)
    nearest = lambda left: near_pairs(left, limit, points).groupBy("o").agg(F.min("metres").alias("metres")).withColumnRenamed("o", "stop_id")
    found = cut(nearest(points))
    while not (rest := points.join(found, "stop_id", "left_anti")).isEmpty():
        limit *= 2
        found = cut(found.unionByName(nearest(rest)))
    return found


def out_of_order(cover: DataFrame) -> DataFrame:
    """Violations of a sorted minimal cover: rides that a neighbour or a walk of the same pair replaces."""
    by = Window.partitionBy("o", "d")
    rides = cover.withColumn("_walk", F.min(F.when(F.col("is_flex"), F.col("arr") - F.col("dep"))).over(by)).filter("not is_flex")
    order = by.orderBy("dep", F.desc("arr"), "trip_id")
    bad = (F.col("dep") <= F.lag("dep").over(order)) | (F.col("arr") <= F.lag("arr").over(order)) | (F.col("arr") - F.col("dep") >= F.col("_walk"))
    return rides.withColumn("_bad", F.coalesce(bad, F.lit(False))).filter("_bad").drop("_bad", "_walk")
