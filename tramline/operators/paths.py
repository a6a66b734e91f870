"""Paths, rows (path_id, o, d, dep, arr, is_flex, legs): their stops, filters, and what they are part of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators.profiles import run_times

LEG = "struct<o:string,d:string,dep:int,arr:int,trip_id:string,is_flex:boolean>"


def of_legs(legs: DataFrame, key: str = "path_id") -> DataFrame:
    """One path a key from its legs (key, pos, o, d, dep, arr, trip_id, is_flex); times follow from the legs."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct("o", "d", "dep", "arr", "trip_id", "is_flex").alias("leg"))))
    rows = legs.groupBy(key).agg(F.transform(ordered, lambda x: x["leg"]).alias("legs"))
    return rows.select(key, F.col("legs")[0]["o"].alias("o"), F.element_at("legs", -1)["d"].alias("d"), *run_times(F.col("legs")), "legs")


def of_trips(steps: DataFrame) -> DataFrame:
    """Each trip as a path over its rides, in the order of their departures."""
    return of_legs(steps.withColumn("pos", F.col("dep")).withColumn("path_id", F.col("trip_id")))


def stops_of(legs):
    """All stops of a path, both ends included."""
    return F.concat(F.array(F.get(legs, F.lit(0))["o"]), F.transform(legs, lambda x: x["d"]))


def inner_stops(legs):
    """The stops between the ends; [] for a path of one leg."""
    return F.slice(F.transform(legs, lambda x: x["d"]), F.lit(1), F.greatest(F.size(legs) - 1, F.lit(0)))


def zero_edges(pairs: DataFrame) -> DataFrame:
    """Edges of no duration for pairs (o, d); they belong to no trip."""
    return pairs.select("o", "d", F.lit(0).alias("dep"), F.lit(0).alias("arr"), F.lit("none").alias("trip_id"), F.lit(True).alias("is_flex"))


def merged_neighbours(legs: DataFrame, key: str = "path_id") -> DataFrame:
    """(key, pos, dep, arr, is_flex): each leg merged with the one before it; first legs have none."""
    by = Window.partitionBy(key).orderBy("pos")
    was = lambda c: F.lag(c).over(by)
    flex, dep, arr = C.merged_step(was("is_flex"), was("dep"), was("arr"), F.col("is_flex"), F.col("dep"), F.col("arr"))
    return legs.select(key, "pos", dep.alias("dep"), arr.alias("arr"), flex.alias("is_flex")).filter("is_flex is not null")


def from_midnight(paths: DataFrame) -> DataFrame:
    return paths.filter("dep >= 0")


def in_window(paths: DataFrame, low: int, high: int) -> DataFrame:
    """Paths that leave in [low, high); walks may leave at any time."""
    return paths.filter(F.col("is_flex") | ((F.col("dep") >= low) & (F.col("dep") < high)))


def not_through(paths: DataFrame, required: DataFrame) -> DataFrame:
    """Paths with no required stop (stop_id) between their ends, which count as passed through only there."""
    passed = paths.select("path_id", "o", "d", F.explode(inner_stops(F.col("legs"))).alias("stop_id")).filter("stop_id <> o and stop_id <> d")
    return paths.join(passed.join(required.select("stop_id").distinct(), "stop_id").select("path_id").distinct(), "path_id", "left_anti")


def shortest(paths: DataFrame, keys: tuple[str, ...] = ("o", "d")) -> DataFrame:
    """The paths of least duration of each pair of ends, with all ties."""
    long = F.col("arr") - F.col("dep")
    return paths.withColumn("_least", F.min(long).over(Window.partitionBy(*keys))).filter(long == F.col("_least")).drop("_least")


def with_paths(steps: DataFrame, paths: DataFrame) -> DataFrame:
    """steps (o, d, dep, arr, is_flex) with the legs of the paths that they stand for; a step without one raises.

    Rides meet by their times, walks by being walks.
    """
    times = ["dep", "arr"]
    meet = lambda df: df.select("*", *[F.when(~F.col("is_flex"), F.col(c)).alias(f"_{c}") for c in times])
    right = meet(paths).select(F.col("o").alias("_o"), F.col("d").alias("_d"), F.col("is_flex").alias("_f"), F.col("_dep").alias("_p"), F.col("_arr").alias("_a"), "legs")
    left = meet(steps)
    joined = left.join(right, (F.col("o") == F.col("_o")) & (F.col("d") == F.col("_d")) & (F.col("is_flex") == F.col("_f")) & F.col("_dep").eqNullSafe(F.col("_p")) & F.col("_arr").eqNullSafe(F.col("_a")), "left")
    missing = F.raise_error(F.concat(F.lit("no path for step "), "o", F.lit(" -> "), "d")).cast(f"array<{LEG}>")
    return joined.select(*steps.columns, F.coalesce("legs", missing).alias("legs"))


def used_routes(paths: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """The routes that any ride of the paths belongs to."""
    rides = paths.select(F.explode("legs").alias("leg")).filter("not leg.is_flex").select("leg.trip_id").distinct()
    return routes.join(trips.join(rides, "trip_id", "left_semi"), "route_id", "left_semi")


def goodness(paths: DataFrame) -> DataFrame:
    """(stop, goodness): pairs of ends joined through a stop, less the distinct origins and destinations of those pairs."""
    inner = paths.select("o", "d", F.explode(inner_stops(F.col("legs"))).alias("stop")).filter("stop <> o and stop <> d").distinct()
    return inner.groupBy("stop").agg((F.count("*") - F.countDistinct("o") - F.countDistinct("d")).alias("goodness"))


def solution_documents(paths: DataFrame, trips: DataFrame) -> DataFrame:
    """(path_id, document): status, duration, stops and the routes used, as JSON."""
    rides = paths.select("path_id", F.explode("legs").alias("leg")).filter("not leg.is_flex").select("path_id", "leg.trip_id").distinct()
    routes = rides.join(trips.select("trip_id", "route_id"), "trip_id").groupBy("path_id").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))
    whole = paths.join(routes, "path_id", "left")
    fields = F.struct(F.lit("solved").alias("status"), (F.col("arr") - F.col("dep")).alias("duration"), stops_of(F.col("legs")).alias("stops"), F.coalesce("routes", F.array().cast("array<string>")).alias("routes"))
    return whole.select("path_id", F.to_json(fields).alias("document"))


def near_path(dist: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How far stops and groups are from a path: dist (src, stop, dist) from each of its stops, groups (stop_id, rep).

    ((stop, src, dist), (rep, stop, dist)): each stop with the nearest stop of the path, each group with its nearest stop.
    """
    stops = dist.groupBy("stop").agg(F.min(F.struct("dist", "src")).alias("x")).select("stop", "x.src", "x.dist")
    reps = stops.join(groups.withColumnRenamed("stop_id", "stop"), "stop").groupBy("rep").agg(F.min(F.struct("dist", "stop")).alias("x")).select("rep", "x.stop", "x.dist")
    return stops, reps


def expanded(composites: DataFrame) -> DataFrame:
    """(stop, place, part): composite stops (stop, a, b) as the plain stops that make them up, in order; parts may be composite.

    Each round replaces every composite part by its two; a composite that holds itself raises.
    """
    from tramline.operators.lineage import cut

    known = composites.select(F.col("stop").alias("part"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    now = composites.select("stop", F.lit("").alias("place"), F.col("stop").alias("part"))
    for _ in range(64):
        joined = now.join(known, "part", "left")
        if joined.filter("_a is not null").isEmpty():
            break
        two = F.when(F.col("_a").isNull(), F.array(F.struct("place", "part"))).otherwise(F.array(F.struct(F.concat("place", F.lit("0")).alias("place"), F.col("_a").alias("part")), F.struct(F.concat("place", F.lit("1")).alias("place"), F.col("_b").alias("part"))))
        now = cut(joined.select("stop", F.explode(two).alias("x")).select("stop", "x.place", "x.part"))
    else:
        raise RuntimeError("composite stops are nested deeper than 64 levels, or hold themselves")
    order = F.row_number().over(Window.partitionBy("stop").orderBy("place")).cast("int")
    return now.select("stop", order.alias("place"), "part")


def looked_up(names: DataFrame, stops: DataFrame) -> DataFrame:
    """(name, stop_id, problem): the one stop of each name; problem is 'missing' or 'ambiguous' where there isn't exactly one."""
    found = stops.groupBy(F.col("stop_name").alias("name")).agg(F.min("stop_id").alias("stop_id"), F.count("*").alias("n"))
    joined = names.select("name").distinct().join(found, "name", "left")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
    return joined.select("name", F.when(problem.isNull(), F.col("stop_id")).alias("stop_id"), problem.alias("problem"))
