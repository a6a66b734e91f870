"""Required stops and their groups, checks of such configurations, and tables for a network explorer. groups: (stop_id, rep)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C


def members(groups: DataFrame) -> DataFrame:
    """(rep, stop_ids, n): the members of each group, sorted."""
    return groups.groupBy("rep").agg(F.array_join(F.array_sort(F.collect_list("stop_id")), ",").alias("stop_ids"), F.count("*").alias("n"))


def member_pairs(groups: DataFrame) -> DataFrame:
    """(rep, a, b): pairs of one group, a < b; groups are the few stops of a station complex."""
    a, b = groups.select("rep", F.col("stop_id").alias("a")), groups.select("rep", F.col("stop_id").alias("b"))
    return a.join(b, "rep").filter("a < b")


def config_errors(required: DataFrame, groups: DataFrame, stops: DataFrame) -> DataFrame:
    """(stop_id, problem): required (stop_id), groups (group_id, stop_id) and the stops that exist."""
    unknown = required.join(stops, "stop_id", "left_anti").select("stop_id", F.lit("unknown stop").alias("problem"))
    twice = required.groupBy("stop_id").count().filter("count > 1").select("stop_id", F.lit("listed twice").alias("problem"))
    return unknown.unionByName(twice).unionByName(group_errors(required, groups))


def group_errors(required: DataFrame, groups: DataFrame) -> DataFrame:
    """(stop_id, problem): members of groups (group_id, stop_id) that aren't required (stop_id), or stand in several groups."""
    stray = groups.join(required, "stop_id", "left_anti").select("stop_id", F.lit("grouped but not required").alias("problem")).distinct()
    many = groups.groupBy("stop_id").agg(F.countDistinct("group_id").alias("n")).filter("n > 1").select("stop_id", F.lit("in several groups").alias("problem"))
    return stray.unionByName(many)


def only_groups_of(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """groups of which any member is wanted (stop_id), with all their members."""
    reps = groups.join(wanted.select("stop_id").distinct(), "stop_id", "left_semi").select("rep").distinct()
    return groups.join(reps, "rep", "left_semi").select("stop_id", "rep")


def groups_missing(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep) of groups no member of which is an end of any edge (o, d)."""
    ends = edges.select(F.explode(F.array("o", "d")).alias("stop_id")).distinct()
    return groups.select("rep").distinct().join(groups.join(ends.hint("merge"), "stop_id", "left_semi").select("rep").distinct(), "rep", "left_anti")


def subsets(required: DataFrame) -> DataFrame:
    """(iteration, rep, stop_ids, n): of each iteration's required stops (iteration, stop_id, rep) the groups of more than one, sorted."""
    rows = required.distinct().groupBy("iteration", "rep").agg(F.array_join(F.array_sort(F.collect_list("stop_id")), ",").alias("stop_ids"), F.count("*").alias("n"))
    return rows.filter("n > 1")


def deep_representatives(groups: DataFrame) -> DataFrame:
    """Rows whose representative has another representative itself, or is missing."""
    own = groups.filter("stop_id = rep").select(F.col("stop_id").alias("rep"))
    return groups.join(own, "rep", "left_anti")


def spread_over_groups(stops: DataFrame, flag: str) -> DataFrame:
    """stops (stop_id, rep, flag) with the flag true for all members of a group if it is for one."""
    return stops.withColumn(flag, F.max(flag).over(Window.partitionBy("rep")))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows, and in how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def on_map(stops: DataFrame, width: float, height: float) -> DataFrame:
    """(stop_id, cx, cy): stops in a box of that size, north up, longitudes scaled by the middle latitude."""
    box = stops.agg(F.min("stop_lat").alias("s"), F.max("stop_lat").alias("n"), F.min("stop_lon").alias("w"), F.max("stop_lon").alias("e"))
    shrink = F.cos(F.radians((F.col("s") + F.col("n")) / 2))
    scale = F.least(F.lit(width) / F.greatest((F.col("e") - F.col("w")) * shrink, F.lit(1e-9)), F.lit(height) / F.greatest(F.col("n") - F.col("s"), F.lit(1e-9)))
    placed = stops.crossJoin(F.broadcast(box))  # one row
    return placed.select("stop_id", ((F.col("stop_lon") - F.col("w")) * shrink * scale).alias("cx"), ((F.col("n") - F.col("stop_lat")) * scale).alias("cy"))


def explorer_stops(stops: DataFrame, required: DataFrame, network: DataFrame) -> DataFrame:
    """(stop_id, stop_name, kind): required, in the network, or original only."""
    r, n = required.select("stop_id", F.lit(True).alias("_r")).distinct(), network.select("stop_id", F.lit(True).alias("_n")).distinct()
    kind = F.when(F.col("_r"), "required").when(F.col("_n"), "network").otherwise("original")
    return stops.join(r, "stop_id", "left").join(n, "stop_id", "left").select("stop_id", "stop_name", kind.alias("kind"))


def explorer_routes(day_trips: DataFrame, routes: DataFrame, directions: DataFrame) -> DataFrame:
    """(id, name): one row per route direction, as route:direction."""
    used = day_trips.select("route_id", "direction_id").distinct()
    named = used.join(routes, "route_id").join(directions, ["route_id", "direction_id"], "left")
    return named.select(F.concat_ws(":", "route_id", F.col("direction_id").cast("string")).alias("id"), C.route_description(F.col("route_short_name"), F.col("direction"), F.col("route_id")).alias("name"))
