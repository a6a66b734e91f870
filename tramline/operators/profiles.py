"""Departure and arrival profiles: earliest arrivals, the closure of connections, and reduced networks."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators.asof import asof_next
from tramline.operators.lineage import cut, small
from tramline.operators.steps import minimal_cover


def horizon(subsequent_days: int) -> int:
    """Seconds, exclusive, until which departures count: the later days and four hours."""
    if subsequent_days < 0:
        raise ValueError("the number of later days is negative")
    return 24 * 3600 * subsequent_days + 4 * 3600


def horizon_of(rides: DataFrame) -> DataFrame:
    """(horizon): one more than the latest departure."""
    return rides.agg((F.max("dep") + 1).alias("horizon"))


def chunks(until: int, hours: int = 6):
    """Column of the starts of the work chunks below until."""
    return F.sequence(F.lit(0), F.lit(until - 1), F.lit(hours * 3600))


def earliest_arrivals(queries: DataFrame, steps: DataFrame, rounds: int = 1000) -> DataFrame:
    """(query_id, stop, at): the earliest arrival at every stop that a query (query_id, stop, at) reaches.

    Each round takes the stops whose arrival improved, looks up the next rides, adds the walks and keeps the least.
    What the rounds keep grows with queries times stops; where that is more than the minimal rides, queries
    look their arrivals up in closed profiles of their stops instead, whose size the rides bound.
    """
    rides = cut(minimal_cover(steps.filter("not is_flex")).select(F.col("o").alias("stop"), "d", "dep", "arr"))
    walks = cut(steps.filter("is_flex").groupBy(F.col("o").alias("stop"), "d").agg(F.min(F.col("arr") - F.col("dep")).alias("w")))
    best = cut(queries.select("query_id", "stop", "at").groupBy("query_id", "stop").agg(F.min("at").alias("at")))
    if best.count() * rides.select("d").distinct().count() > rides.count():
        edges = rides.select(F.col("stop").alias("o"), "d", "dep", "arr", F.lit(False).alias("is_flex")).unionByName(walks.select(F.col("stop").alias("o"), "d", F.lit(0).alias("dep"), F.col("w").alias("arr"), F.lit(True).alias("is_flex")))
        return arrivals_from_profiles(best, closed_times(edges, best.select(F.col("stop").alias("stop_id")), rounds))
    ends = cut(rides.select("stop", "d").distinct())
    front = best
    for _ in range(rounds):
        by_ride = asof_next(front.join(ends, "stop"), rides, ["stop", "d"], "at", "dep", ["arr"]).filter("next_dep is not null").select("query_id", F.col("d").alias("stop"), F.col("next_arr").alias("at"))
        on_foot = front.join(walks, "stop").select("query_id", F.col("d").alias("stop"), (F.col("at") + F.col("w")).alias("at"))
        reached = by_ride.unionByName(on_foot).groupBy("query_id", "stop").agg(F.min("at").alias("at"))
        old = best.withColumnRenamed("at", "old")
        front = cut(reached.join(old, ["query_id", "stop"], "left").filter("old is null or at < old").select("query_id", "stop", "at"))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("query_id", "stop").agg(F.min("at").alias("at")))
    raise RuntimeError(f"arrivals still improve after {rounds} rounds")


def arrivals_to(queries: DataFrame, targets: DataFrame, steps: DataFrame, rounds: int = 1000) -> DataFrame:
    """(query_id, stop, at, seen): the earliest arrival at each destination of a query (query_id, set_id, stop, at).

    targets (set_id, stop_id): the sets of destinations. Of equally early ways the one that has come by most of
    its destinations stays; seen is their number, the last one included. Lower bounds
    prune the front: least distances to each set over the reversed relaxed graph. A stop from
    which no destination can be reached goes; so does an arrival which, with that distance, is later than
    the query's latest arrival at its destinations, once all of them are reached.
    """
    from tramline.operators.graph import distances, relaxed_edges, reversed_edges, set_distances

    steps, targets = cut(steps.select("o", "d", "dep", "arr", "trip_id", "is_flex")), cut(targets.select("set_id", "stop_id").distinct())
    rides = cut(minimal_cover(steps.filter("not is_flex")).select(F.col("o").alias("stop"), "d", "dep", "arr"))
    walks = cut(steps.filter("is_flex").groupBy(F.col("o").alias("stop"), "d").agg(F.min(F.col("arr") - F.col("dep")).alias("w")))
    ends = cut(rides.select("stop", "d").distinct())
    apart = distances(reversed_edges(relaxed_edges(steps)), targets.select("stop_id"))
    bounds = small(cut(set_distances(apart, targets).withColumnRenamed("dist", "_bound")))
    size = small(targets.groupBy("set_id").agg(F.count("*").alias("_size")))
    on = small(targets.select("set_id", F.col("stop_id").alias("stop"), F.lit(True).alias("_on")))
    label = F.min(F.struct("at", (-F.size("via")).alias("less"), "via")).alias("x")
    least = lambda df: df.groupBy("query_id", "set_id", "stop").agg(label).select("query_id", "set_id", "stop", "x.at", "x.via")
    # Distinct destinations on the way; going round a walk of no length adds none.
    marked = lambda df: df.join(on, ["set_id", "stop"], "left").withColumn("via", F.when(F.col("_on"), F.array_sort(F.array_union("via", F.array("stop")))).otherwise(F.col("via"))).drop("_on")
    start = queries.select("query_id", "set_id", "stop", "at", F.array().cast("array<string>").alias("via"))
    best = cut(least(marked(start)))
    front = best
    for _ in range(rounds):
        reached = best.join(on, ["set_id", "stop"]).groupBy("query_id", "set_id").agg(F.count("*").alias("_n"), F.max("at").alias("_last")).join(size, "set_id")
        known = cut(reached.filter("_n = _size").select("query_id", "_last"))
        front = front.join(bounds, ["set_id", "stop"]).join(known.hint("merge"), "query_id", "left").filter("_last is null or at + _bound <= _last").drop("_bound", "_last")
        front = cut(front)
        if front.isEmpty():
            return best.join(on, ["set_id", "stop"]).select("query_id", "stop", "at", F.size("via").alias("seen"))
        by_ride = asof_next(front.join(ends.hint("merge"), "stop"), rides, ["stop", "d"], "at", "dep", ["arr"]).filter("next_dep is not null").select("query_id", "set_id", F.col("d").alias("stop"), F.col("next_arr").alias("at"), "via")
        on_foot = front.join(walks.hint("merge"), "stop").select("query_id", "set_id", F.col("d").alias("stop"), (F.col("at") + F.col("w")).alias("at"), "via")
        found = least(marked(by_ride.unionByName(on_foot)))
        old = best.select("query_id", "stop", F.struct(F.col("at"), (-F.size("via")).alias("less")).alias("old"))
        front = cut(found.join(old, ["query_id", "stop"], "left").filter(F.col("old").isNull() | (F.struct(F.col("at"), (-F.size("via")).alias("less")) < F.col("old"))).drop("old"))
        if front.isEmpty():
            continue
        best = cut(least(best.unionByName(front)))
    raise RuntimeError(f"arrivals still improve after {rounds} rounds")


def arrivals_from_profiles(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, stop, at): earliest arrivals of queries (query_id, stop, at) from closed profiles, by one look-up instead of rounds.

    paths (o, d, dep, arr, is_flex): profiles of every origin asked for. A query meets each stop's next
    departure by one as-of join in pieces of the day, its walks by a join, and its own stop at once.
    """
    queries = cut(queries.select("query_id", "stop", "at"))
    return _looked_up(queries, paths).unionByName(queries).groupBy("query_id", "stop").agg(F.min("at").alias("at"))


def _looked_up(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, stop, at): arrivals of queries by the next path of each pair, and by walks."""
    from tramline.operators.asof import SPAN

    rides = cut(paths.filter("not is_flex").select(F.col("o").alias("stop"), "d", "dep", "arr"))
    walks = paths.filter("is_flex").groupBy(F.col("o").alias("stop"), "d").agg(F.min(F.col("arr") - F.col("dep")).alias("w"))
    asked = queries.join(rides.select("stop", "d").distinct().hint("merge"), "stop")
    by_ride = asof_next(asked, rides, ["stop", "d"], "at", "dep", ["arr"], span=SPAN).filter("next_dep is not null").select("query_id", F.col("d").alias("stop"), F.col("next_arr").alias("at"))
    on_foot = queries.join(walks.hint("merge"), "stop").select("query_id", F.col("d").alias("stop"), (F.col("at") + F.col("w")).alias("at"))
    return by_ride.unionByName(on_foot)


def arrivals_at(queries: DataFrame, targets: DataFrame, steps: DataFrame) -> DataFrame:
    """(query_id, stop, at): the times of arrivals_to(), without what was seen on the way, for many queries.

    Looked up in profiles to the destinations: those from them with time and direction turned
    round. Their size is bounded by the rides, whatever the number of queries.
    """
    turned = lambda df: df.select(F.col("d").alias("o"), F.col("o").alias("d"), F.when(F.col("is_flex"), F.col("dep")).otherwise(-F.col("arr")).alias("dep"), F.when(F.col("is_flex"), F.col("arr")).otherwise(-F.col("dep")).alias("arr"), "is_flex")
    paths = turned(closed_times(turned(steps), targets))
    wanted = small(cut(targets.select("set_id", F.col("stop_id").alias("d")).distinct()))
    # Stops are named together with the set, so that a query meets only its own destinations.
    key = lambda c: F.concat_ws("@", c, "set_id")
    asked = queries.select("query_id", key("stop").alias("stop"), "at")
    own = queries.join(wanted.withColumnRenamed("d", "stop"), ["set_id", "stop"], "left_semi").select("query_id", "stop", "at")
    return _looked_up(asked, paths.join(wanted, "d").withColumn("o", key("o"))).unionByName(own).groupBy("query_id", "stop").agg(F.min("at").alias("at"))


def closed_times(steps: DataFrame, origins: DataFrame | None = None, rounds: int = 1000) -> DataFrame:
    """(o, d, dep, arr, is_flex): the times of closure(steps, origins), whose rows are a fraction of its size as they carry no legs."""
    shape = ["o", "d", "dep", "arr", "is_flex"]
    edges = cut(minimal_cover(steps.filter("o <> d").select(*shape), tie=()))
    now = edges if origins is None else cut(edges.join(origins.select(F.col("stop_id").alias("o")).distinct().hint("merge"), "o", "left_semi").select(*shape))
    new = now
    ride2 = edges.filter("not is_flex").select(F.col("o").alias("via"), F.col("d").alias("to"), F.col("dep").alias("leave"), "arr")
    every2 = edges.select(F.col("o").alias("via"), F.col("d").alias("to"), F.col("dep").alias("dep2"), F.col("arr").alias("arr2"), F.col("is_flex").alias("f2"))
    ends = cut(ride2.select("via", "to").distinct())
    for _ in range(rounds):
        rides, walks = new.filter("not is_flex"), new.filter("is_flex")
        # An arrival at a stop is looked up once, for the paths of all origins; what it catches rides along in one row, and
        # of ways over several stops only the least leaves the task in which a path's origin and departure lie.
        base = rides.select("o", F.col("d").alias("via"), "dep", F.col("arr").alias("at"))
        asked = base.select("via", "at").distinct().join(ends.hint("merge"), "via")
        found = asof_next(asked, ride2, ["via", "to"], "at", "leave", ["arr"]).filter("next_leave is not null")
        found = found.groupBy("via", "at").agg(F.collect_list(F.struct("to", F.col("next_arr").alias("arr"))).alias("next"))
        caught = base.join(found.hint("merge"), ["via", "at"]).select("o", "dep", "next").repartition("o", "dep").select("o", "dep", F.inline("next")).filter("o <> to")
        caught = caught.groupBy("o", "dep", "to").agg(F.min("arr").alias("arr")).select("o", F.col("to").alias("d"), "dep", "arr", F.lit(False).alias("is_flex"))

        def product(x, y):
            flex, dep, arr = C.merged_step(F.col("is_flex"), F.col("dep"), F.col("arr"), F.col("f2"), F.col("dep2"), F.col("arr2"))
            return x.withColumnRenamed("d", "via").join(y.hint("merge"), "via").filter("o <> to").select("o", F.col("to").alias("d"), dep.alias("dep"), arr.alias("arr"), flex.alias("is_flex"))

        more = caught.unionByName(product(walks, every2)).unionByName(product(rides, every2.filter("f2")))
        both = now.withColumn("_known", F.lit(1)).unionByName(more.withColumn("_known", F.lit(0)))
        after = cut(minimal_cover(both, tie=("_known",)))
        new, now = after.filter("_known = 0").select(*shape), after.select(*shape)
        if new.isEmpty():
            return now
    raise RuntimeError(f"paths still improve after {rounds} rounds")


def closure(steps: DataFrame, origins: DataFrame | None = None, required: DataFrame | None = None, rounds: int = 1000, keys: tuple[str, ...] = (), window: tuple[int, int | str, int] | None = None) -> DataFrame:
    """(keys, o, d, dep, arr, is_flex, thru, legs): all minimal departures between stops over any number of changes.

    origins (keys, stop_id): only profiles from there. required (keys, stop_id): thru tells
    whether a path passes such a stop on its way; among equal paths one that does
    stays, then one known longer, then the last by its trips. Each round continues only paths that are new, one step further, and takes
    the minimal cover with what is known. legs holds the steps of the path.

    keys: columns of steps that keep networks apart, which are closed in the same rounds; a
    network in which nothing is new leaves the loop. window (lb, ub, width): only departures in
    [lb, ub), in chunks of width seconds, each closed on its own and put together by a cover; ub may name one of the keys;
    a path leaves no earlier than its chunk begins, so none is made that the window does not ask for.
    """
    keys, leg = list(keys), F.struct("o", "d", "dep", "arr", "trip_id", "is_flex")
    apart = [*keys, *(["chunk"] if window else [])]
    edges = cut(minimal_cover(steps.filter("o <> d").select(*keys, "o", "d", "dep", "arr", "trip_id", "is_flex"), (*keys, "o", "d")))
    start = edges if origins is None else edges.join(origins.select(*keys, F.col("stop_id").alias("o")).distinct().hint("merge"), [*keys, "o"], "left_semi")
    stops = None if required is None else small(cut(required.select(*keys, F.col("stop_id").alias("via"), F.lit(True).alias("req")).distinct()))
    start = start.withColumn("legs", F.array(leg)).withColumn("thru", F.lit(False)).drop("trip_id")
    if window:
        start = _in_chunks(start, *window)
    now = cut(start)
    new, done = now, []
    ride2 = edges.filter("not is_flex").select(*keys, F.col("o").alias("via"), F.col("d").alias("to"), F.col("dep").alias("leave"), "arr", "trip_id")
    walk2 = edges.filter("is_flex").select(*keys, F.col("o").alias("via"), F.col("d").alias("to"), F.col("dep").alias("dep2"), F.col("arr").alias("arr2"), F.col("trip_id").alias("trip2"), F.lit(True).alias("f2"))
    every2 = walk2.unionByName(ride2.select(*keys, "via", "to", F.col("leave").alias("dep2"), F.col("arr").alias("arr2"), F.col("trip_id").alias("trip2"), F.lit(False).alias("f2")))
    ends = cut(ride2.select(*keys, "via", "to").distinct())
    via = [*keys, "via"]
    shape = [*apart, "o", "d", "dep", "arr", "is_flex", "legs", "thru"]
    for _ in range(rounds):
        rides, walks = new.filter("not is_flex"), new.filter("is_flex")
        base = rides.select(*apart, "o", F.col("d").alias("via"), "dep", F.col("arr").alias("at"), "legs", "thru")
        caught = asof_next(base.join(ends, via), ride2, [*via, "to"], "at", "leave", ["arr", "trip_id"]).filter("next_leave is not null")
        caught = caught.select(*apart, "o", "via", "to", "dep", F.col("next_arr").alias("arr"), F.lit(False).alias("is_flex"), "legs", "thru", F.struct(F.col("via").alias("o"), F.col("to").alias("d"), F.col("next_leave").alias("dep"), F.col("next_arr").alias("arr"), F.col("next_trip_id").alias("trip_id"), F.lit(False).alias("is_flex")).alias("leg"))

        def product(x, y):
            x = x.select(*apart, "o", F.col("d").alias("via"), F.col("dep").alias("dep1"), F.col("arr").alias("arr1"), F.col("is_flex").alias("f1"), "legs", "thru")
            flex, dep, arr = C.merged_step(F.col("f1"), F.col("dep1"), F.col("arr1"), F.col("f2"), F.col("dep2"), F.col("arr2"))
            added = F.struct(F.col("via").alias("o"), F.col("to").alias("d"), F.col("dep2").alias("dep"), F.col("arr2").alias("arr"), F.col("trip2").alias("trip_id"), F.col("f2").alias("is_flex"))
            return x.join(y, via).select(*apart, "o", "via", "to", dep.alias("dep"), arr.alias("arr"), flex.alias("is_flex"), "legs", "thru", added.alias("leg"))

        more = caught.unionByName(product(walks, every2)).unionByName(product(rides, walk2)).filter("o <> to")
        if window:
            more = more.filter(F.col("is_flex") | (_chunk_of(*window) == F.col("chunk")))
        if stops is not None:
            more = more.join(stops, via, "left").withColumn("thru", F.col("thru") | F.coalesce("req", F.lit(False)))
        more = more.select(*apart, "o", F.col("to").alias("d"), "dep", "arr", "is_flex", F.concat("legs", F.array("leg")).alias("legs"), "thru")
        both = now.select(*shape, F.lit(0).alias("old")).unionByName(more.select(*shape, F.lit(1).alias("old")))
        # Equal paths: one through a required stop stays, else the one known longest, else the last by its trips.
        both = both.withColumn("_known", -F.col("old")).withColumn("_changes", -F.size("legs")).withColumn("_trips", F.transform("legs", lambda x: x["trip_id"]))
        both = minimal_cover(both, (*apart, "o", "d"), ("thru", "_known", "_changes", "_trips"))
        after = cut(both.select(*shape, "old"))
        new = after.filter("old = 1").select(*shape)
        now = after.select(*shape)
        if new.isEmpty():
            return _whole([*done, now], keys, window)
        if apart:
            busy = small(cut(new.select(*apart).distinct()))
            ended = now.join(busy, apart, "left_anti")
            if not ended.isEmpty():
                done.append(ended)
                now = now.join(busy, apart, "left_semi")
    raise RuntimeError(f"paths still improve after {rounds} rounds")


def _limit(ub):
    """Column of the end of a window: a number, or the name of a column of the keys."""
    return F.col(ub) if isinstance(ub, str) else F.lit(ub)


def _chunk_of(lb: int, ub: int | str, width: int):
    """Column of the chunk of a departure; null outside of [lb, ub)."""
    return F.when((F.col("dep") >= lb) & (F.col("dep") < _limit(ub)), F.floor((F.col("dep") - lb) / width).cast("int"))


def _in_chunks(start: DataFrame, lb: int, ub: int | str, width: int) -> DataFrame:
    """start with its chunk; walks, which may leave at any time, stand in every chunk."""
    if width <= 0 or not isinstance(ub, str) and ub <= lb:
        raise ValueError("the window is empty")
    every = F.sequence(F.lit(0), F.greatest(F.floor((_limit(ub) - lb - 1) / width).cast("int"), F.lit(0)))
    placed = F.when(F.col("is_flex"), every).otherwise(F.array(_chunk_of(lb, ub, width)))
    return start.withColumn("chunk", F.explode(placed)).filter("chunk is not null")


def _whole(parts: list[DataFrame], keys: list[str], window) -> DataFrame:
    """The networks that ended in the rounds together; chunks put together by a cover."""
    found = reduce(DataFrame.unionByName, parts)
    if not window:
        return found
    found = found.drop("chunk").withColumn("_changes", -F.size("legs")).withColumn("_trips", F.transform("legs", lambda x: x["trip_id"]))
    return cut(minimal_cover(found, (*keys, "o", "d"), ("thru", "_changes", "_trips")).drop("_changes", "_trips"))


def reduced(steps: DataFrame, required: DataFrame, until: int | str = 36 * 3600, complete: bool = False, rounds: int = 1000, keys: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Minimal paths between required stops that leave in [0, until).

    Unless complete, paths through another required stop are left out, after the
    cover was taken: they can be put together from the rest. keys: columns of steps and required that
    keep networks apart. width: seconds of a work chunk; departures in [0, until)
    are then closed chunk by chunk, and none outside is looked at; until may then name one of the keys.
    """
    window = (0, until, width) if width else None
    ends = required.select(*keys, F.col("stop_id").alias("d")).distinct()
    paths = closure(steps, required, required, rounds, keys, window).join(ends.hint("merge"), [*keys, "d"], "left_semi")
    if not complete:
        paths = paths.filter("not thru")
    return paths.filter(F.col("is_flex") | ((F.col("dep") >= 0) & (F.col("dep") < _limit(until)))).select(*keys, "o", "d", "dep", "arr", "is_flex", "legs", "thru")


def profile(steps: DataFrame, origins: DataFrame, lb: int, ub: int, hours: float = 6) -> DataFrame:
    """(o, d, dep, arr, is_flex, thru, legs): minimal paths from the origins (stop_id) that leave in [lb, ub), by work chunks of so many hours."""
    return closure(steps, origins, window=(lb, ub, int(hours * 3600)))


def built_network(steps: DataFrame, required: DataFrame) -> DataFrame:
    """(o_id, d_id, dep, arr, is_flex): the reduced network between required stops, with a start and an end, its stops numbered."""
    from tramline.operators.feed import dense_ids
    from tramline.operators.steps import boundary

    columns = ["o", "d", "dep", "arr", "is_flex"]
    edges = cut(reduced(steps, required).select(*columns).unionByName(boundary(required).select(*columns)))
    ids = cut(dense_ids(edges.select(F.explode(F.array("o", "d")).alias("stop")), "stop"))
    name = lambda k: small(ids.select(F.col("stop").alias(k), F.col("id").alias(f"{k}_id")))
    return edges.join(name("o"), "o").join(name("d"), "d").select("o_id", "d_id", "dep", "arr", "is_flex")


class Network(NamedTuple):
    """A network to search in, with small numbers for its stops and partitions.

    steps (o_id, o_part, d_id, d_part, dep, arr, is_flex, legs); stops (id, stop_id, role), role being
    start, end, required or other; partitions (part, route). A step's partitions are those of its first and last ride;
    walks and the steps from the start and to the end have none.
    """

    steps: DataFrame
    stops: DataFrame
    partitions: DataFrame


def routed_network(steps: DataFrame, required: DataFrame, routes: DataFrame, until: int = 36 * 3600, optimize: bool = False, width: int | None = None) -> Network:
    """The reduced network between required stops (stop_id), its rides marked with the routes (trip_id, route) they belong to.

    optimize: paths are split at stops while that lowers the number of edges; the parts are marked by their own
    rides. A trip that routes lacks is a route of its own. Stops are numbered after the reduction, so
    only those on it count; the start and the end come after them and lead to the required ones among them.
    """
    from tramline.operators.feed import dense_ids
    from tramline.operators.steps import boundary

    paths = reduced(steps, required, until, width=width)
    paths = (fewer_edges(paths) if optimize else paths).select("o", "d", "dep", "arr", "is_flex", "legs")
    rides = F.filter("legs", lambda x: ~x["is_flex"])
    paths = cut(paths.withColumn("_first", F.get(rides, F.lit(0))["trip_id"]).withColumn("_last", F.get(rides, F.size(rides) - 1)["trip_id"]))
    used = paths.select(F.explode(F.array("_first", "_last")).alias("trip_id")).filter("trip_id is not null").distinct()
    used = cut(used.join(routes.select("trip_id", "route").hint("merge"), "trip_id", "left").select("trip_id", F.coalesce("route", "trip_id").alias("route")))
    partitions = cut(dense_ids(used, "route", "part"))
    numbered = cut(used.join(small(partitions), "route").select("trip_id", "part"))
    on = cut(dense_ids(paths.select(F.explode(F.array("o", "d")).alias("stop_id")), "stop_id"))
    needed = required.select("stop_id", F.lit("required").alias("role")).distinct()
    inner = on.join(small(cut(needed)), "stop_id", "left").select("id", "stop_id", F.coalesce("role", F.lit("other")).alias("role"))
    ends = on.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).select(F.inline(F.array(*[F.struct((F.col("n") + k).cast(on.schema["id"].dataType).alias("id"), F.lit(role.upper()).alias("stop_id"), F.lit(role).alias("role")) for k, role in ((1, "start"), (2, "end"))])))
    stops = cut(inner.unionByName(ends))
    none = F.lit(None).cast("array<struct<o:string,d:string,dep:int,arr:int,trip_id:string,is_flex:boolean>>")
    outer = boundary(stops.filter("role = 'required'")).select("o", "d", "dep", "arr", "is_flex", none.alias("legs"), F.lit(None).cast("string").alias("_first"), F.lit(None).cast("string").alias("_last"))
    name = lambda k: small(stops.select(F.col("stop_id").alias(k), F.col("id").alias(f"{k}_id")))
    part = lambda k, trip: small(numbered.select(F.col("trip_id").alias(trip), F.col("part").alias(f"{k}_part")))
    every = paths.unionByName(outer).join(name("o"), "o").join(name("d"), "d").join(part("o", "_first"), "_first", "left").join(part("d", "_last"), "_last", "left")
    return Network(every.select("o_id", "o_part", "d_id", "d_part", "dep", "arr", "is_flex", "legs"), stops, partitions)


def stop_goodness(paths: DataFrame) -> DataFrame:
    """(stop, goodness): pairs of ends whose paths pass the stop, less the distinct origins and destinations of those."""
    on = paths.select("o", "d", F.explode(F.transform("legs", lambda x: x["d"])).alias("stop")).unionByName(paths.select("o", "d", F.col("o").alias("stop"))).distinct()
    inner = (F.col("stop") != F.col("o")) & (F.col("stop") != F.col("d"))
    return on.groupBy("stop").agg(
        (F.count(F.when(inner, 1)) - F.countDistinct(F.when(inner, F.col("o"))) - F.countDistinct(F.when(inner, F.col("d")))).alias("goodness")
    )


def split_at(paths: DataFrame, stop: str) -> DataFrame:
    """paths with those that pass a stop cut there in two; each part's times follow from its legs."""
    at = F.array_position(F.transform("legs", lambda x: x["d"]), stop).cast("int")
    whole = paths.withColumn("_at", at)
    cut_here = F.col("_at").between(1, F.size("legs") - 1)
    parts = F.when(cut_here, F.array(F.slice("legs", F.lit(1), F.col("_at")), F.slice("legs", F.col("_at") + 1, F.size("legs") - F.col("_at")))).otherwise(F.array("legs"))
    return whole.select(F.explode(parts).alias("legs")).select(F.col("legs")[0]["o"].alias("o"), F.element_at("legs", -1)["d"].alias("d"), *run_times(F.col("legs")), "legs").distinct()


def run_times(legs):
    """(dep, arr, is_flex) of a run of legs: walks at the ends go right before the first and after the last ride."""
    rides = F.filter(legs, lambda x: ~x["is_flex"])
    long = lambda x: x["arr"] - x["dep"]
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + long(x))
    first = F.array_position(F.transform(legs, lambda x: x["is_flex"]), False).cast("int")
    last = F.size(legs) + 1 - F.array_position(F.reverse(F.transform(legs, lambda x: x["is_flex"])), False).cast("int")
    flex = F.size(rides) == 0
    dep = F.when(flex, F.lit(0)).otherwise(F.get(rides, F.lit(0))["dep"] - total(F.slice(legs, F.lit(1), F.greatest(first - 1, F.lit(0)))))
    arr = F.when(flex, total(legs)).otherwise(F.get(rides, F.size(rides) - 1)["arr"] + total(F.slice(legs, F.greatest(last + 1, F.lit(1)), F.greatest(F.size(legs) - last, F.lit(0)))))
    return dep.alias("dep"), arr.alias("arr"), flex.alias("is_flex")


def fewer_edges(paths: DataFrame) -> DataFrame:
    """paths split at the best stop again and again, while that has a positive goodness and lowers the number of edges."""
    now = cut(paths.select("o", "d", "dep", "arr", "is_flex", "legs"))
    edges = now.select("o", "d").distinct().count()
    while True:  # each round has fewer edges
        best = stop_goodness(now).orderBy(F.desc("goodness"), "stop").first()
        if best is None or best["goodness"] <= 0:
            break
        after = cut(split_at(now, best["stop"]).select(*now.columns))
        fewer = after.select("o", "d").distinct().count()
        if fewer >= edges:
            break
        now, edges = after, fewer
    return now


def probe(full: DataFrame, small: DataFrame, queries: DataFrame, required: DataFrame) -> DataFrame:
    """Queries whose earliest arrivals at required stops differ between two networks: (query_id, stop, full, small)."""
    return compared(full, small, queries, required).filter(~F.col("full").eqNullSafe(F.col("small")))


def compared(full: DataFrame, small: DataFrame, queries: DataFrame, required: DataFrame) -> DataFrame:
    """(query_id, stop, full, small): earliest arrivals at required stops in two networks; null where one doesn't get there."""
    keep = lambda x, name: earliest_arrivals(queries, x).join(required.withColumnRenamed("stop_id", "stop"), "stop", "left_semi").withColumnRenamed("at", name)
    return keep(full, "full").join(keep(small, "small"), ["query_id", "stop"], "full")


