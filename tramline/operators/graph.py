"""Weighted graphs of a network: relaxed edges, distances, spanning trees, transfer-aware edges and state merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators.components import connected_components
from tramline.operators.lineage import cut


def relaxed_edges(steps: DataFrame) -> DataFrame:
    """(o, d, w): the least duration between two stops."""
    return steps.groupBy("o", "d").agg(F.min(F.col("arr") - F.col("dep")).alias("w"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("d").alias("o"), F.col("o").alias("d"), *[c for c in edges.columns if c not in ("o", "d")])


def distances(edges: DataFrame, sources: DataFrame, rounds: int = 1000) -> DataFrame:
    """(src, stop, dist): shortest distances from each source (stop_id) over edges (o, d, w).

    Each round joins only the rows that improved in the last one with the edges.
    """
    edges = cut(edges.groupBy("o", "d").agg(F.min("w").alias("w")))
    best = cut(sources.select(F.col("stop_id").alias("src"), F.col("stop_id").alias("stop"), F.lit(0).cast("long").alias("dist")).distinct())
    front = best
    for _ in range(rounds):
        reached = front.join(edges, front["stop"] == edges["o"]).groupBy("src", "d").agg(F.min(F.col("dist") + F.col("w")).alias("dist")).withColumnRenamed("d", "stop")
        old = best.withColumnRenamed("dist", "old")
        front = cut(reached.join(old, ["src", "stop"], "left").filter("old is null or dist < old").select("src", "stop", "dist"))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("src", "stop").agg(F.min("dist").alias("dist")))
    raise RuntimeError(f"distances still improve after {rounds} rounds")


def set_distances(dist: DataFrame, members: DataFrame) -> DataFrame:
    """(set_id, stop, dist): least distance from any member of a set (set_id, stop_id) of sources."""
    return dist.join(members.withColumnRenamed("stop_id", "src"), "src").groupBy("set_id", "stop").agg(F.min("dist").alias("dist"))


def undirected_edges(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(lo, hi, w): the least weight between two stops, or between their group representatives (stop_id, rep)."""
    if groups is not None:
        a, b = groups.select(F.col("stop_id").alias("o"), F.col("rep").alias("ro")), groups.select(F.col("stop_id").alias("d"), F.col("rep").alias("rd"))
        edges = edges.join(a, "o").join(b, "d").select(F.col("ro").alias("o"), F.col("rd").alias("d"), "w")
    lo, hi = C.undirected(F.col("o"), F.col("d"))
    return edges.filter("o <> d").groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min("w").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """(stop_id, degree) over undirected edges (lo, hi)."""
    return edges.select(F.explode(F.array("lo", "hi")).alias("stop_id")).groupBy("stop_id").agg(F.count("*").alias("degree"))


def spanning_tree(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The edges (lo, hi, w) of a minimum spanning forest; equal weights are ordered by (lo, hi), so it is unique.

    Boruvka's rounds: every component takes its least edge to another one.
    """
    edges = cut(edges)
    nodes = cut(edges.select(F.explode(F.array("lo", "hi")).alias("node")).distinct())
    label, tree = cut(nodes.withColumn("comp", F.col("node"))), None
    for _ in range(rounds):
        a, b = label.select(F.col("node").alias("lo"), F.col("comp").alias("ca")), label.select(F.col("node").alias("hi"), F.col("comp").alias("cb"))
        between = edges.join(a, "lo").join(b, "hi").filter("ca <> cb")
        ends = between.select("lo", "hi", "w", F.explode(F.array("ca", "cb")).alias("comp"))
        picked = cut(ends.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("e.*").distinct())
        if picked.isEmpty():
            return edges.limit(0) if tree is None else tree.select("lo", "hi", "w")
        tree = cut(picked if tree is None else tree.unionByName(picked))
        roots = connected_components(tree, "lo", "hi")
        label = cut(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp")))
    raise RuntimeError(f"components still merge after {rounds} rounds")


def tree_leaves(tree: DataFrame) -> DataFrame:
    """(stop_id): nodes of degree one."""
    return degrees(tree).filter("degree = 1").select("stop_id")


def arrivals(steps: DataFrame, part: str = "part") -> DataFrame:
    """(stop, part, t, flex): distinct arrival times at each (stop, partition) state, one row without a time for walks."""
    rows = steps.select(F.col("d").alias("stop"), F.col(part).alias("part"), F.when(~F.col("is_flex"), F.col("arr")).alias("t"), F.col("is_flex").alias("flex"))
    return rows.distinct()


def _departures(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("o").alias("stop"), "d", F.col("part").alias("d_part"), "dep", "arr", "is_flex")


def last_arrivals(steps: DataFrame) -> DataFrame:
    """(stop, part, dep, last_t): for each time at which rides leave a stop, the latest arrival there before, by partition.

    Only of states that aren't reached on foot. Of the arrivals before a departure
    only the latest can give the least time, so each state asks once a time of departure.
    """
    from tramline.operators.asof import asof_last

    into = arrivals(steps)
    fixed = into.join(into.groupBy("stop", "part").agg(F.max("flex").alias("flex")).filter("not flex").select("stop", "part"), ["stop", "part"]).select("stop", "part", "t")
    asked = _departures(steps).filter("not is_flex").select("stop", "dep").distinct().join(fixed.select("stop", "part").distinct(), "stop")
    return asof_last(asked, fixed, ["stop", "part"], "dep", "t").filter("last_t is not null").select("stop", "part", "dep", "last_t")


def waiting_edges(steps: DataFrame) -> DataFrame:
    """(o, o_part, d, d_part, w): least time from an arrival at a state to the next arrival by a ride, waiting included."""
    return _waiting(_once(steps))


def _once(steps: DataFrame) -> DataFrame:
    """The columns of steps that transfers look at, computed once: they are asked for from both ends and by several joins."""
    return cut(steps.select("o", "d", "part", "dep", "arr", "is_flex"))


def _waiting(steps: DataFrame) -> DataFrame:
    rides = _departures(steps).filter("not is_flex").groupBy("stop", "d", "d_part", "dep").agg(F.min("arr").alias("arr"))
    waited = last_arrivals(steps).join(rides, ["stop", "dep"])
    return waited.groupBy(F.col("stop").alias("o"), F.col("part").alias("o_part"), "d", "d_part").agg(F.min(F.col("arr") - F.col("last_t")).alias("w"))


def transfer_edges(steps: DataFrame) -> DataFrame:
    """(o, o_part, d, d_part, w): least time from an arrival at a state to the arrival at the next, waiting included.

    steps: o, d, dep, arr, is_flex, part. A state that is reached on foot may be
    left at any time, so the shortest step counts there.
    """
    steps = _once(steps)
    flexible = arrivals(steps).groupBy("stop", "part").agg(F.max("flex").alias("flex"))
    long = F.col("arr") - F.col("dep")
    shortest = _departures(steps).groupBy("stop", "d", "d_part").agg(F.min(long).alias("w"), F.min(F.when(F.col("is_flex"), long)).alias("walk"))
    any_time = flexible.join(shortest, "stop").select(F.col("stop").alias("o"), F.col("part").alias("o_part"), "d", "d_part", F.when(F.col("flex"), F.col("w")).otherwise(F.col("walk")).alias("w"))
    every = any_time.filter("w is not null").unionByName(_waiting(steps))
    return every.groupBy("o", "o_part", "d", "d_part").agg(F.min("w").alias("w"))


def signatures(edges: DataFrame) -> DataFrame:
    """(stop, part, signature): the sorted outgoing edges of each state; '' for those without one."""
    states = edges.select(F.col("o").alias("stop"), F.col("o_part").alias("part")).union(edges.select("d", "d_part")).distinct()
    outgoing = edges.groupBy(F.col("o").alias("stop"), F.col("o_part").alias("part")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "d", F.col("d_part").cast("string"), F.col("w").cast("string")))), ",").alias("signature"))
    return states.join(outgoing, ["stop", "part"], "left").select("stop", "part", F.coalesce("signature", F.lit("")).alias("signature"))


def merged_states(edges: DataFrame) -> DataFrame:
    """(stop, part, new_part): states of a stop with equal signatures become one; the new ones count from 0 by smallest part."""
    same = signatures(edges).withColumn("rep", F.min("part").over(Window.partitionBy("stop", "signature")))
    return same.withColumn("new_part", (F.dense_rank().over(Window.partitionBy("stop").orderBy("rep")) - 1).cast("int")).select("stop", "part", "new_part")


def remapped_edges(edges: DataFrame, states: DataFrame) -> DataFrame:
    """edges between merged states, the least weight of each."""
    a = states.select(F.col("stop").alias("o"), F.col("part").alias("o_part"), F.col("new_part").alias("a"))
    b = states.select(F.col("stop").alias("d"), F.col("part").alias("d_part"), F.col("new_part").alias("b"))
    return edges.join(a, ["o", "o_part"]).join(b, ["d", "d_part"]).groupBy("o", F.col("a").alias("o_part"), "d", F.col("b").alias("d_part")).agg(F.min("w").alias("w"))


def states_per_stop(states: DataFrame) -> DataFrame:
    return states.select("stop", "new_part").distinct().groupBy("stop").agg(F.count("*").alias("states"))


def without_edges(steps: DataFrame, forbidden: DataFrame) -> DataFrame:
    """steps without the stop pairs (o, d) of forbidden."""
    return steps.join(forbidden.select("o", "d"), ["o", "d"], "left_anti")


def without_group(required: DataFrame, stop: str) -> DataFrame:
    """required (stop_id, rep) without the whole group of a stop."""
    return required.join(required.filter(F.col("stop_id") == stop).select("rep"), "rep", "left_anti").select("stop_id", "rep")


def required_edge(steps: DataFrame, a: str, b: str) -> DataFrame:
    """steps after the edge a -> b was made compulsory: a and b become the stop 'a+b', reached at a and left from b."""
    from tramline.operators.asof import connections

    steps = cut(steps)
    name = f"{a}+{b}"
    into, over = steps.filter((F.col("d") == a) & (F.col("o") != b)), steps.filter((F.col("o") == a) & (F.col("d") == b))
    columns = ["o", "d", "dep", "arr", "trip_id", "is_flex"]
    through = connections(into, over).withColumn("d", F.lit(name)).select(*columns)
    out = steps.filter((F.col("o") == b) & (F.col("d") != a)).withColumn("o", F.lit(name)).select(*columns)
    rest = steps.filter(~F.col("o").isin(a, b) & ~F.col("d").isin(a, b)).select(*columns)
    return rest.unionByName(through).unionByName(out)


def edited(steps: DataFrame, edits: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(steps, parts) after a list of edits ("forbid" or "require", a, b), one after the other.

    Edits name plain stops. Once a -> b is compulsory, what is reached at a and left from b is one
    stop, so a later edit into a or out of b means that one; edges out of a or into b are gone, so
    forbidding one changes nothing and requiring one raises. parts (stop, place, part) lists the plain
    stops of the composite stops that are left.
    """
    from tramline.operators.paths import expanded

    spark, steps = steps.sparkSession, cut(steps)
    # The node that is reached at, or left from, a plain stop, and the plain stops at a node's ends.
    reached, left, ends = {}, {}, {}
    composites = []
    for kind, a, b in edits:
        o, d = left.get(a, a), reached.get(b, b)
        exists = o is not None and d is not None and o != d
        if kind == "forbid":
            if exists:
                steps = cut(without_edges(steps, spark.createDataFrame([(o, d)], "o string, d string").hint("broadcast")))
        elif kind == "require":
            if not exists:
                raise ValueError(f"the edge {a} -> {b} is gone, it can't be required")
            steps = cut(required_edge(steps, o, d))
            name, begin, end = f"{o}+{d}", ends.get(o, (o, o))[0], ends.get(d, (d, d))[1]
            ends[name] = begin, end
            composites.append((name, o, d))
            left[a] = reached[b] = None
            reached[begin] = left[end] = name
        else:
            raise ValueError(f"an edit forbids or requires, not {kind!r}")
    inner = {x for _, a, b in composites for x in (a, b)}
    parts = expanded(spark.createDataFrame(composites, "stop string, a string, b string"))
    return steps, parts.filter(~F.col("stop").isin(*inner)) if inner else parts
