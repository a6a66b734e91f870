"""Tours over required stops: evaluation along given stops, insertion, and search over few stops.

tours: (tour_id, stops array<string>); paths: (o, d, dep, arr, is_flex), minimal
between each pair, as `profiles.reduced` gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators.asof import asof_next
from tramline.operators.lineage import cut, small
from tramline.operators.steps import minimal_cover

ROW = ["tour_id", "o", "d", "dep", "arr", "is_flex"]


def _extend(now: DataFrame, edges: DataFrame) -> DataFrame:
    """now (tour_id, o, d, dep, arr, is_flex) continued over edges (tour_id, via, to, dep2, arr2, f2), minimal for each tour."""
    rides, walks = now.filter("not is_flex"), now.filter("is_flex")
    ride2 = edges.filter("not f2").select("tour_id", "to", F.col("dep2").alias("leave"), F.col("arr2").alias("arr"))
    caught = asof_next(rides.select("tour_id", F.col("arr").alias("at"), "o", "dep").join(edges.select("tour_id", "to").distinct(), "tour_id"), ride2, ["tour_id", "to"], "at", "leave", ["arr"]).filter("next_leave is not null")
    caught = caught.select("tour_id", "o", F.col("to").alias("d"), "dep", F.col("next_arr").alias("arr"), F.lit(False).alias("is_flex"))

    def product(x, y):
        x = x.select("tour_id", "o", F.col("dep").alias("dep1"), F.col("arr").alias("arr1"), F.col("is_flex").alias("f1"))
        flex, dep, arr = C.merged_step(F.col("f1"), F.col("dep1"), F.col("arr1"), F.col("f2"), F.col("dep2"), F.col("arr2"))
        return x.join(y, "tour_id").select("tour_id", "o", F.col("to").alias("d"), dep.alias("dep"), arr.alias("arr"), flex.alias("is_flex"))

    every = caught.unionByName(product(walks, edges)).unionByName(product(rides, edges.filter("f2")))
    return minimal_cover(every, ("tour_id", "o", "d"), ("is_flex",)).dropDuplicates(ROW)


def _edges_at(tours: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    pair = tours.filter(F.size("stops") > k + 1).select("tour_id", F.col("stops")[k].alias("o"), F.col("stops")[k + 1].alias("d"))
    return pair.join(paths, ["o", "d"]).select("tour_id", F.col("o").alias("via"), F.col("d").alias("to"), F.col("dep").alias("dep2"), F.col("arr").alias("arr2"), F.col("is_flex").alias("f2"))


def evaluated(tours: DataFrame, paths: DataFrame, every_prefix: bool = False, from_midnight: bool = True) -> DataFrame:
    """(tour_id, o, d, dep, arr, is_flex): all minimal ways along each tour's stops in order; none leaves before 00:00.

    every_prefix keeps those of each beginning as well, with n, its number of stops.
    from_midnight: false keeps ways that leave earlier, to be continued at their beginning.
    """
    tours, paths = cut(tours), paths.select("o", "d", "dep", "arr", "is_flex")
    longest = tours.agg(F.max(F.size("stops"))).first()[0] or 0
    first = _edges_at(tours, paths, 0)
    now = cut(first.select("tour_id", F.col("via").alias("o"), F.col("to").alias("d"), F.col("dep2").alias("dep"), F.col("arr2").alias("arr"), F.col("f2").alias("is_flex")))
    steps = [now.withColumn("n", F.lit(2))]
    for k in range(1, longest - 1):
        now = cut(_extend(now, _edges_at(tours, paths, k)))
        steps.append(now.withColumn("n", F.lit(k + 2)))
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    if not every_prefix:
        every = every.join(tours.select("tour_id", F.size("stops").alias("n")), ["tour_id", "n"])
    if from_midnight:
        every = every.filter(F.col("is_flex") | (F.col("dep") >= 0))
    return every if every_prefix else every.select(*ROW)


def reversed_tours(tours: DataFrame) -> DataFrame:
    return tours.select("tour_id", F.reverse("stops").alias("stops"))


def mirrored(steps: DataFrame) -> DataFrame:
    """steps with time and direction turned round: a ride from o to d becomes one from d to o that leaves at -arr and ends at -dep.

    Which step replaces which stays the same, so a look for the next departure among
    mirrored steps is one for the latest arrival before, under the same minimal cover.
    """
    turned = {"o": F.col("d"), "d": F.col("o"), "dep": F.when(F.col("is_flex"), F.col("dep")).otherwise(-F.col("arr")), "arr": F.when(F.col("is_flex"), F.col("arr")).otherwise(-F.col("dep"))}
    return steps.select(*[turned[c].alias(c) if c in turned else F.col(c) for c in steps.columns])


def endings(tours: DataFrame, paths: DataFrame, from_midnight: bool = True) -> DataFrame:
    """(tour_id, o, d, dep, arr, is_flex, n): all minimal ways along the last n stops of each tour, built from the last stop backwards.

    Each round puts one more pair of stops before what there is: for each departure the latest arrival in time.
    """
    back = evaluated(reversed_tours(tours), mirrored(paths.select("o", "d", "dep", "arr", "is_flex")), every_prefix=True, from_midnight=False)
    found = mirrored(back)
    return found.filter(F.col("is_flex") | (F.col("dep") >= 0)) if from_midnight else found


def best(found: DataFrame) -> DataFrame:
    """The ways of least duration of each tour, with all ties."""
    rank = F.rank().over(Window.partitionBy("tour_id").orderBy(F.col("arr") - F.col("dep")))
    return found.withColumn("_r", rank).filter("_r = 1").drop("_r")


def insertions(tours: DataFrame, stops: DataFrame) -> DataFrame:
    """Every tour with each new stop (stop_id) at every inner place: (tour_id, base, stop, place, stops)."""
    # Every tour takes every stop that it hasn't got, so the result has as many rows as the product.
    new = tours.crossJoin(small(cut(stops.select(F.col("stop_id").alias("stop"))))).filter(~F.array_contains("stops", F.col("stop")))
    placed = new.filter(F.size("stops") > 1).select("*", F.explode(F.sequence(F.lit(1), F.size("stops") - 1)).alias("place"))
    whole = F.concat(F.slice("stops", F.lit(1), F.col("place")), F.array("stop"), F.slice("stops", F.col("place") + 1, F.size("stops") - F.col("place")))
    return placed.select(F.concat_ws("/", F.col("tour_id").cast("string"), "stop", F.col("place").cast("string")).alias("tour_id"), F.col("tour_id").alias("base"), "stop", "place", whole.alias("stops"))


def best_insertions(tours: DataFrame, stops: DataFrame, paths: DataFrame) -> DataFrame:
    """(base, stop, place, duration): for each tour and new stop the place that makes the shortest way; the first of equals.

    Beginnings and endings of the tours are made once. A place joins the beginning up to it, the two
    legs by way of the new stop, and the ending from there: three look-ups, however long the tour.
    """
    tours, paths = cut(tours), cut(paths.select("o", "d", "dep", "arr", "is_flex"))
    tried = cut(insertions(tours, stops))
    if tried.isEmpty():
        return tried.select("base", "stop", "place", F.lit(None).cast("int").alias("duration"), "stops")
    before = _with_ends(tours, evaluated(tours, paths, every_prefix=True, from_midnight=False), first=True)
    after = _with_ends(tours, endings(tours, paths, from_midnight=False), first=False)
    key = tried.select("tour_id", "base", F.col("place").alias("n"), (F.size("stops") - 1 - F.col("place")).alias("m"), F.col("stops")[F.col("place") - 1].alias("a"), F.col("stop").alias("s"), F.col("stops")[F.col("place") + 1].alias("b"))
    key = cut(key)
    now = key.select("tour_id", "base", "n").join(before.withColumnRenamed("tour_id", "base").hint("merge"), ["base", "n"]).select(*ROW)
    leg = lambda o, d: _leg(key.select("tour_id", F.col(o).alias("o"), F.col(d).alias("d")), paths)
    ends = key.select("tour_id", "base", F.col("m").alias("n")).join(after.withColumnRenamed("tour_id", "base").hint("merge"), ["base", "n"])
    ends = ends.select("tour_id", F.col("o").alias("via"), F.col("d").alias("to"), F.col("dep").alias("dep2"), F.col("arr").alias("arr2"), F.col("is_flex").alias("f2"))
    for edges in (leg("a", "s"), leg("s", "b"), ends):
        now = cut(_extend(now, cut(edges)))
    cost = now.filter(F.col("is_flex") | (F.col("dep") >= 0)).groupBy("tour_id").agg(F.min(F.col("arr") - F.col("dep")).alias("duration"))
    rank = F.row_number().over(Window.partitionBy("base", "stop").orderBy("duration", "place"))
    return tried.join(cost, "tour_id").withColumn("_r", rank).filter("_r = 1").select("base", "stop", "place", "duration", "stops")


def _with_ends(tours: DataFrame, ways: DataFrame, first: bool) -> DataFrame:
    """Ways along the first or last n stops of tours, with those over one stop: a walk of no length."""
    end = F.col("stops")[0] if first else F.element_at("stops", -1)
    one = tours.select("tour_id", end.alias("o"), end.alias("d"), F.lit(0).alias("dep"), F.lit(0).alias("arr"), F.lit(True).alias("is_flex"), F.lit(1).alias("n"))
    return cut(ways.select(*ROW, "n").unionByName(one))


def _leg(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges for _extend over one pair of stops (o, d) of each tour."""
    found = pairs.join(paths.hint("merge"), ["o", "d"])
    return found.select("tour_id", F.col("o").alias("via"), F.col("d").alias("to"), F.col("dep").alias("dep2"), F.col("arr").alias("arr2"), F.col("is_flex").alias("f2"))


def groups_visited(tours: DataFrame, groups: DataFrame) -> DataFrame:
    """(tour_id, groups): how many required groups (stop_id, rep) a tour visits."""
    on = tours.select("tour_id", F.explode("stops").alias("stop_id")).join(small(groups), "stop_id")
    return on.groupBy("tour_id").agg(F.countDistinct("rep").alias("groups"))


def unvisited(tours: DataFrame, groups: DataFrame) -> DataFrame:
    """(tour_id, rep): groups that a tour doesn't visit."""
    on = cut(tours.select("tour_id", F.explode("stops").alias("stop_id")).join(small(groups), "stop_id").select("tour_id", "rep"))
    # What a tour lacks is the rest of all groups, so every pair of tour and group is either in the result or in on.
    return tours.select("tour_id").crossJoin(small(groups.select("rep").distinct())).join(on, ["tour_id", "rep"], "left_anti")


def orders(spark, stops: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """(tour_id, stops) of all orders of a few stops, between fixed ends if given."""
    if len(stops) > 8:
        raise ValueError("all orders of more than 8 stops are too many; use shortest_tour")
    now = spark.createDataFrame([([start] if start else [],)], "stops array<string>")
    for _ in stops:
        now = now.select("stops", F.explode(F.array_except(F.array(*[F.lit(s) for s in stops]), F.col("stops"))).alias("s")).select(F.concat("stops", F.array("s")).alias("stops"))
    if end:
        now = now.select(F.concat("stops", F.array(F.lit(end))).alias("stops"))
    return now.select(F.array_join("stops", ">").alias("tour_id"), "stops")


def shortest_tour(stops: list[str], paths: DataFrame, limit: int = 10) -> DataFrame:
    """(tour_id, stops, dep, arr, duration): the shortest ways to visit all stops, over all orders.

    Beginnings grow by one stop a round, all at once. Of beginnings over the same
    stops with the same last one only ways that no other replaces go on.
    """
    if len(stops) > limit:
        raise ValueError(f"more than {limit} stops")
    spark = paths.sparkSession
    edges = cut(paths.filter(F.col("o").isin(stops) & F.col("d").isin(stops)).select("o", "d", "dep", "arr", "is_flex"))
    now = cut(edges.select(F.array("o", "d").alias("stops"), "dep", "arr", "is_flex"))
    for _ in range(len(stops) - 2):
        state = now.select(F.array_join(F.array_sort(F.slice("stops", F.lit(1), F.size("stops") - 1)), ">").alias("seen"), F.element_at("stops", -1).alias("last"), "*")
        named = cut(state.withColumn("tour_id", F.array_join("stops", ">")))
        more = named.select("tour_id", "stops", "last").distinct().join(edges.select(F.col("o").alias("last"), F.col("d").alias("to"), F.col("dep").alias("dep2"), F.col("arr").alias("arr2"), F.col("is_flex").alias("f2")), "last")
        more = more.filter(~F.array_contains("stops", F.col("to"))).select("tour_id", F.col("last").alias("via"), "to", "dep2", "arr2", "f2")
        ways = _extend(named.select("tour_id", F.lit("").alias("o"), F.col("last").alias("d"), "dep", "arr", "is_flex"), more)
        grown = ways.join(named.select("tour_id", "stops").distinct(), "tour_id").select(F.concat("stops", F.array("d")).alias("stops"), "dep", "arr", "is_flex")
        grown = grown.withColumn("_set", F.array_join(F.array_sort("stops"), ">")).withColumn("_last", F.element_at("stops", -1)).withColumn("_order", F.array_join("stops", ">"))
        now = cut(minimal_cover(grown, ("_set", "_last"), ("_order",)).select("stops", "dep", "arr", "is_flex"))
    found = now.filter(F.col("is_flex") | (F.col("dep") >= 0)).select(F.lit("all").alias("tour_id"), "stops", "dep", "arr", "is_flex")
    rank = F.rank().over(Window.partitionBy("tour_id").orderBy(F.col("arr") - F.col("dep")))
    return found.withColumn("_r", rank).filter("_r = 1").select(F.array_join("stops", ">").alias("tour_id"), "stops", "dep", "arr", (F.col("arr") - F.col("dep")).alias("duration")) if spark else found


#: Groups that the bits of a mask can name.
MOST_GROUPS = 62


def shortest_group_tour(groups: DataFrame, paths: DataFrame, known: int | None = None) -> DataFrame:
    """(stops, dep, arr, duration): the shortest ways that visit one stop of every group (stop_id, rep), over all orders and choices.

    Beginnings grow by a stop of a new group a round, all at once. A beginning is known by its
    set of groups (a mask) and its last stop; of those with the same two only ways that no other
    replaces go on. Bounds cut more: a beginning goes no further if its duration and the least
    distance to the farthest group still missing exceed that of a known tour (known, else one
    found by always going to the nearest group), as no tour from there is shorter.
    Distances come from the relaxed graph. The work doubles with each group, which the task's nature asks for; paths
    have to be closed under changes, as `profiles.reduced` with complete gives them.
    """
    spark = paths.sparkSession
    numbers = {r["rep"]: i for i, r in enumerate(groups.select("rep").distinct().orderBy("rep").limit(MOST_GROUPS + 1).collect())}
    if not 2 <= len(numbers) <= MOST_GROUPS:
        raise ValueError(f"a tour needs 2 to {MOST_GROUPS} groups")
    bits = F.create_map(*[x for rep, i in numbers.items() for x in (F.lit(rep), F.lit(1 << i).cast("long"))])
    members = small(cut(groups.select("stop_id", bits[F.col("rep")].alias("bit")).distinct()))
    end = lambda name: members.withColumnRenamed("stop_id", name).withColumnRenamed("bit", f"{name}_bit")
    edges = cut(paths.select("o", "d", "dep", "arr", "is_flex").join(end("o"), "o").join(end("d"), "d").filter("o_bit <> d_bit"))
    least = cut(edges.groupBy("o", "o_bit", "d", "d_bit").agg(F.min(F.col("arr") - F.col("dep")).alias("w")))
    far = cut(least.groupBy(F.col("o").alias("last"), F.col("d_bit").alias("bit")).agg(F.min("w").alias("w")))
    if known is None:
        known = _nearest_tour(least, len(numbers), paths)
    every = (1 << len(numbers)) - 1
    now = cut(edges.select(F.array("o", "d").alias("stops"), (F.col("o_bit") + F.col("d_bit")).alias("mask"), F.col("d").alias("last"), "dep", "arr", "is_flex"))
    step2 = edges.select(F.col("o").alias("last"), F.col("d").alias("to"), F.col("d_bit").alias("bit"), F.col("dep").alias("dep2"), F.col("arr").alias("arr2"), F.col("is_flex").alias("f2"))
    for _ in range(len(numbers) - 2):
        if known is not None:
            # The group farthest from the last stop among those missing; a group out of reach ends the beginning.
            rest = now.select("mask", "last").distinct().join(far.hint("merge"), "last").filter(F.col("mask").bitwiseAND(F.col("bit")) == 0)
            rest = rest.groupBy("mask", "last").agg(F.max("w").alias("rest"))
            now = cut(now.join(rest.hint("merge"), ["mask", "last"]).filter(F.col("arr") - F.col("dep") + F.col("rest") <= known).drop("rest"))
        named = cut(now.withColumn("tour_id", F.array_join("stops", ">")))
        begun = cut(named.select("tour_id", "stops", "mask", "last").distinct())
        more = cut(begun.join(step2.hint("merge"), "last").filter(F.col("mask").bitwiseAND(F.col("bit")) == 0).select("tour_id", F.col("last").alias("via"), "to", "dep2", "arr2", "f2"))
        ways = _extend(named.select("tour_id", F.lit("").alias("o"), F.col("last").alias("d"), "dep", "arr", "is_flex"), more)
        grown = ways.join(begun.select("tour_id", "stops", "mask").hint("merge"), "tour_id").join(end("d"), "d")
        grown = grown.select(F.concat("stops", F.array("d")).alias("stops"), (F.col("mask") + F.col("d_bit")).alias("mask"), F.col("d").alias("last"), "dep", "arr", "is_flex")
        grown = grown.withColumn("_order", F.array_join("stops", ">"))
        now = cut(minimal_cover(grown, ("mask", "last"), ("_order",)).drop("_order"))
    found = now.filter((F.col("mask") == every) & (F.col("is_flex") | (F.col("dep") >= 0)))
    rank = F.rank().over(Window.partitionBy("mask").orderBy(F.col("arr") - F.col("dep")))
    return found.withColumn("_r", rank).filter("_r = 1").select("stops", "dep", "arr", (F.col("arr") - F.col("dep")).cast("int").alias("duration"))


def _nearest_tour(least: DataFrame, count: int, paths: DataFrame, starts: int = 8) -> int | None:
    """The duration of the best of some tours that always go on to the nearest group not yet visited; null if none ends.

    least (o, o_bit, d, d_bit, w) is the relaxed graph of the members, whose rows are counted first.
    """
    if least.limit(20_001).count() > 20_000:
        return None
    out: dict = {}
    for r in least.collect():
        out.setdefault((r["o"], r["o_bit"]), []).append((r["w"], r["d"], r["d_bit"]))
    tried = []
    for stop, bit in sorted(out)[:starts]:
        tour, mask, at = [stop], bit, (stop, bit)
        while len(tour) < count:
            nearest = min((x for x in out.get(at, []) if not mask & x[2]), default=None)
            if nearest is None:
                break
            tour.append(nearest[1])
            mask |= nearest[2]
            at = nearest[1], nearest[2]
        if len(tour) == count:
            tried.append((str(len(tried)), tour))
    if not tried:
        return None
    tours = paths.sparkSession.createDataFrame(tried, "tour_id string, stops array<string>")
    return evaluated(tours, paths).agg(F.min(F.col("arr") - F.col("dep"))).first()[0]


def greedy_extension(tour: DataFrame, groups: DataFrame, paths: DataFrame) -> DataFrame:
    """tour (one row) with unvisited stops put in one after the other, as long as it gets no longer."""
    duration = lambda t: evaluated(t, paths).agg(F.min(F.col("arr") - F.col("dep"))).first()[0]
    now = cut(tour.select("tour_id", "stops"))
    least = duration(now)
    while True:
        left = unvisited(now, groups).select(F.col("rep").alias("stop_id"))
        step = best_insertions(now, left, paths).filter(F.col("duration") <= least).orderBy("duration", "stop").limit(1)
        step = cut(step.select(F.col("base").alias("tour_id"), "stops"))
        if step.isEmpty():
            return now
        now = step


def lazy_tour(groups: DataFrame, paths: DataFrame, first: list[str], limit: int = 8) -> tuple[list[str], int | None, bool]:
    """(stops, duration, whole): a tour over few stops that visits all groups, if one is found.

    Solve a subset of stops, extend the tour for free, and add the missing group that is
    farthest from the stops of the tour (the first by name of equals), by its nearest stop.
    Distances are those of one table between all stops, made once. whole is false where the
    subset grew beyond the limit first.
    """
    from tramline.operators.graph import distances, relaxed_edges

    subset, spark = sorted(first), paths.sparkSession
    stops = groups.select("stop_id").distinct()
    apart = cut(distances(relaxed_edges(paths), stops))
    while True:
        found = shortest_tour(subset, paths, limit).orderBy("tour_id").first()
        if found is None:
            return subset, None, False
        tour = spark.createDataFrame([("t", found["stops"])], "tour_id string, stops array<string>")
        tour = cut(greedy_extension(tour, groups, paths))
        missing = farthest_missing(tour, groups, apart).orderBy(F.desc_nulls_first("dist"), "rep").first()
        if missing is None:
            return tour.first()["stops"], found["duration"], True
        subset = sorted({*subset, missing["stop"]})
        if len(subset) > limit:
            return tour.first()["stops"], found["duration"], False


def farthest_missing(tour: DataFrame, groups: DataFrame, apart: DataFrame) -> DataFrame:
    """(rep, stop, dist): each group that a tour (one row) doesn't visit, with its stop nearest to the tour's; dist is null where none is reached.

    apart (src, stop, dist): shortest distances between stops.
    """
    on = small(cut(tour.select(F.explode("stops").alias("src")).distinct()))
    near = cut(apart.join(on, "src").groupBy("stop").agg(F.min("dist").alias("dist")))
    left = unvisited(tour, groups).select("rep").join(small(groups.select("stop_id", "rep")), "rep")
    rows = left.withColumnRenamed("stop_id", "stop").join(small(near), "stop", "left")
    nearest = F.row_number().over(Window.partitionBy("rep").orderBy(F.asc_nulls_last("dist"), "stop"))
    return rows.withColumn("_r", nearest).filter("_r = 1").select("rep", "stop", "dist")
