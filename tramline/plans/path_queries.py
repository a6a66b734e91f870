"""Queries over paths: each trip as a path over its rides, with and without walks, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators import asof, catalog, feed, graph, legs, paths, profiles, required, services, steps
from tramline.operators.lineage import cut
from tramline.plans import demo
from tramline.plans.demo import DATE, sql
from tramline.plans.timetable_queries import _PARTED, day_of, edges_of, network_of, parted, required_of, steps_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None, *more: tuple[str, str]):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, demo.feed(spark, sf_dir))
        if text:
            ORACLE_SQL[name] = sql(text, *more)
        return f

    return add


def trip_paths(g) -> DataFrame:
    return paths.of_trips(steps_of(g))


def walked_legs(g) -> DataFrame:
    """The legs of each trip with a walk before the first ride, one after the second of three or more, and one at the end."""
    by = Window.partitionBy("trip_id").orderBy("dep")
    rides = steps_of(g).withColumn("k", F.row_number().over(by)).withColumn("of", F.count("*").over(Window.partitionBy("trip_id")))
    leg = lambda pos, o, d, dep, arr, flex: F.struct(pos.cast("int").alias("pos"), o.alias("o"), d.alias("d"), dep.cast("int").alias("dep"), arr.cast("int").alias("arr"), F.when(flex, "walk").otherwise(F.col("trip_id")).alias("trip_id"), flex.alias("is_flex"))
    o, d, dep, arr, k, of = (F.col(c) for c in ("o", "d", "dep", "arr", "k", "of"))
    yes, zero = F.lit(True), F.lit(0)
    ride = F.array(leg(k * 10, o, d, dep, arr, F.lit(False)))
    first = F.when(k == 1, F.array(leg(F.lit(5), o, o, zero, 30 + dep % 60, yes)))
    middle = F.when((k == 2) & (of > 2), F.array(leg(F.lit(25), d, d, zero, F.lit(10), yes)))
    last = F.when(k == of, F.array(leg(of * 10 + 5, d, d, zero, 30 + arr % 60, yes)))
    none = F.filter(ride, lambda x: F.lit(False))
    every = F.concat(ride, *[F.coalesce(x, none) for x in (first, middle, last)])
    return rides.select(F.col("trip_id").alias("path_id"), F.explode(every).alias("x")).select("path_id", "x.*")


_T = (
    ("tleg", "SELECT trip_id AS path_id, o, d, dep, arr, row_number() OVER (PARTITION BY trip_id ORDER BY dep) AS k, count(*) OVER (PARTITION BY trip_id) AS n FROM steps"),
    ("tpath", "SELECT path_id, min_by(o, k) AS o, max_by(d, k) AS d, min(dep) AS dep, max_by(arr, k) AS arr, count(*) AS n, string_agg(d, ',' ORDER BY k) AS ds FROM tleg GROUP BY path_id"),
    ("tmid", "SELECT DISTINCT l.path_id, p.o, p.d, l.d AS stop FROM tleg l JOIN tpath p USING (path_id) WHERE l.k < l.n AND l.d <> p.o AND l.d <> p.d"),
    ("wleg", "SELECT path_id, k * 10 AS pos, o, d, dep, arr, false AS f FROM tleg UNION ALL SELECT path_id, 5, o, o, 0, 30 + dep % 60, true FROM tleg WHERE k = 1 UNION ALL SELECT path_id, 25, d, d, 0, 10, true FROM tleg WHERE k = 2 AND n > 2 UNION ALL SELECT path_id, n * 10 + 5, d, d, 0, 30 + arr % 60, true FROM tleg WHERE k = n"),
    ("wsum", "SELECT *, CASE WHEN f THEN arr - dep ELSE 0 END AS len, sum(CASE WHEN f THEN arr - dep ELSE 0 END) OVER (PARTITION BY path_id ORDER BY pos) AS s FROM wleg"),
    ("wrun", "SELECT *, last_value(CASE WHEN NOT f THEN arr END IGNORE NULLS) OVER w AS b_arr, last_value(CASE WHEN NOT f THEN s END IGNORE NULLS) OVER w AS b_s, first_value(CASE WHEN NOT f THEN dep END IGNORE NULLS) OVER v AS a_dep, first_value(CASE WHEN NOT f THEN s END IGNORE NULLS) OVER v AS a_s FROM wsum WINDOW w AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
)

# --- scalars


@query("b10_walk_seconds", "SELECT s.stop_id, CAST(floor(sqrt(power((s.stop_lon - p.stop_lon) * 111000.0 * cos(radians(37.0)), 2) + power((s.stop_lat - p.stop_lat) * 111000.0, 2)) / 1.3) AS INT) AS seconds FROM g_stops s JOIN g_stops p ON p.stop_id = concat('N', CAST(hash_k % 25 AS STRING)) CROSS JOIN (SELECT 1) WHERE s.stop_id LIKE 'P%'".replace("hash_k", "CAST(substr(s.stop_id, 2) AS BIGINT)"))
def _(spark, g):
    at = steps.positions(g.stops)
    mine = at.filter("stop_id like 'P%'").withColumn("to", F.concat(F.lit("N"), (F.substring("stop_id", 2, 20).cast("long") % 25).cast("string")))
    other = at.select(F.col("stop_id").alias("to"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return mine.join(other, "to").select("stop_id", C.walk_seconds(C.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")), 1.3).alias("seconds"))


@query("b14_path_stops", "SELECT p.path_id, CAST(n - 1 AS INT) AS between_n, concat(p.o, ',', ds) AS stops, coalesce(m.mids, '') AS between_stops FROM tpath p LEFT JOIN (SELECT path_id, string_agg(d, ',' ORDER BY k) AS mids FROM tleg WHERE k < n GROUP BY path_id) m USING (path_id)", *_T)
def _(spark, g):
    x = F.col("legs")
    return trip_paths(g).select("path_id", (F.size(x) - 1).alias("between_n"), F.array_join(paths.stops_of(x), ",").alias("stops"), F.array_join(paths.inner_stops(x), ",").alias("between_stops"))


@query("b17_zero_edges", "SELECT stop_id AS o, parent_station AS d, 0 AS dep, 0 AS arr FROM g_stops WHERE parent_station IS NOT NULL")
def _(spark, g):
    return paths.zero_edges(g.stops.filter("parent_station is not null").select(F.col("stop_id").alias("o"), F.col("parent_station").alias("d"))).select("o", "d", "dep", "arr")


@query("b18_merged_steps", "SELECT path_id, CAST(pos AS INT) AS pos, CAST(CASE WHEN pf AND f THEN 0 WHEN pf THEN dep - (pa - pd) ELSE pd END AS INT) AS dep, CAST(CASE WHEN pf AND f THEN pa - pd + arr - dep WHEN f THEN pa + arr - dep ELSE arr END AS INT) AS arr, pf AND f AS is_flex FROM (SELECT *, lag(f) OVER w AS pf, lag(dep) OVER w AS pd, lag(arr) OVER w AS pa FROM wleg WINDOW w AS (PARTITION BY path_id ORDER BY pos)) WHERE pf IS NOT NULL", *_T)
def _(spark, g):
    return paths.merged_neighbours(walked_legs(g))


@query("b19_merged_runs", "SELECT path_id, CAST(min(CASE WHEN NOT f THEN dep END) - sum(CASE WHEN f AND pos = 5 THEN len ELSE 0 END) AS INT) AS dep, CAST(max(CASE WHEN NOT f THEN arr END) + sum(CASE WHEN f AND b_s IS NOT NULL AND a_s IS NULL THEN len ELSE 0 END) AS INT) AS arr, false AS is_flex FROM wrun GROUP BY path_id", *_T)
def _(spark, g):
    return paths.of_legs(walked_legs(g)).select("path_id", "dep", "arr", "is_flex")


_SEQ = "SELECT path_id, CAST(pos AS INT) AS pos, CAST(CASE WHEN NOT f THEN dep WHEN b_arr IS NOT NULL THEN b_arr + s - b_s - len ELSE a_dep - (a_s - s) - len END AS INT) AS dep, CAST(CASE WHEN NOT f THEN arr WHEN b_arr IS NOT NULL THEN b_arr + s - b_s ELSE a_dep - (a_s - s) END AS INT) AS arr, f AS is_flex FROM wrun"


@query("b20_walks_fitted", _SEQ, *_T)
def _(spark, g):
    return legs.walks_in_sequence(walked_legs(g)).select("path_id", "pos", "dep", "arr", "is_flex")


@query("f6_walks_before_rides", "SELECT path_id, CAST(pos AS INT) AS pos, CAST(CASE WHEN f AND a_dep IS NOT NULL THEN a_dep - (a_s - s) - len ELSE dep END AS INT) AS dep, CAST(CASE WHEN f AND a_dep IS NOT NULL THEN a_dep - (a_s - s) ELSE arr END AS INT) AS arr, f AS is_flex FROM wrun", *_T)
def _(spark, g):
    return legs.walks_at_last_moment(walked_legs(g)).select("path_id", "pos", "dep", "arr", "is_flex")


@query("b23_on_map", "SELECT stop_id, CAST(round((stop_lon - w) * k * z, 4) AS DOUBLE) AS cx, CAST(round((n - stop_lat) * z, 4) AS DOUBLE) AS cy FROM g_stops, (SELECT *, least(800.0 / greatest((e - w) * k, 1e-9), 600.0 / greatest(n - s, 1e-9)) AS z FROM (SELECT *, cos(radians((s + n) / 2)) AS k FROM (SELECT min(stop_lat) AS s, max(stop_lat) AS n, min(stop_lon) AS w, max(stop_lon) AS e FROM g_stops)))")
def _(spark, g):
    return required.on_map(g.stops, 800.0, 600.0).select("stop_id", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


@query("b28_edge_keys", "SELECT least(o, d) AS lo, greatest(o, d) AS hi, count(*) AS n FROM steps GROUP BY ALL")
def _(spark, g):
    lo, hi = C.undirected(F.col("o"), F.col("d"))
    return steps_of(g).groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"))


# --- filters


@query("c10_from_midnight", "SELECT path_id, CAST(dep - 40000 AS INT) AS dep, CAST(arr - 40000 AS INT) AS arr FROM tpath WHERE dep >= 40000", *_T)
def _(spark, g):
    moved = trip_paths(g).select("path_id", (F.col("dep") - 40000).alias("dep"), (F.col("arr") - 40000).alias("arr"))
    return paths.from_midnight(moved)


@query("c11_not_through", f"SELECT path_id, o, d FROM tpath p WHERE NOT EXISTS (SELECT 1 FROM tmid m WHERE m.path_id = p.path_id AND m.stop IN {tuple(f'N{i}' for i in (0, 4, 11, 17, 23))})", *_T)
def _(spark, g):
    return paths.not_through(trip_paths(g), required_of(spark)).select("path_id", "o", "d")


@query("c12_departure_window", "SELECT path_id, dep FROM tpath WHERE dep >= 21600 AND dep < 43200", *_T)
def _(spark, g):
    return paths.in_window(trip_paths(g), 21600, 43200).select("path_id", "dep")


_SUPPLIED = ("sgrp", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS stop_id, concat('N', CAST(s_nationkey AS STRING)) AS rep FROM supplier")


def supplied_groups(spark) -> DataFrame:
    """Suppliers as required stops, those of a nation as one group: as many as there are suppliers."""
    return spark.table("supplier").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("stop_id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("rep"))


@query("c13_whole_groups", "SELECT stop_id, rep FROM sgrp WHERE rep IN (SELECT rep FROM sgrp JOIN g_stop_times USING (stop_id) WHERE stop_sequence = 7 AND trip_id LIKE '%77' GROUP BY rep)", _SUPPLIED)
def _(spark, g):
    wanted = spark.table("g_stop_times").filter("stop_sequence = 7 and trip_id like '%77'").select("stop_id")
    return required.only_groups_of(supplied_groups(spark), wanted)


@query("c14_without_boundary", "SELECT o, d, dep, trip_id FROM steps")
def _(spark, g):
    with_ends = steps_of(g).unionByName(steps.boundary(feed.normalized(day_of(g)).stops))
    return legs.without_boundary(with_ends).select("o", "d", "dep", "trip_id")


@query("c16_shortest_paths", "SELECT path_id, o, d, CAST(arr - dep AS INT) AS duration FROM (SELECT *, min(arr - dep) OVER (PARTITION BY o, d) AS least FROM tpath) WHERE arr - dep = least", *_T)
def _(spark, g):
    return paths.shortest(trip_paths(g)).select("path_id", "o", "d", (F.col("arr") - F.col("dep")).alias("duration"))


@query("c16_paths_within", "SELECT path_id FROM tpath WHERE arr - dep <= 900", *_T)
def _(spark, g):
    return trip_paths(g).filter(F.col("arr") - F.col("dep") <= 900).select("path_id")


@query("c19_network_stops", "SELECT stop_id FROM g_stops WHERE stop_id IN (SELECT stop_id FROM nst) OR stop_id IN ('N1', 'N7')")
def _(spark, g):
    wanted = spark.createDataFrame([("N1",), ("N7",)], "stop_id string")
    return required.explorer_stops(g.stops, wanted, feed.normalized(day_of(g)).stop_times).filter("kind <> 'original'").select("stop_id")


@query("c19_run_iteration", "SELECT event_id, user_id AS run_id, event_id % 7 AS iteration FROM events WHERE event_id % 7 = 3 AND user_id % 2 = 1")
def _(spark, g):
    rows = spark.table("events").select("event_id", F.col("user_id").alias("run_id"), (F.col("event_id") % 7).alias("iteration"))
    return rows.filter("iteration = 3 and run_id % 2 = 1")


# --- joins


@query("d1_trip_routes", "SELECT t.trip_id, r.route_short_name, d.direction FROM g_trips t LEFT JOIN g_routes r USING (route_id) LEFT JOIN dirs d USING (route_id, direction_id)")
def _(spark, g):
    return feed.trip_routes(g).select("trip_id", "route_short_name", "direction")


@query("d8_step_paths", "SELECT s.path_id, CAST(l.k AS INT) AS leg, l.d AS stop, l.dep FROM (SELECT path_id, o, d, dep, arr FROM tpath) s JOIN tpath p ON p.o = s.o AND p.d = s.d AND p.dep = s.dep AND p.arr = s.arr JOIN tleg l ON l.path_id = p.path_id", *_T)
def _(spark, g):
    found = trip_paths(g)
    joined = paths.with_paths(found.drop("legs"), found)
    return joined.select("path_id", F.posexplode("legs").alias("i", "x")).select("path_id", (F.col("i") + 1).alias("leg"), F.col("x.d").alias("stop"), F.col("x.dep").alias("dep"))


@query("d12_specs_of_source", "SELECT c_custkey AS spec_id, n_name AS target, r_name AS source FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def _(spark, g):
    specs = spark.table("customer").select(F.col("c_custkey").alias("spec_id"), F.col("c_nationkey").alias("target_id"))
    targets = spark.table("nation").join(spark.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("target_id"), F.col("n_name").alias("target"), F.col("r_name").alias("source"))
    return catalog.specs_of_source(specs, targets, "ASIA").select("spec_id", "target", "source")


@query("d16_group_members", "SELECT DISTINCT stop_id, 'grouped but not required' AS problem FROM cfg WHERE stop_id NOT IN (SELECT stop_id FROM req) UNION ALL SELECT stop_id, 'in several groups' FROM cfg GROUP BY stop_id HAVING count(DISTINCT group_id) > 1", ("req", "SELECT stop_id FROM g_stops WHERE stop_lat > 37.003 AND stop_id LIKE 'P%'"), ("cfg", "SELECT l_orderkey % 40 AS group_id, concat('P', CAST(l_suppkey AS STRING)) AS stop_id FROM lineitem WHERE l_linenumber = 7"))
def _(spark, g):
    grouped = spark.table("lineitem").filter("l_linenumber = 7").select((F.col("l_orderkey") % 40).alias("group_id"), F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("stop_id"))
    return required.group_errors(g.stops.filter("stop_lat > 37.003 and stop_id like 'P%'").select("stop_id"), grouped)


@query("d19_unique_names", "SELECT q.name, CASE WHEN n = 1 THEN stop_id END AS stop_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS problem FROM (SELECT c_mktsegment AS name FROM customer UNION SELECT n_name FROM nation UNION SELECT r_name FROM region) q LEFT JOIN (SELECT stop_name AS name, min(stop_id) AS stop_id, count(*) AS n FROM (SELECT stop_id, stop_name FROM g_stops UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), c_mktsegment FROM customer) GROUP BY stop_name) s USING (name)")
def _(spark, g):
    c = spark.table("customer")
    stops = g.stops.select("stop_id", "stop_name").union(c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), "c_mktsegment"))
    names = c.select(F.col("c_mktsegment").alias("name")).union(spark.table("nation").select("n_name")).union(spark.table("region").select("r_name"))
    return paths.looked_up(names, stops)


_LAST = (
    ("deps_s", "SELECT DISTINCT o AS stop, dep FROM parted WHERE NOT is_flex"),
    ("fixed_s", "SELECT i.stop, i.part, i.t FROM into_s i JOIN flexs f USING (stop, part) WHERE NOT flex"),
    ("askl", "SELECT d.stop, d.dep, s.part FROM deps_s d JOIN (SELECT DISTINCT stop, part FROM fixed_s) s USING (stop)"),
    ("lasts", "SELECT a.stop, a.part, a.dep, b.t AS last_t FROM askl a ASOF JOIN fixed_s b ON a.stop = b.stop AND a.part = b.part AND a.dep >= b.t"),
)


@query("d23_transfers", "SELECT stop, part, dep, last_t FROM lasts", *_PARTED, *_LAST)
def _(spark, g):
    return graph.last_arrivals(parted(g))


@query("e5_transfer_weights", "SELECT stop AS o, part AS o_part, d, d_part, CAST(min(w) AS INT) AS w FROM waits GROUP BY ALL", *_PARTED)
def _(spark, g):
    return graph.waiting_edges(parted(g))


@query("d24_used_routes", "SELECT DISTINCT r.route_id, r.route_long_name FROM g_routes r JOIN g_trips t USING (route_id) JOIN tpath p ON p.path_id = t.trip_id WHERE p.dep < 600", *_T)
def _(spark, g):
    early = trip_paths(g).filter("dep < 600")
    return paths.used_routes(early, g.trips, g.routes).select("route_id", "route_long_name")


# --- aggregates, order, sets


_SAT = (
    ("sat", "SELECT service_id FROM g_calendar WHERE start_date <= '20250719' AND end_date >= '20250719' AND saturday"),
    ("wst", "SELECT trip_id, 0 AS day, stop_sequence FROM day_st WHERE trip_id LIKE 'BA:%' UNION ALL SELECT trip_id, 1, stop_sequence FROM st JOIN g_trips t USING (trip_id) WHERE service_id IN (SELECT service_id FROM sat) AND trip_id LIKE 'BA:%' AND arrival < 86400"),
)


def used_services_of(g) -> DataFrame:
    world = feed.world(g, DATE, ["BA:"], 1, keep=True)
    found = paths.of_trips(steps.from_stop_times(feed.normalized(world, feed.root_stops(g.stops)).stop_times))
    return services.used_services(found, world.trips).select("day", F.array_join("services", ",").alias("services"))


@query("e7_used_services", "SELECT day, string_agg(DISTINCT service_id, ',' ORDER BY service_id) AS services FROM (SELECT trip_id, day FROM wst GROUP BY ALL HAVING count(*) > 1) JOIN g_trips USING (trip_id) GROUP BY day", *_SAT)
def _(spark, g):
    return used_services_of(g)


@query("e8_trip_goodness", "SELECT stop, count(DISTINCT concat(o, ' ', d)) - count(DISTINCT o) - count(DISTINCT d) AS goodness FROM tmid GROUP BY stop", *_T)
def _(spark, g):
    return paths.goodness(trip_paths(g))


@query("g5_best_stop", "SELECT stop, goodness FROM (SELECT stop, count(DISTINCT concat(o, ' ', d)) - count(DISTINCT o) - count(DISTINCT d) AS goodness FROM tmid GROUP BY stop) ORDER BY goodness DESC, stop LIMIT 1", *_T)
def _(spark, g):
    return paths.goodness(trip_paths(g)).orderBy(F.desc("goodness"), "stop").limit(1)


@query("i11_split_trips", "SELECT min_by(o, k) AS o, max_by(d, k) AS d, min(dep) AS dep, max_by(arr, k) AS arr, CAST(count(*) AS INT) AS legs FROM (SELECT l.*, CASE WHEN c.at < l.n AND l.k > c.at THEN 1 ELSE 0 END AS side FROM tleg l LEFT JOIN (SELECT path_id, min(k) AS at FROM tleg WHERE d = 'N12' GROUP BY path_id) c USING (path_id)) GROUP BY path_id, side", *_T)
def _(spark, g):
    return profiles.split_at(trip_paths(g), "N12").select("o", "d", "dep", "arr", F.size("legs").alias("legs"))


_REACH = ("edges", "SELECT o, d, min(arr - dep) AS w FROM steps WHERE o <> d GROUP BY o, d")
_ON_TOUR = "('N1', 'N7', 'N12')"


def _hops(rounds: int) -> list[tuple[str, str]]:
    out = [_REACH, ("h0", f"SELECT DISTINCT o AS src, o AS stop, CAST(0 AS BIGINT) AS dist FROM edges WHERE o IN {_ON_TOUR}")]
    for i in range(1, rounds + 1):
        out.append((f"h{i}", f"SELECT src, stop, min(dist) AS dist FROM (SELECT * FROM h{i - 1} UNION ALL SELECT src, e.d, dist + w FROM h{i - 1} r JOIN edges e ON e.o = r.stop) GROUP BY src, stop"))
    return [*out, ("near", f"SELECT stop, min_by(src, concat(lpad(CAST(dist AS STRING), 12, '0'), src)) AS src, min(dist) AS dist FROM h{rounds} GROUP BY stop"), ("nrep", "SELECT rep, min_by(stop, concat(lpad(CAST(dist AS STRING), 12, '0'), stop)) AS stop, min(dist) AS dist FROM near JOIN (SELECT concat('N', CAST(n_nationkey AS STRING)) AS stop, concat('G', CAST(n_regionkey AS STRING)) AS rep FROM nation) USING (stop) GROUP BY rep")]


def _near(spark, g):
    edges = edges_of(g)
    dist = graph.distances(edges, edges.filter(F.col("o").isin("N1", "N7", "N12")).select(F.col("o").alias("stop_id")).distinct())
    groups = spark.table("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("stop_id"), F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("rep"))
    return paths.near_path(dist, groups)


@query("e21_stop_distances", "SELECT stop, src, dist FROM near", *_hops(8))
def _(spark, g):
    return _near(spark, g)[0]


@query("e21_group_distances", "SELECT rep, stop, dist FROM nrep", *_hops(8))
def _(spark, g):
    return _near(spark, g)[1]


@query("g4_farthest_stop", f"SELECT stop, dist FROM near WHERE stop NOT IN {_ON_TOUR} ORDER BY dist DESC, stop LIMIT 1", *_hops(8))
def _(spark, g):
    return _near(spark, g)[0].filter(~F.col("stop").isin("N1", "N7", "N12")).orderBy(F.desc("dist"), "stop").limit(1).select("stop", "dist")


@query("f2_skyline", "SELECT o, d, dep, trip_id, min(arr) OVER (PARTITION BY o, d ORDER BY dep, arr DESC, trip_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM steps")
def _(spark, g):
    return steps.with_later_arrival(steps_of(g)).select("o", "d", "dep", "trip_id", "later")


@query("f3_next_at_stop", "SELECT q.trip_id, q.arr, n.dep AS next_dep FROM steps q ASOF LEFT JOIN (SELECT o, dep FROM steps GROUP BY ALL) n ON q.d = n.o AND q.arr <= n.dep")
def _(spark, g):
    s = cut(steps_of(g))
    found = asof.asof_next(s.select(F.col("d").alias("stop"), "trip_id", "arr"), s.select(F.col("o").alias("stop"), "dep").distinct(), ["stop"], "arr", "dep", [], span=asof.SPAN)
    return found.select("trip_id", "arr", "next_dep")


@query("f10_merged_numbers", "SELECT DISTINCT stop, rep, new_part FROM trep JOIN tnew USING (stop, part)", *_PARTED)
def _(spark, g):
    states = graph.merged_states(graph.transfer_edges(parted(g)))
    return states.groupBy("stop", "new_part").agg(F.min("part").alias("rep")).select("stop", "rep", "new_part")


@query("f15_day_spans", "SELECT concat(trip_id, ':sd-', CAST(k AS STRING)) AS trip_id, stop_sequence, CAST(arrival + 86400 * k AS INT) AS arrival FROM day_st, range(3) r(k)")
def _(spark, g):
    return feed.repeated(day_of(g), 3).stop_times.select("trip_id", "stop_sequence", "arrival")


@query("g1_step_order", "SELECT o, d, trip_id, CAST(row_number() OVER (PARTITION BY o, d ORDER BY NOT f, dep, arr DESC, trip_id) AS INT) AS place FROM (SELECT o, d, dep, arr, trip_id, false AS f FROM steps UNION ALL SELECT o, d, 0, seconds, concat('walk:', o, ':', d), true FROM walks)")
def _(spark, g):
    rides, walks = network_of(g)
    return steps.in_order(rides.unionByName(walks)).select("o", "d", "trip_id", "place")


@query("g6_stop_order", "SELECT stop_id, CAST(row_number() OVER (ORDER BY concat(stop_name, ' (', stop_id, ')')) AS INT) AS place FROM g_stops")
def _(spark, g):
    labelled = g.stops.select("stop_id", C.stop_label(F.col("stop_name"), F.col("stop_id")).alias("label"))
    return labelled.join(feed.dense_ids(labelled, "label", "place"), "label").select("stop_id", "place")


@query("h2_chunked_cover", "SELECT o, d, dep, arr, trip_id FROM free2", ("free02", "SELECT *, min(arr) OVER (PARTITION BY o, d ORDER BY dep, arr DESC, trip_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM steps"), ("free2", "SELECT * FROM free02 WHERE later IS NULL OR arr < later"))
def _(spark, g):
    rides = steps_of(g)
    chunked = steps.minimal_cover(rides.withColumn("chunk", F.floor(F.col("dep") / 21600)), ("o", "d", "chunk")).drop("chunk")
    return steps.minimal_cover(chunked).drop("is_flex")


@query("h3_pairs_of_both", "SELECT o, d FROM steps WHERE dep % 5 = 0 UNION SELECT o, d FROM steps WHERE dep % 7 = 0")
def _(spark, g):
    s = steps_of(g)
    return s.filter("dep % 5 = 0").select("o", "d").union(s.filter("dep % 7 = 0").select("o", "d")).distinct()


# --- checks and iteration


@query("m1_planted_violations", "SELECT o, d, dep, arr, trip_id FROM (SELECT *, lag(dep) OVER w AS pd, lag(arr) OVER w AS pa FROM steps WINDOW w AS (PARTITION BY o, d ORDER BY dep, arr DESC, trip_id)) LEFT JOIN (SELECT o, d, seconds FROM walks) USING (o, d) WHERE dep <= pd OR arr <= pa OR arr - dep >= seconds")
def _(spark, g):
    rides, walks = network_of(g)
    return steps.out_of_order(rides.unionByName(walks)).select("o", "d", "dep", "arr", "trip_id")


@query("m5_planted_chains", "SELECT stop_id, parent_station AS rep FROM g_stops WHERE parent_station IN (SELECT stop_id FROM g_stops WHERE parent_station IS NOT NULL)")
def _(spark, g):
    return required.deep_representatives(g.stops.select("stop_id", F.coalesce("parent_station", "stop_id").alias("rep"))).select("stop_id", "rep")


@query("m6_unrepresentable", "SELECT o, d, trip_id, dep * 60 AS dep FROM steps WHERE dep * 60 // 120 > 32767")
def _(spark, g):
    return steps.unrepresentable(steps_of(g).withColumn("dep", F.col("dep") * 60)).select("o", "d", "trip_id", "dep")


@query("m7_groups_off_network", "SELECT DISTINCT rep FROM sgrp WHERE rep NOT IN (SELECT g.rep FROM sgrp g JOIN day_st s USING (stop_id) WHERE arrival < 450)", _SUPPLIED)
def _(spark, g):
    served = day_of(g).stop_times.filter("arrival < 450").select(F.col("stop_id").alias("o"), F.col("stop_id").alias("d"))
    return required.groups_missing(supplied_groups(spark), served)


_COMPOSED = ("comp", "SELECT s_suppkey AS k, concat('C', CAST(s_suppkey AS STRING)) AS stop, concat('N', CAST(s_nationkey AS STRING)) AS a, CASE WHEN s_suppkey >= 2 THEN concat('C', CAST(s_suppkey // 2 AS STRING)) ELSE 'END' END AS b FROM supplier WHERE s_suppkey >= 1")


@query("i23_expanded", "SELECT stop, CAST(place AS INT) AS place, part FROM (SELECT stop, 2 * depth - 1 AS place0, depth AS place, a AS part FROM chain UNION ALL SELECT stop, 0, max(depth) + 1, 'END' FROM chain GROUP BY stop)", _COMPOSED, ("chain", "SELECT stop, k, 1 AS depth, a FROM comp UNION ALL SELECT c.stop, p.k, depth + 1, p.a FROM chain c JOIN comp p ON p.k = c.k // 2 WHERE c.k >= 2"))
def _(spark, g):
    s = spark.table("supplier").filter("s_suppkey >= 1")
    half = F.floor(F.col("s_suppkey") / 2).cast("string")
    return paths.expanded(s.select(F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("stop"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("a"), F.when(F.col("s_suppkey") >= 2, F.concat(F.lit("C"), half)).otherwise("END").alias("b")))


_TREE = (
    _REACH,
    ("lohi", "SELECT least(o, d) AS lo, greatest(o, d) AS hi, min(w) AS w FROM edges GROUP BY 1, 2"),
    ("ranked", "SELECT *, row_number() OVER (ORDER BY w, lo, hi) AS r FROM lohi"),
    ("conn", "SELECT r, lo AS node FROM ranked UNION SELECT c.r, CASE WHEN e.lo = c.node THEN e.hi ELSE e.lo END FROM conn c JOIN ranked e ON e.r < c.r AND (e.lo = c.node OR e.hi = c.node)"),
    ("tree", "SELECT * FROM ranked t WHERE NOT EXISTS (SELECT 1 FROM conn c WHERE c.r = t.r AND c.node = t.hi)"),
)


@query("i9_spanning_tree", "SELECT lo, hi, CAST(w AS INT) AS w FROM tree", *_TREE)
def _(spark, g):
    return graph.spanning_tree(graph.undirected_edges(edges_of(g)))


ORACLE_SQL["i9_tree_leaves"] = sql("SELECT stop_id FROM (SELECT lo AS stop_id FROM tree UNION ALL SELECT hi FROM tree) GROUP BY stop_id HAVING count(*) = 1", *_TREE)


@query("i10_order_components", "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1")
def _(spark, g):
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    links = spark.table("orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(by).alias("b"))
    return graph.connected_components(links, "a", "b")


# --- specs, dates and comparisons


@query("n2_prepared_networks", "SELECT n_nationkey AS spec_id, date, count(*) AS trips FROM nation JOIN (SELECT date, service_id FROM (SELECT strftime(DATE '2025-07-10' + CAST(i AS INTEGER), '%Y%m%d') AS date, dayofweek(DATE '2025-07-10' + CAST(i AS INTEGER)) AS dow FROM range(7) r(i)) JOIN g_calendar ON date BETWEEN start_date AND end_date AND CASE dow WHEN 0 THEN sunday WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday ELSE saturday END) ON true JOIN g_trips t USING (service_id) WHERE t.trip_id LIKE CASE n_nationkey % 3 WHEN 0 THEN 'BA:%' WHEN 1 THEN 'CT:%' ELSE 'SC:%' END GROUP BY ALL")
def _(spark, g):
    specs = spark.table("nation").select(F.col("n_nationkey").alias("spec_id"), F.element_at(F.array(F.lit("BA"), F.lit("CT"), F.lit("SC")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("prefix"))
    active = services.active_on(g.calendar, services.date_range(spark, "20250710", 7))
    return catalog.prepared(specs, active, g.trips)


_INST = (
    ("n4", "SELECT o_orderkey AS id, CAST(o_custkey % 6 AS INT) AS spec_id, strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS day, o_orderkey % 7 = 0 AS dup, CAST(round(o_totalprice) AS BIGINT) AS duration FROM orders"),
    ("n4first", "SELECT spec_id, min(day) AS first_day FROM n4 WHERE NOT dup GROUP BY spec_id"),
    ("n4src", "SELECT n.spec_id, day, min(duration) AS duration FROM n4 n JOIN n4first f ON f.spec_id = n.spec_id AND f.first_day = n.day WHERE NOT dup GROUP BY n.spec_id, day"),
    ("n4all", "SELECT n.id, n.spec_id, n.day, dup, CASE WHEN dup THEN s.duration ELSE n.duration END AS duration FROM n4 n LEFT JOIN n4src s ON s.spec_id = n.spec_id"),
)


def _copied(spark) -> DataFrame:
    """Orders as instances; every seventh repeats the first day of its spec that isn't such a one itself."""
    o = spark.table("orders")
    rows = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 6).cast("int").alias("spec_id"), F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd").alias("day"), (F.col("o_orderkey") % 7 == 0).alias("dup"), F.round("o_totalprice").cast("long").alias("duration"))
    first = rows.filter("not dup").groupBy("spec_id").agg(F.min("day").alias("first_day"))
    source = rows.filter("not dup").join(F.broadcast(first), ["spec_id"]).filter("day = first_day").groupBy("spec_id", "day").agg(F.min("duration").alias("duration"))
    return catalog.copied_from(rows, source)


@query("n4_copied_instances", "SELECT id, spec_id, day, duration FROM n4all", *_INST)
def _(spark, g):
    return _copied(spark).select("id", "spec_id", "day", "duration")


@query("n6_result_grid", "SELECT day AS service_date, " + ", ".join(f'min(CASE WHEN spec_id = {i} THEN duration END) AS "{i}"' for i in range(6)) + " FROM n4all WHERE NOT dup GROUP BY day", *_INST)
def _(spark, g):
    rows = _copied(spark).select("spec_id", F.col("day").alias("service_date"), F.when(F.col("dup"), "duplicate").otherwise("solved").alias("status"), "duration")
    return catalog.grid(rows, list(range(6)))


@query(
    "n7_sync_cascade",
    "SELECT id, action, (SELECT count(*) FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = acts.id AND acts.action IN ('deleted', 'updated')) AS instances FROM acts",
    ("want", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 0 THEN 'x' ELSE n_name END AS title FROM nation WHERE n_nationkey % 11 <> 0"),
    ("have", "SELECT n_nationkey AS id, n_name AS title FROM nation WHERE n_nationkey % 9 <> 0"),
    ("acts", "SELECT coalesce(w.id, h.id) AS id, CASE WHEN h.id IS NULL THEN 'inserted' WHEN w.id IS NULL THEN 'deleted' WHEN w.title IS DISTINCT FROM h.title THEN 'updated' ELSE 'unchanged' END AS action FROM want w FULL JOIN have h ON h.id = w.id"),
)
def _(spark, g):
    n = spark.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    wanted = n.filter("id % 11 <> 0").withColumn("title", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("title")))
    actions = catalog.sync_actions(wanted, n.filter("id % 9 <> 0"), "id")
    owned = spark.table("orders").join(spark.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("id"))
    return catalog.with_cascade(actions, owned, "id").select("id", "action", "instances")


@query("n9_reachable_stations", "SELECT DISTINCT o, stop FROM (SELECT p.o, l.d AS stop FROM tleg l JOIN tpath p USING (path_id)) WHERE o <> stop", *_T)
def _(spark, g):
    return trip_paths(g).select("o", F.explode(F.transform("legs", lambda x: x["d"])).alias("stop")).filter("o <> stop").distinct()


@query("n10_first_difference", "SELECT o, d, min(dep) AS dep FROM (SELECT coalesce(a.o, b.o) AS o, coalesce(a.d, b.d) AS d, coalesce(a.dep, b.dep) AS dep FROM (SELECT o, d, dep, arr, count(*) AS n FROM steps WHERE dep % 5 <> 0 OR o <> 'N1' GROUP BY ALL) a FULL JOIN (SELECT o, d, dep, arr, count(*) AS n FROM steps WHERE dep % 7 <> 0 OR o <> 'N2' GROUP BY ALL) b ON a.o = b.o AND a.d = b.d AND a.dep = b.dep AND a.arr = b.arr WHERE a.n IS DISTINCT FROM b.n) GROUP BY o, d")
def _(spark, g):
    s = steps_of(g)
    return catalog.first_differences(s.filter("dep % 5 <> 0 or o <> 'N1'"), s.filter("dep % 7 <> 0 or o <> 'N2'"))
