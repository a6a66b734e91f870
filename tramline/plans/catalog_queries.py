"""Queries over services, legs, tours and the catalogue, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import catalog, graph, legs, profiles, services, tours
from tramline.plans import demo
from tramline.plans.demo import sql
from tramline.plans.timetable_queries import ba_steps, edges_of, required_of, steps_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None, *more: tuple[str, str]):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, demo.feed(spark, sf_dir))
        if text:
            ORACLE_SQL[name] = sql(text, *more)
        return f

    return add


# --- services

_ON = (
    ("sdates", "SELECT strftime(DATE '2025-06-28' + CAST(i AS INTEGER), '%Y%m%d') AS date, dayofweek(DATE '2025-06-28' + CAST(i AS INTEGER)) AS dow FROM range(40) r(i)"),
    ("son", "SELECT date, service_id FROM sdates JOIN g_calendar ON date BETWEEN start_date AND end_date AND CASE dow WHEN 0 THEN sunday WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday ELSE saturday END"),
    ("sday", "SELECT d.date, coalesce(string_agg(service_id, ',' ORDER BY service_id), '') AS services FROM sdates d LEFT JOIN son USING (date) GROUP BY d.date"),
    ("span", "SELECT a.date, concat(a.services, '|', b.services) AS pattern FROM sday a JOIN sday b ON b.date = strftime(strptime(a.date, '%Y%m%d') + INTERVAL 1 DAY, '%Y%m%d') WHERE a.date < '20250806'"),
)


def _patterns(spark, g):
    active = services.active_on(g.calendar, services.date_range(spark, "20250628", 40))
    return services.patterns(services.day_services(active, services.date_range(spark, "20250628", 39), 1))


@query("e6_services", "SELECT date, services FROM sday", *_ON)
def _(spark, g):
    dates = services.date_range(spark, "20250628", 40)
    return services.day_services(services.active_on(g.calendar, dates), dates, 0).select("date", F.array_join("services", ",").alias("services"))


@query("h6_patterns", "SELECT date, pattern FROM span", *_ON)
def _(spark, g):
    return _patterns(spark, g).select("date", services.pattern_text(F.col("pattern")).alias("pattern"))


@query("f14_duplicate_dates", "SELECT date, CASE WHEN min(date) OVER (PARTITION BY pattern) < date THEN min(date) OVER (PARTITION BY pattern) END AS duplicate_of FROM span", *_ON)
def _(spark, g):
    return services.duplicates(_patterns(spark, g)).select("date", "duplicate_of")


@query("n3_mark_duplicates", "SELECT date, CASE WHEN min(date) OVER (PARTITION BY pattern) < date THEN 'duplicate' ELSE 'solve' END AS action FROM span", *_ON)
def _(spark, g):
    return services.duplicates(_patterns(spark, g)).select("date", F.when(F.col("duplicate_of").isNull(), "solve").otherwise("duplicate").alias("action"))


@query("a17_pattern_documents", "SELECT date, pattern FROM span", *_ON)
def _(spark, g):
    return services.from_json(services.to_json(_patterns(spark, g))).select("date", services.pattern_text(F.col("pattern")).alias("pattern"))


@query("d2_step_services", "SELECT s.trip_id, s.dep, t.service_id FROM steps s JOIN g_trips t USING (trip_id)")
def _(spark, g):
    return steps_of(g).join(g.trips.select("trip_id", "service_id"), "trip_id").select("trip_id", "dep", "service_id")


# --- legs: the departures of a stop in order, their routes as trips

_LEGS = (
    ("legs0", "SELECT s.o AS path_id, s.o, s.d, s.dep, s.arr, t.route_id AS trip_id, s.trip_id AS run FROM steps s JOIN g_trips t USING (trip_id)"),
    ("legs", "SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY dep, run, arr) AS pos FROM legs0"),
    ("chg", "SELECT *, CASE WHEN lag(trip_id) OVER (PARTITION BY path_id ORDER BY pos) IS NOT DISTINCT FROM trip_id THEN 0 ELSE 1 END AS c FROM legs"),
    ("isl", "SELECT *, CAST(sum(c) OVER (PARTITION BY path_id ORDER BY pos) - 1 AS INT) AS island FROM chg"),
)


def legs_of(g):
    from pyspark.sql import Window

    rows = steps_of(g).join(g.trips.select("trip_id", "route_id"), "trip_id")
    pos = F.row_number().over(Window.partitionBy("o").orderBy("dep", "trip_id", "arr"))
    return rows.select(F.col("o").alias("path_id"), pos.alias("pos"), "o", "d", "dep", "arr", F.col("route_id").alias("trip_id"), "is_flex")


@query("f4_collapse", "SELECT path_id, island, trip_id, min_by(d, pos) AS first_d, max_by(d, pos) AS d, min_by(dep, pos) AS dep, max_by(arr, pos) AS arr, count(*) AS legs FROM isl GROUP BY path_id, island, trip_id", *_LEGS)
def _(spark, g):
    rows = legs_of(g)
    first = legs.islands(rows).groupBy("path_id", "island").agg(F.min_by("d", "pos").alias("first_d"))
    return legs.collapsed(rows).join(first, ["path_id", "island"]).select("path_id", "island", "trip_id", "first_d", "d", "dep", "arr", "legs")


@query("f9_leg_ranges", "SELECT path_id, island, CAST(min(pos) AS INT) AS first_leg, CAST(max(pos) AS INT) AS last_leg FROM isl GROUP BY path_id, island", *_LEGS)
def _(spark, g):
    return legs.collapsed(legs_of(g)).select("path_id", "island", "first_leg", "last_leg")


@query("n8_path_summaries", "SELECT path_id, min_by(dep, pos) AS dep, max_by(arr, pos) AS arr, count(*) AS legs, CAST(max_by(arr, pos) - min_by(dep, pos) AS INT) AS total FROM legs GROUP BY path_id", *_LEGS)
def _(spark, g):
    return legs.summaries(legs_of(g)).select("path_id", "dep", "arr", "legs", "total")


@query("m10_broken_legs", "SELECT path_id, CAST(pos AS INT) AS pos FROM (SELECT path_id, pos, o <> lag(d) OVER w OR arr < lag(arr) OVER w AS bad FROM legs WINDOW w AS (PARTITION BY path_id ORDER BY pos)) WHERE bad", *_LEGS)
def _(spark, g):
    return legs.broken(legs_of(g)).select("path_id", "pos")


@query("f5_walks_in_sequence")
def _(spark, g):
    paths = profiles.reduced(ba_steps(g), required_of(spark)).withColumn("path_id", F.concat_ws(":", "o", "d", F.col("dep").cast("string")))
    return legs.walks_in_sequence(legs.exploded(paths)).select("path_id", "pos", "o", "d", "dep", "arr", "is_flex")


@query("f6_walks_at_last_moment")
def _(spark, g):
    paths = profiles.reduced(ba_steps(g), required_of(spark)).withColumn("path_id", F.concat_ws(":", "o", "d", F.col("dep").cast("string")))
    return legs.walks_at_last_moment(legs.exploded(paths)).select("path_id", "pos", "o", "d", "dep", "arr", "is_flex")


# --- tours


def _paths(spark, g):
    return profiles.reduced(ba_steps(g), required_of(spark), complete=True)


def _tours(spark):
    return tours.orders(spark, ["N4", "N11", "N17"], "N0", "N23")


@query("i13_tour_eval")
def _(spark, g):
    return tours.evaluated(_tours(spark), _paths(spark, g))


@query("g3_best_ties")
def _(spark, g):
    return tours.best(tours.evaluated(_tours(spark), _paths(spark, g)))


@query("i15_tour_beginnings")
def _(spark, g):
    return tours.evaluated(_tours(spark), _paths(spark, g), every_prefix=True)


@query("i16_best_insertions")
def _(spark, g):
    base = spark.createDataFrame([("t", ["N0", "N17", "N23"])], "tour_id string, stops array<string>")
    new = required_of(spark).filter("stop_id in ('N4', 'N11')")
    return tours.best_insertions(base, new, _paths(spark, g)).select("base", "stop", "place", "duration")


@query("i18_shortest_tour")
def _(spark, g):
    return tours.shortest_tour(["N0", "N4", "N11", "N17"], _paths(spark, g)).select("tour_id", "dep", "arr", "duration")


@query("i12_fewer_edges")
def _(spark, g):
    return profiles.fewer_edges(profiles.reduced(ba_steps(g), required_of(spark))).select("o", "d", "dep", "arr", "is_flex")


@query("i24_required_edge")
def _(spark, g):
    return graph.required_edge(ba_steps(g), "N1", "N2").select("o", "d", "dep", "arr", "is_flex")


@query("c20_without_group", "SELECT concat('N', CAST(n_nationkey AS STRING)) AS stop_id, concat('N', CAST(n_regionkey AS STRING)) AS rep FROM nation WHERE n_regionkey <> (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)")
def _(spark, g):
    groups = spark.table("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("stop_id"), F.concat(F.lit("N"), F.col("n_regionkey").cast("string")).alias("rep"))
    return graph.without_group(groups, "N7")


# --- catalogue: orders as instances, regions as sources, nations as target sets

_INST = (
    ("inst", "SELECT o_orderkey AS instance_id, CAST(o_custkey % 6 AS INT) AS spec_id, strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS service_date, CASE WHEN o_orderkey % 7 = 0 THEN 'duplicate' WHEN o_orderstatus = 'F' THEN 'solved' ELSE 'timeout' END AS status, CAST(round(o_totalprice) AS BIGINT) AS duration FROM orders"),
)


def instances(spark):
    o = spark.table("orders")
    status = F.when(F.col("o_orderkey") % 7 == 0, "duplicate").when(F.col("o_orderstatus") == "F", "solved").otherwise("timeout")
    return o.select(F.col("o_orderkey").alias("instance_id"), (F.col("o_custkey") % 6).cast("int").alias("spec_id"), F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd").alias("service_date"), status.alias("status"), F.round("o_totalprice").cast("long").alias("duration"))


@query("c15_hide_duplicates", "SELECT instance_id, spec_id, service_date, status, duration FROM inst WHERE status <> 'duplicate'", *_INST)
def _(spark, g):
    return instances(spark).filter("status <> 'duplicate'")


_CELLS = ", ".join(f'min(CASE WHEN spec_id = {i} THEN duration END) AS "{i}"' for i in range(6))


@query("g8_grid", f"SELECT service_date, {_CELLS} FROM inst WHERE status <> 'duplicate' GROUP BY service_date", *_INST)
def _(spark, g):
    return catalog.grid(instances(spark), list(range(6)))


@query("n5_outcomes", "SELECT o_orderkey AS instance_id, CASE WHEN o_orderkey % 7 = 0 THEN 'duplicate' WHEN o_orderkey % 5 = 0 THEN 'timeout' WHEN o_orderkey % 5 = 1 THEN 'failed' WHEN o_totalprice < 100000 THEN 'infeasible' ELSE 'solved' END AS status FROM orders")
def _(spark, g):
    k = F.col("o_orderkey")
    code = F.when(k % 5 == 0, 124).when(k % 5 == 1, 1).otherwise(0)
    return spark.table("orders").select(k.alias("instance_id"), catalog.outcome(code, F.when(k % 7 == 0, "x"), F.when(F.col("o_totalprice") >= 100000, 1)).alias("status"))


@query("n1_spec_dates", "SELECT CAST(n_nationkey AS INT) AS spec_id, strftime(CASE WHEN n_nationkey % 3 = 0 THEN DATE '2025-07-18' ELSE DATE '2025-12-30' END + CAST(i AS INTEGER), '%Y%m%d') AS service_date FROM nation, range(4) r(i)")
def _(spark, g):
    specs = spark.table("nation").select(F.col("n_nationkey").cast("int").alias("spec_id"), F.when(F.col("n_nationkey") % 3 == 0, "20250718").alias("start_service_date"))
    return catalog.spec_dates(specs, "20251230", 4)


@query("d9_listing", "SELECT instance_id, service_date, n_name AS title, r_name AS source FROM inst JOIN nation ON n_nationkey = spec_id JOIN region ON r_regionkey = n_regionkey", *_INST)
def _(spark, g):
    specs = spark.table("nation").select(F.col("n_nationkey").cast("int").alias("spec_id"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("target_id"))
    targets = spark.table("region").select(F.col("r_regionkey").alias("target_id"), F.col("r_name").alias("source"))
    return catalog.listing(instances(spark), specs, targets).select("instance_id", "service_date", "title", "source")


@query("d10_targets_with_results", "SELECT DISTINCT n_name AS title FROM nation JOIN inst ON spec_id = n_nationkey", *_INST)
def _(spark, g):
    n = spark.table("nation")
    return n.join(instances(spark), n["n_nationkey"] == F.col("spec_id"), "left_semi").select(F.col("n_name").alias("title"))


@query("d11_runs_of_targets", "SELECT DISTINCT n_regionkey, service_date FROM nation JOIN inst ON spec_id = n_nationkey", *_INST)
def _(spark, g):
    n = spark.table("nation")
    return instances(spark).join(n, n["n_nationkey"] == F.col("spec_id")).select("n_regionkey", "service_date").distinct().orderBy(F.desc("service_date"))


_RUNS = (("runs", "SELECT CAST(o_custkey % 20 AS INT) AS source_id, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS fetched_at FROM orders"),)


def runs(spark):
    return spark.table("orders").select((F.col("o_custkey") % 20).cast("int").alias("source_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("fetched_at"))


@query("f12_newest_runs", "SELECT source_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, run_id DESC) AS r FROM runs) WHERE r <= 5", *_RUNS)
def _(spark, g):
    return catalog.newest_runs(runs(spark)).select("source_id", "run_id")


@query("f13_neighbour_runs", "SELECT source_id, run_id, lag(run_id) OVER w AS older, lead(run_id) OVER w AS newer, last_value(run_id) OVER (PARTITION BY source_id ORDER BY fetched_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest FROM runs WINDOW w AS (PARTITION BY source_id ORDER BY fetched_at, run_id)", *_RUNS)
def _(spark, g):
    return catalog.neighbours(runs(spark)).select("source_id", "run_id", "older", "newer", "newest")


@query("g7_landing_cell", "SELECT instance_id FROM (SELECT *, CASE WHEN service_date = (SELECT max(service_date) FROM inst) AND spec_id = 3 THEN 0 WHEN service_date = (SELECT max(service_date) FROM inst) THEN 1 ELSE 2 END AS p FROM inst) ORDER BY p, service_date, spec_id, instance_id LIMIT 1", *_INST)
def _(spark, g):
    rows = instances(spark)
    newest = rows.agg(F.max("service_date")).first()[0]
    found = catalog.landing_cell(rows.groupBy("spec_id", "service_date").agg(F.min("instance_id").alias("instance_id")), 3, newest)
    return found.select("instance_id")


_SYNC = (
    ("want", "SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS balance FROM supplier WHERE s_suppkey % 11 <> 0"),
    ("have", "SELECT s_suppkey AS id, s_name AS title, s_acctbal AS balance FROM supplier WHERE s_suppkey % 13 <> 0"),
    ("acts", "SELECT coalesce(w.id, h.id) AS id, CASE WHEN h.id IS NULL THEN 'inserted' WHEN w.id IS NULL THEN 'deleted' WHEN w.balance IS DISTINCT FROM h.balance THEN 'updated' ELSE 'unchanged' END AS action FROM want w FULL JOIN have h ON h.id = w.id"),
)


def _actions(spark):
    s = spark.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("balance"))
    wanted = s.filter("id % 11 <> 0").withColumn("balance", F.when(F.col("id") % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance")))
    return catalog.sync_actions(wanted, s.filter("id % 13 <> 0"), "id")


@query("d14_sync_actions", "SELECT id, action, CASE WHEN action = 'updated' THEN 'balance' ELSE '' END AS changed FROM acts", *_SYNC)
def _(spark, g):
    return _actions(spark)


@query("e15_action_counts", "SELECT action, count(*) AS n FROM acts GROUP BY action", *_SYNC)
def _(spark, g):
    return catalog.action_counts(_actions(spark))


@query("d15_dangling_specs", "SELECT c_custkey AS spec_id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(spark, g):
    specs = spark.table("customer").select(F.col("c_custkey").alias("spec_id"), F.col("c_nationkey").alias("target_id"))
    return catalog.dangling(specs, spark.table("nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("target_id"))).select("spec_id")


_DIFF = (
    ("pa", "SELECT o, d, dep, arr, count(*) AS na FROM steps WHERE dep % 5 <> 0 OR o <> 'N1' GROUP BY ALL"),
    ("pb", "SELECT o, d, dep, arr, count(*) AS nb FROM steps WHERE dep % 7 <> 0 OR o <> 'N2' GROUP BY ALL"),
    ("pd", "SELECT coalesce(pa.o, pb.o) AS o, coalesce(pa.d, pb.d) AS d, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM pa FULL JOIN pb ON pa.o = pb.o AND pa.d = pb.d AND pa.dep = pb.dep AND pa.arr = pb.arr"),
    ("pp", "SELECT o, d, sum(na) AS ta, sum(nb) AS tb, CAST(sum(greatest(na - nb, 0)) AS BIGINT) AS only_a, CAST(sum(greatest(nb - na, 0)) AS BIGINT) AS only_b FROM pd GROUP BY o, d"),
    ("pdiff", "SELECT o, d, CASE WHEN tb = 0 THEN 'only in a' WHEN ta = 0 THEN 'only in b' WHEN only_a = 0 AND only_b = 0 THEN 'match' ELSE 'mismatch' END AS status, only_a, only_b FROM pp"),
)


def _differences(g):
    s = steps_of(g)
    return catalog.path_differences(s.filter("dep % 5 <> 0 or o <> 'N1'"), s.filter("dep % 7 <> 0 or o <> 'N2'"))


@query("d13_path_diff", "SELECT * FROM pdiff", *_DIFF)
def _(spark, g):
    return _differences(g)


@query("e26_diff_totals", "SELECT status, count(*) AS pairs, CAST(sum(only_a) AS BIGINT) AS only_a, CAST(sum(only_b) AS BIGINT) AS only_b FROM pdiff GROUP BY status", *_DIFF)
def _(spark, g):
    return _differences(g).groupBy("status").agg(F.count("*").alias("pairs"), F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))


@query("h5_multiset_diff", "SELECT o, d, dep, arr FROM (SELECT o, d, dep, arr FROM steps WHERE dep % 5 <> 0 OR o <> 'N1') EXCEPT ALL (SELECT o, d, dep, arr FROM steps WHERE dep % 7 <> 0 OR o <> 'N2')")
def _(spark, g):
    s = steps_of(g).select("o", "d", "dep", "arr")
    return s.filter("dep % 5 <> 0 or o <> 'N1'").exceptAll(s.filter("dep % 7 <> 0 or o <> 'N2'"))


@query("e27_copied_results", "SELECT i.instance_id, coalesce(i.duration, j.duration) AS duration FROM (SELECT instance_id, CASE WHEN instance_id % 3 = 0 THEN NULL ELSE duration END AS duration, CASE WHEN instance_id % 3 = 0 THEN instance_id - 1 END AS twin FROM inst) i LEFT JOIN (SELECT instance_id, CASE WHEN instance_id % 3 = 0 THEN NULL ELSE duration END AS duration FROM inst) j ON j.instance_id = i.twin", *_INST)
def _(spark, g):
    rows = instances(spark)
    third = F.col("instance_id") % 3 == 0
    keyed = rows.select(F.lit(0).alias("spec_id"), F.col("instance_id").alias("service_date"), F.when(third, F.col("instance_id") - 1).alias("duplicate_of"), F.when(~third, F.col("duration")).alias("duration"))
    return catalog.with_copied_results(keyed).select(F.col("service_date").alias("instance_id"), "duration")


_SPANS = (("spans", "SELECT user_id AS run_id, event_id AS span_id, CAST(epoch(CAST(ts AS TIMESTAMP)) AS DOUBLE) AS start, CAST(value AS DOUBLE) AS duration FROM events"),)


def _spans(spark):
    return spark.table("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("span_id"), F.floor(F.col("ts").cast("timestamp").cast("double")).cast("double").alias("start"), F.col("value").cast("double").alias("duration"))


@query("e14_last_iterations", "SELECT user_id AS run_id, max(event_id) AS iteration FROM events GROUP BY user_id")
def _(spark, g):
    return spark.table("events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("event_id").alias("iteration"))


@query("b27_composite_ids", "SELECT concat(CAST(o_custkey % 6 AS STRING), '-', strftime(CAST(o_orderdate AS DATE), '%Y%m%d'), '-', CAST(o_orderkey AS STRING)) AS id FROM orders")
def _(spark, g):
    from tramline.functions.columns import composite_id

    i = instances(spark)
    return i.select(composite_id(F.col("spec_id").cast("string"), F.col("service_date"), F.col("instance_id").cast("string")).alias("id"))


@query("i11_split")
def _(spark, g):
    return profiles.split_at(profiles.reduced(ba_steps(g), required_of(spark)), "N12").select("o", "d", "dep", "arr", "is_flex", F.size("legs").alias("legs"))


@query("c17_pair_paths", "SELECT o, d, dep, arr, trip_id FROM steps WHERE (o = 'N1' AND d = 'N2') OR (o = 'N2' AND d = 'N1')")
def _(spark, g):
    return steps_of(g).filter("(o = 'N1' and d = 'N2') or (o = 'N2' and d = 'N1')").drop("is_flex")


@query("e25_weighted_edges", "SELECT o, d, CAST(w AS INT) AS w, CAST(row_number() OVER (PARTITION BY o ORDER BY w, d) AS INT) AS place FROM edges", ("edges", "SELECT o, d, min(arr - dep) AS w FROM steps WHERE o <> d GROUP BY o, d"))
def _(spark, g):
    from pyspark.sql import Window

    return edges_of(g).withColumn("place", F.row_number().over(Window.partitionBy("o").orderBy("w", "d")))


