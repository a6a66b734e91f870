"""Queries over required stops, checks, explorer tables and arrays, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import catalog, feed, profiles, required, tours
from tramline.plans import demo
from tramline.plans.demo import sql
from tramline.plans.timetable_queries import day_of, steps_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str, *more: tuple[str, str]):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, demo.feed(spark, sf_dir))
        ORACLE_SQL[name] = sql(text, *more)
        return f

    return add


_GROUPS = ("grp", "SELECT concat('N', CAST(n_nationkey AS STRING)) AS stop_id, concat('G', CAST(n_regionkey AS STRING)) AS rep FROM nation")


def groups(spark):
    return spark.table("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("stop_id"), F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("rep"))


_COMPLEX = ("cpx", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS stop_id, concat('G', CAST(s_suppkey // 4 AS STRING)) AS rep FROM supplier")


def complexes(spark):
    """Station complexes of four suppliers each, so that their number grows with the tables."""
    s = spark.table("supplier")
    return s.select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("stop_id"), F.concat(F.lit("G"), F.floor(F.col("s_suppkey") / 4).cast("string")).alias("rep"))


@query("i25_groups", "SELECT rep, string_agg(stop_id, ',' ORDER BY stop_id) AS stop_ids, count(*) AS n FROM cpx GROUP BY rep", _COMPLEX)
def _(spark, g):
    return required.members(complexes(spark))


@query("d18_group_pairs", "SELECT x.rep, x.stop_id AS a, y.stop_id AS b FROM cpx x JOIN cpx y ON x.rep = y.rep AND x.stop_id < y.stop_id", _COMPLEX)
def _(spark, g):
    return required.member_pairs(complexes(spark))


@query(
    "m4_config_errors",
    "SELECT stop_id, 'unknown stop' AS problem FROM req WHERE stop_id NOT IN (SELECT stop_id FROM g_stops) UNION ALL SELECT stop_id, 'listed twice' FROM req GROUP BY stop_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT stop_id, 'grouped but not required' FROM cfg WHERE stop_id NOT IN (SELECT stop_id FROM req) UNION ALL SELECT stop_id, 'in several groups' FROM cfg GROUP BY stop_id HAVING count(DISTINCT group_id) > 1",
    ("req", "SELECT concat('P', CAST(s_nationkey * 8 AS STRING)) AS stop_id FROM supplier"),
    ("cfg", "SELECT s_nationkey AS group_id, concat('P', CAST(s_suppkey % 20 AS STRING)) AS stop_id FROM supplier"),
)
def _(spark, g):
    s = spark.table("supplier")
    listed = s.select(F.concat(F.lit("P"), (F.col("s_nationkey") * 8).cast("string")).alias("stop_id"))
    grouped = s.select(F.col("s_nationkey").alias("group_id"), F.concat(F.lit("P"), (F.col("s_suppkey") % 20).cast("string")).alias("stop_id"))
    return required.config_errors(listed, grouped, g.stops)


@query("m5_deep_representatives", "SELECT stop_id, root_id AS rep FROM roots WHERE root_id NOT IN (SELECT stop_id FROM roots WHERE stop_id = root_id)")
def _(spark, g):
    return required.deep_representatives(feed.root_stops(g.stops).withColumnRenamed("root_id", "rep")).select("stop_id", "rep")


@query("i27_visited_groups", "SELECT stop_id, rep, max(visited) OVER (PARTITION BY rep) AS visited FROM (SELECT stop_id, rep, CASE WHEN CAST(substr(stop_id, 2) AS INT) % 9 = 2 THEN 1 ELSE 0 END AS visited FROM cpx)", _COMPLEX)
def _(spark, g):
    marked = complexes(spark).withColumn("visited", F.when(F.substring("stop_id", 2, 20).cast("int") % 9 == 2, 1).otherwise(0))
    return required.spread_over_groups(marked, "visited")


@query("m11_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, g):
    return required.repeated_keys(spark.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("a13_explorer_stops", "SELECT stop_id, stop_name, CASE WHEN stop_id IN ('N1', 'N7') THEN 'required' WHEN stop_id IN (SELECT stop_id FROM nst) THEN 'network' ELSE 'original' END AS kind FROM g_stops")
def _(spark, g):
    wanted = groups(spark).filter(F.col("stop_id").isin("N1", "N7"))
    return required.explorer_stops(g.stops, wanted, feed.normalized(day_of(g)).stop_times)


@query("a13_explorer_routes", "SELECT DISTINCT concat(t.route_id, ':', CAST(t.direction_id AS STRING)) AS id, concat(t.route_id, ' ', d.direction) AS name FROM day_trips t JOIN dirs d USING (route_id, direction_id)")
def _(spark, g):
    return required.explorer_routes(day_of(g).trips, g.routes, g.directions)


_TOURS = (_GROUPS, ("tst", "SELECT DISTINCT trip_id, stop_id FROM nst"))


def trip_tours(g):
    return feed.normalized(day_of(g)).stop_times.groupBy(F.col("trip_id").alias("tour_id")).agg(F.collect_set("stop_id").alias("stops"))


@query("e11_groups_visited", "SELECT trip_id AS tour_id, count(DISTINCT rep) AS groups FROM tst JOIN grp USING (stop_id) GROUP BY trip_id", *_TOURS)
def _(spark, g):
    return tours.groups_visited(trip_tours(g), groups(spark))


@query("h4_unvisited_groups", "SELECT t.trip_id AS tour_id, r.rep FROM (SELECT DISTINCT trip_id FROM tst) t CROSS JOIN (SELECT DISTINCT rep FROM grp) r WHERE NOT EXISTS (SELECT 1 FROM tst x JOIN grp y USING (stop_id) WHERE x.trip_id = t.trip_id AND y.rep = r.rep)", *_TOURS)
def _(spark, g):
    return tours.unvisited(trip_tours(g), groups(spark))


@query("g2_most_groups", "SELECT trip_id AS tour_id, count(DISTINCT rep) AS groups FROM tst JOIN grp USING (stop_id) GROUP BY trip_id ORDER BY groups DESC, tour_id LIMIT 1", *_TOURS)
def _(spark, g):
    return tours.groups_visited(trip_tours(g), groups(spark)).orderBy(F.desc("groups"), "tour_id").limit(1)


@query("h7_distinct_tours", "SELECT DISTINCT string_agg(stop_id, '>' ORDER BY stop_sequence) AS tour FROM nst GROUP BY trip_id")
def _(spark, g):
    ordered = feed.normalized(day_of(g)).stop_times.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("s"))
    return ordered.select(F.array_join(F.transform("s", lambda x: x["stop_id"]), ">").alias("tour")).dropDuplicates(["tour"])


@query("i26_work_chunks", "SELECT r_regionkey AS days, CAST(unnest(range(0, 86400 * r_regionkey + 14400, 21600)) AS INT) AS start FROM region")
def _(spark, g):
    r = spark.table("region").select(F.col("r_regionkey").alias("days"))
    one = lambda n: r.filter(F.col("days") == n).select("days", F.explode(profiles.chunks(profiles.horizon(n))).alias("start"))
    found = one(0)
    for n in range(1, 5):
        found = found.unionByName(one(n))
    return found


@query("e23_run_totals", "SELECT user_id AS run_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id")
def _(spark, g):
    return spark.table("events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("j2_shift", "SELECT event_id AS span_id, user_id AS run_id, event_id * 10 + user_id * 1000 AS start FROM events")
def _(spark, g):
    e = spark.table("events").select(F.col("event_id").alias("span_id"), F.col("user_id").alias("run_id"), (F.col("event_id") * 10).alias("start"))
    return catalog.shifted_spans(e, e.select("run_id").distinct().withColumn("parent_start", F.col("run_id") * 1000)).select("span_id", "run_id", "start")


@query("j7_sorted_arrays", "SELECT user_id AS run_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def _(spark, g):
    return spark.table("events").groupBy(F.col("user_id").alias("run_id")).agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("event_type"))), ",").alias("kinds"))


@query("j8_id_lists", "SELECT stop_id, unnest(string_split(stop_id || ',' || stop_name, ',')) AS id FROM g_stops")
def _(spark, g):
    return g.stops.select("stop_id", F.explode(F.split(F.concat_ws(",", "stop_id", "stop_name"), ",")).alias("id"))


@query("a23_network_summary", "SELECT CAST((SELECT count(*) FROM roots_at) AS BIGINT) AS stops, count(*) AS steps, count(DISTINCT o) AS origins, count(DISTINCT trip_id) AS trips FROM steps")
def _(spark, g):
    s = steps_of(g).agg(F.count("*").alias("steps"), F.countDistinct("o").alias("origins"), F.countDistinct("trip_id").alias("trips"))
    return feed.normalized(g).stops.agg(F.count("*").alias("stops")).crossJoin(s)  # one row each
