"""Queries over the derived timetable, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators import asof, feed, graph, profiles, steps
from tramline.operators.lineage import cut, small
from tramline.plans import demo
from tramline.plans.demo import DATE, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None, *more: tuple[str, str]):
    """Register a function (spark, feed) -> DataFrame as a query, with its DuckDB text."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, demo.feed(spark, sf_dir))
        if text:
            ORACLE_SQL[name] = sql(text, *more)
        return f

    return add


def day_of(g):
    return feed.on_date(g, DATE)


def steps_of(g) -> DataFrame:
    return steps.from_stop_times(feed.normalized(day_of(g)).stop_times)


def network_of(g) -> tuple[DataFrame, DataFrame]:
    """(rides, walks) of the day between root stops."""
    day = feed.normalized(day_of(g))
    return steps.from_stop_times(day.stop_times), steps.walking(day.stops)


def cover_of(g) -> DataFrame:
    rides, walks = network_of(g)
    return steps.minimal_cover(rides.unionByName(walks))


# --- scans


@query("a1_stops", "SELECT stop_id, stop_name, stop_lat, stop_lon, parent_station FROM g_stops")
def _(spark, g):
    return g.stops


@query("a2_trips", "SELECT route_id, direction_id, trip_id, service_id, trip_headsign FROM g_trips")
def _(spark, g):
    return g.trips


@query("a3_calendar", "SELECT * FROM g_calendar")
def _(spark, g):
    return g.calendar


@query("a4_stop_times", "SELECT trip_id, stop_id, stop_sequence, CAST(arrival AS INT) AS arrival, CAST(departure AS INT) AS departure FROM st")
def _(spark, g):
    return g.stop_times


@query("a5_routes", "SELECT * FROM g_routes")
def _(spark, g):
    return g.routes


@query("a22_route_directions", "SELECT r.route_id, route_short_name, coalesce((SELECT string_agg(direction, ', ' ORDER BY direction) FROM dirs d WHERE d.route_id = r.route_id), '') AS directions FROM g_routes r")
def _(spark, g):
    return feed.route_directions(g)


# --- scalar functions

_T = "SELECT trip_id, stop_sequence, departure AS s FROM st"


def _times(g):
    return g.stop_times.select("trip_id", "stop_sequence", F.col("departure").alias("s"))


@query("b1_parse_time", "SELECT trip_id, stop_sequence, CAST(arrival AS INT) AS arrival FROM st")
def _(spark, g):
    return g.stop_times.select("trip_id", "stop_sequence", "arrival")


@query("b2_format_time", "SELECT trip_id, stop_sequence, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS label FROM t", ("t", _T))
def _(spark, g):
    return _times(g).select("trip_id", "stop_sequence", C.format_time(F.col("s")).alias("label"))


@query("b3_signed_time", "SELECT trip_id, stop_sequence, concat(CASE WHEN s < 40000 THEN '-' ELSE '' END, printf('%02d:%02d:%02d', abs(s - 40000) // 3600, abs(s - 40000) // 60 % 60, abs(s - 40000) % 60)) AS label FROM t", ("t", _T))
def _(spark, g):
    return _times(g).select("trip_id", "stop_sequence", C.format_signed_time(F.col("s") - 40000).alias("label"))


@query(
    "b4_duration_labels",
    "SELECT trip_id, stop_sequence, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS long, CASE WHEN (s + 30) // 60 >= 60 THEN printf('%dh%dm', (s + 30) // 60 // 60, (s + 30) // 60 % 60) ELSE printf('%dm', (s + 30) // 60) END AS short, "
    "CASE WHEN s < 60 THEN printf('%d.0s', s) ELSE printf('%dm%ds', s // 60, s % 60) END AS elapsed, printf('%02d:%02d', s // 3600, s // 60 % 60) AS clock FROM t",
    ("t", _T),
)
def _(spark, g):
    s = F.col("s")
    return _times(g).select("trip_id", "stop_sequence", C.duration_label(s).alias("long"), C.short_duration(s).alias("short"), C.elapsed_label(s).alias("elapsed"), C.clock_label(s).alias("clock"))


_DATES = "SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS day FROM orders"


def _dates(spark):
    return spark.table("orders").select(F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd").alias("day")).distinct()


@query("b5_day_of_week", "SELECT day, CAST(dayofweek(strptime(day, '%Y%m%d')) AS INT) AS dow FROM dd", ("dd", _DATES))
def _(spark, g):
    return _dates(spark).select("day", C.day_of_week(F.col("day")).alias("dow"))


@query("b6_offset_date", "SELECT day, strftime(CAST(strptime(day, '%Y%m%d') AS DATE) + 40, '%Y%m%d') AS later, strftime(CAST(strptime(day, '%Y%m%d') AS DATE) - 1, '%Y%m%d') AS before FROM dd", ("dd", _DATES))
def _(spark, g):
    return _dates(spark).select("day", C.offset_date(F.col("day"), 40).alias("later"), C.offset_date(F.col("day"), -1).alias("before"))


@query("b7_weekday_label", "SELECT day, concat(strftime(strptime(day, '%Y%m%d'), '%a'), ' ', substr(day, 5, 2), '-', substr(day, 7, 2)) AS label FROM dd", ("dd", _DATES))
def _(spark, g):
    return _dates(spark).select("day", C.weekday_label(F.col("day")).alias("label"))


@query("b8_service_day", "SELECT concat(trip_id, ':sd-', CAST(direction_id + 1 AS STRING)) AS trip_id, CAST(direction_id + 1 AS INT) AS day FROM g_trips")
def _(spark, g):
    named = g.trips.select(C.with_service_day(F.col("trip_id"), F.col("direction_id") + 1).alias("trip_id"))
    return named.select("trip_id", C.service_day(F.col("trip_id")).alias("day"))


@query("b9_positions", "SELECT stop_id, CAST(round(stop_lon * 111000.0 * cos(radians(37.0)), 3) AS DOUBLE) AS x, CAST(round(stop_lat * 111000.0, 3) AS DOUBLE) AS y FROM g_stops")
def _(spark, g):
    return steps.positions(g.stops).select("stop_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("b11_trip_descriptions", "SELECT t.trip_id, CASE WHEN r.route_short_name IS NOT NULL AND d.direction IS NOT NULL THEN concat(r.route_short_name, ' ', d.direction) ELSE t.trip_id END AS description FROM day_trips t LEFT JOIN g_routes r USING (route_id) LEFT JOIN dirs d USING (route_id, direction_id)")
def _(spark, g):
    return feed.trip_descriptions(day_of(g).with_(directions=g.directions))


@query("b12_walk_descriptions", "SELECT o, d, concat('Walk from ', a.stop_name, ' to ', b.stop_name) AS label FROM walks JOIN g_stops a ON a.stop_id = o JOIN g_stops b ON b.stop_id = d")
def _(spark, g):
    walks = network_of(g)[1]
    name = lambda k: g.stops.select(F.col("stop_id").alias(k), F.col("stop_name").alias(f"{k}_name"))
    return walks.join(name("o"), "o").join(name("d"), "d").select("o", "d", C.walk_description(F.col("o_name"), F.col("d_name")).alias("label"))


@query("b13_step_durations", "SELECT o, d, trip_id, dep, CAST(arr - dep AS INT) AS w FROM steps")
def _(spark, g):
    return steps_of(g).select("o", "d", "trip_id", "dep", C.duration(F.col("dep"), F.col("arr")).alias("w"))


@query("b15_step_labels", "SELECT concat(o, ' -> ', d, ' ', printf('%02d:%02d:%02d', dep // 3600, dep // 60 % 60, dep % 60), '-', printf('%02d:%02d:%02d', arr // 3600, arr // 60 % 60, arr % 60), ' (', trip_id, ')') AS label FROM steps")
def _(spark, g):
    return steps_of(g).select(C.step_label(*[F.col(c) for c in steps.STEP]).alias("label"))


@query("b16_time_buckets", "SELECT o, d, trip_id, dep, CAST(dep // 120 AS SMALLINT) AS bucket FROM steps")
def _(spark, g):
    return steps_of(g).select("o", "d", "trip_id", "dep", C.time_bucket(F.col("dep")).alias("bucket"))


@query("b21_stop_labels", "SELECT s.trip_id, s.stop_sequence, CASE WHEN g.stop_name IS NOT NULL THEN concat(g.stop_name, ' (', s.stop_id, ')') ELSE s.stop_id END AS label FROM st s LEFT JOIN g_stops g USING (stop_id)")
def _(spark, g):
    return g.stop_times.join(g.stops.select("stop_id", "stop_name"), "stop_id", "left").select("trip_id", "stop_sequence", C.stop_label(F.col("stop_name"), F.col("stop_id")).alias("label"))


@query("b22_partition_labels", "SELECT n_nationkey AS part, coalesce(r.r_name, concat('unnamed(', CAST(n_nationkey AS STRING), ')')) AS label FROM nation LEFT JOIN region r ON r.r_regionkey = n_nationkey")
def _(spark, g):
    n, r = spark.table("nation"), spark.table("region")
    return n.join(small(r), r["r_regionkey"] == n["n_nationkey"], "left").select(F.col("n_nationkey").alias("part"), C.partition_label(F.col("r_name"), F.col("n_nationkey")).alias("label"))


@query("b24_id_checks", "SELECT DISTINCT route_id, regexp_full_match(lower(route_id), '[a-z0-9]+(-[a-z0-9]+)*') AS slug, regexp_full_match(concat('2025071', substr(route_id, 2, 1)), '[0-9]{8}') AS dated FROM g_trips")
def _(spark, g):
    return g.routes.select("route_id", C.is_slug(F.lower("route_id")).alias("slug"), C.is_date_id(F.concat(F.lit("2025071"), F.substring("route_id", 2, 1))).alias("dated"))


# --- filters


@query("c1_active_services", "SELECT service_id FROM active")
def _(spark, g):
    return feed.active_services(g.calendar, DATE)


_COUNTS = "SELECT '{n}' AS name, count(*) AS rows FROM {t}"


def counted(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(_COUNTS.format(n=n, t=t) for n, t in tables.items())


_DAY = (("day_routes", "SELECT * FROM g_routes WHERE route_id IN (SELECT route_id FROM day_trips)"), ("day_dirs", "SELECT d.* FROM dirs d WHERE EXISTS (SELECT 1 FROM day_trips t WHERE t.route_id = d.route_id AND t.direction_id = d.direction_id)"))


@query("c2_by_date", counted({"stops": "g_stops", "trips": "day_trips", "stop_times": "day_st", "routes": "day_routes", "directions": "day_dirs"}), *_DAY)
def _(spark, g):
    return feed.summary(day_of(g))


_BA = (
    ("ba_trips", "SELECT * FROM g_trips WHERE trip_id LIKE 'BA:%'"),
    ("ba_st", "SELECT * FROM st WHERE trip_id LIKE 'BA:%'"),
    ("ba_stops", "SELECT * FROM g_stops WHERE stop_id IN (SELECT anc FROM up WHERE stop_id IN (SELECT stop_id FROM ba_st))"),
    ("ba_cal", "SELECT * FROM g_calendar WHERE service_id IN (SELECT service_id FROM ba_trips)"),
    ("ba_routes", "SELECT * FROM g_routes WHERE route_id IN (SELECT route_id FROM ba_trips)"),
    ("ba_dirs", "SELECT d.* FROM dirs d WHERE EXISTS (SELECT 1 FROM ba_trips t WHERE t.route_id = d.route_id AND t.direction_id = d.direction_id)"),
)


@query("c4_by_prefix", counted({"stops": "ba_stops", "trips": "ba_trips", "calendar": "ba_cal", "stop_times": "ba_st", "routes": "ba_routes", "directions": "ba_dirs"}), *_BA)
def _(spark, g):
    return feed.summary(feed.by_prefixes(g, ["BA:"]))


@query("c3_by_trips", "SELECT stop_id, stop_name, stop_lat, stop_lon, parent_station FROM ba_stops", *_BA)
def _(spark, g):
    return feed.with_trips(g, g.trips.filter(F.col("trip_id").startswith("BA:"))).stops


@query("c5_by_routes", "SELECT t.* FROM day_trips t WHERE route_id IN ('R1', 'R2', 'R3') AND route_id <> 'R2' AND trip_id IN (SELECT trip_id FROM day_st)")
def _(spark, g):
    return feed.by_routes(day_of(g), ["R1", "R2", "R3"], ["R2"]).trips.select("trip_id", "route_id", "direction_id", "service_id", "trip_headsign")


_LAST = (("last_st", "SELECT * FROM day_st WHERE arrival < 86400"), ("last_trips", "SELECT * FROM day_trips WHERE trip_id IN (SELECT trip_id FROM last_st)"))


@query("c6_prune", "SELECT trip_id, route_id, direction_id, service_id, trip_headsign FROM last_trips", *_LAST)
def _(spark, g):
    return feed.cut_last_day(day_of(g)).trips


@query("c7_last_day", "SELECT trip_id, stop_id, stop_sequence, arrival, departure FROM last_st", *_LAST)
def _(spark, g):
    return feed.cut_last_day(day_of(g)).stop_times


_SAT = (
    ("sat", "SELECT service_id FROM g_calendar WHERE start_date <= '20250719' AND end_date >= '20250719' AND saturday"),
    ("two_st", "SELECT concat(s.trip_id, ':sd-0') AS trip_id, stop_id, stop_sequence, arrival, departure FROM day_st s WHERE trip_id LIKE 'BA:%' UNION ALL SELECT concat(s.trip_id, ':sd-1'), stop_id, stop_sequence, arrival + 86400, departure + 86400 FROM st s JOIN g_trips t USING (trip_id) WHERE service_id IN (SELECT service_id FROM sat) AND s.trip_id LIKE 'BA:%' AND arrival < 86400"),
)


@query("c8_world", "SELECT trip_id, stop_id, stop_sequence, CAST(arrival AS INT) AS arrival, CAST(departure AS INT) AS departure FROM two_st", *_SAT)
def _(spark, g):
    return feed.world(g, DATE, ["BA:"], 1).stop_times


@query("h1_service_days", "SELECT CAST(regexp_extract(trip_id, ':sd-([0-9]+)$', 1) AS INT) AS day, count(*) AS n, min(arrival) AS first, max(arrival) AS last FROM two_st GROUP BY day", *_SAT)
def _(spark, g):
    found = feed.world(g, DATE, ["BA:"], 1).stop_times
    return found.groupBy(C.service_day(F.col("trip_id")).alias("day")).agg(F.count("*").alias("n"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))


@query("c9_stops_by_prefix", "SELECT DISTINCT stop_id FROM st WHERE trip_id LIKE 'SC:%'")
def _(spark, g):
    return feed.stops_served(g, "SC:")


@query("f8_combine", "SELECT trip_id, route_id, service_id, first_day FROM (SELECT *, 0 AS first_day FROM day_trips UNION ALL SELECT *, 1 FROM g_trips WHERE trip_id NOT IN (SELECT trip_id FROM day_trips) AND trip_id LIKE 'CT:%')")
def _(spark, g):
    a = day_of(g)
    b = feed.by_prefixes(g, ["CT:"]).with_(calendar=None)
    both = feed.combine([a, b]).trips
    return both.join(a.trips.select("trip_id", F.lit(0).alias("_a")), "trip_id", "left").select("trip_id", "route_id", "service_id", F.when(F.col("_a").isNull(), 1).otherwise(0).alias("first_day"))


# --- aggregates of feeds


@query("e1_directions", "SELECT route_id, direction_id, direction FROM dirs")
def _(spark, g):
    return g.directions


@query("e13_summary", counted({"stops": "g_stops", "trips": "g_trips", "calendar": "g_calendar", "stop_times": "st", "routes": "g_routes", "directions": "dirs"}))
def _(spark, g):
    return feed.summary(g)


@query(
    "e12_stop_routes",
    "SELECT stop_id, stop_name, routes FROM (SELECT stop_id, string_agg(label, '; ' ORDER BY label) AS routes FROM lab GROUP BY stop_id) JOIN g_stops USING (stop_id)",
    ("rat", "SELECT DISTINCT stop_id, route_id, direction_id FROM day_st JOIN day_trips USING (trip_id)"),
    ("ofr", "SELECT route_id, count(DISTINCT direction_id) AS n FROM day_trips GROUP BY route_id"),
    ("here", "SELECT stop_id, route_id, count(DISTINCT direction_id) AS n, string_agg(DISTINCT direction, ', ' ORDER BY direction) AS names FROM rat LEFT JOIN dirs USING (route_id, direction_id) GROUP BY stop_id, route_id"),
    ("lab", "SELECT stop_id, CASE WHEN h.n < o.n THEN concat(route_id, ' [', names, ']') ELSE route_id END AS label FROM here h JOIN ofr o USING (route_id)"),
)
def _(spark, g):
    return feed.stop_routes(day_of(g).with_(directions=g.directions))


@query("e24_stops_by_name", "SELECT stop_name, string_agg(stop_id, ',' ORDER BY stop_id) AS stop_ids, count(*) AS n FROM g_stops GROUP BY stop_name")
def _(spark, g):
    return feed.stops_by_name(g.stops)


@query("e22_bounding_box", "SELECT min(stop_lat) AS south, max(stop_lat) AS north, min(stop_lon) AS west, max(stop_lon) AS east FROM g_stops")
def _(spark, g):
    return g.stops.agg(F.min("stop_lat").alias("south"), F.max("stop_lat").alias("north"), F.min("stop_lon").alias("west"), F.max("stop_lon").alias("east"))


@query("f7_dense_ids", "SELECT trip_id, CAST(row_number() OVER (ORDER BY trip_id) AS INT) AS id FROM g_trips GROUP BY trip_id")
def _(spark, g):
    return feed.dense_ids(g.trips, "trip_id")


@query("i1_root_stop", "SELECT stop_id, root_id FROM roots")
def _(spark, g):
    return feed.root_stops(g.stops)


@query("i2_ancestors", "SELECT DISTINCT anc AS stop_id FROM up WHERE stop_id IN (SELECT stop_id FROM day_st)")
def _(spark, g):
    return feed.ancestors(g.stops, day_of(g).stop_times)


@query("d3_named_stop_times", "SELECT trip_id, stop_sequence, stop_name FROM nst JOIN g_stops USING (stop_id)")
def _(spark, g):
    day = feed.normalized(day_of(g))
    return day.stop_times.join(small(day.stops.select("stop_id", "stop_name")), "stop_id").select("trip_id", "stop_sequence", "stop_name")


# --- steps


@query("f1_steps", "SELECT o, d, dep, arr, trip_id FROM steps")
def _(spark, g):
    return steps_of(g).drop("is_flex")


@query("d4_walking", "SELECT o, d, seconds FROM walks")
def _(spark, g):
    return network_of(g)[1].select("o", "d", F.col("arr").alias("seconds"))


@query("d21_nearest_stop", "SELECT a.stop_id, CAST(round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 3) AS DOUBLE) AS metres FROM roots_at a JOIN roots_at b ON a.stop_id <> b.stop_id GROUP BY a.stop_id")
def _(spark, g):
    return steps.nearest_stop(feed.normalized(g).stops).select("stop_id", F.round("metres", 3).alias("metres"))


@query("d17_boundary", "SELECT 'START' AS o, stop_id AS d, 0 AS dep, 0 AS arr FROM roots_at UNION ALL SELECT stop_id, 'END', 0, 0 FROM roots_at")
def _(spark, g):
    return steps.boundary(feed.normalized(g).stops).select("o", "d", "dep", "arr")


@query("e3_minimal_cover", "SELECT o, d, dep, arr, trip_id FROM cover")
def _(spark, g):
    return cover_of(g).filter("not is_flex").drop("is_flex")


@query("d22_dominated", "SELECT count(*) AS rides, CAST((SELECT count(*) FROM free) AS BIGINT) AS kept FROM steps", ("free0", "SELECT *, min(arr) OVER (PARTITION BY o, d ORDER BY dep, arr DESC, trip_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM steps"), ("free", "SELECT * FROM free0 WHERE later IS NULL OR arr < later"))
def _(spark, g):
    rides = steps_of(g)
    return rides.agg(F.count("*").alias("rides")).crossJoin(steps.minimal_cover(rides).agg(F.count("*").alias("kept")))


@query("m1_cover_violations", "SELECT o, d, dep, arr, trip_id FROM cover WHERE arr < dep - 1000000")
def _(spark, g):
    return steps.out_of_order(cover_of(g)).select("o", "d", "dep", "arr", "trip_id")


# --- as-of joins

_CHANGE = (
    ("two", "SELECT * FROM cover WHERE o <> d"),
    ("ends", "SELECT DISTINCT o, d FROM two"),
    ("ask", "SELECT a.o, a.d AS via, e.d AS xd, a.dep, a.arr AS at_s, a.trip_id AS first_trip FROM two a JOIN ends e ON e.o = a.d"),
    ("rr", "SELECT q.o, via, q.xd AS d, q.dep, b.arr, first_trip, b.trip_id AS second_trip FROM ask q ASOF JOIN two b ON q.via = b.o AND q.xd = b.d AND q.at_s <= b.dep"),
    ("wr", "SELECT w.o, w.d AS via, b.d, b.dep - w.seconds AS dep, b.arr, concat('walk:', w.o, ':', w.d) AS first_trip, b.trip_id AS second_trip FROM walks w JOIN two b ON b.o = w.d"),
    ("rw", "SELECT a.o, a.d AS via, w.d, a.dep, a.arr + w.seconds AS arr, a.trip_id AS first_trip, concat('walk:', w.o, ':', w.d) AS second_trip FROM two a JOIN walks w ON w.o = a.d"),
    ("rides2", "SELECT * FROM rr UNION ALL SELECT * FROM wr UNION ALL SELECT * FROM rw"),
    ("ww0", "SELECT a.o, a.d AS via, b.d, a.seconds + b.seconds AS walk, concat('walk:', a.o, ':', a.d) AS first_trip, concat('walk:', b.o, ':', b.d) AS second_trip FROM walks a JOIN walks b ON b.o = a.d WHERE a.o <> b.d"),
    ("ww", "SELECT o, d, min(walk) AS walk FROM ww0 GROUP BY o, d"),
    ("change0", "SELECT r.*, min(arr) OVER (PARTITION BY r.o, r.d ORDER BY dep, arr DESC, via, concat(first_trip, '>', second_trip) ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, walk FROM rides2 r LEFT JOIN ww USING (o, d) WHERE r.o <> r.d"),
    ("change", "SELECT o, via, d, dep, arr, first_trip, second_trip, false AS is_flex FROM change0 WHERE (later IS NULL OR arr < later) AND (walk IS NULL OR arr - dep < walk)"),
    ("wchange", "SELECT o, via, d, CAST(0 AS INT) AS dep, walk AS arr, first_trip, second_trip, true AS is_flex FROM (SELECT *, row_number() OVER (PARTITION BY o, d ORDER BY walk, via DESC, concat(first_trip, '>', second_trip) DESC) AS r FROM ww0) WHERE r = 1"),
)


@query("d5_connections", "SELECT * EXCLUDE (is_flex) FROM change", *_CHANGE)
def _(spark, g):
    cover = cut(cover_of(g).filter("o <> d"))
    return asof.connections(cover, cover).filter("not is_flex").select("o", "via", "d", "dep", "arr", "first_trip", "second_trip")


@query("d5_connections_all", "SELECT * FROM change UNION ALL SELECT * FROM wchange", *_CHANGE)
def _(spark, g):
    cover = cut(cover_of(g).filter("o <> d"))
    return asof.connections(cover, cover).select("o", "via", "d", "dep", "arr", "first_trip", "second_trip", "is_flex")


_ASK = (("ask7", "SELECT o_orderkey AS query_id, concat('N', CAST(o_custkey % 25 AS STRING)) AS stop, CAST((o_orderkey * 31) % 90000 AS INT) AS at_s FROM orders GROUP BY ALL"), ("free70", "SELECT *, min(arr) OVER (PARTITION BY o, d ORDER BY dep, arr DESC, trip_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM steps"), ("free7", "SELECT * FROM free70 WHERE later IS NULL OR arr < later"), ("ends7", "SELECT DISTINCT o, d FROM free7"), ("ends6", "SELECT DISTINCT o, d FROM cover"))
_NEXT = 'SELECT query_id, stop, at_s AS "at", q.xd AS d, b.dep, b.arr, b.trip_id FROM (SELECT a.*, e.d AS xd FROM ask7 a JOIN ends7 e ON e.o = a.stop) q ASOF JOIN free7 b ON q.stop = b.o AND q.xd = b.d AND q.at_s <= b.dep'
_BEST = "SELECT query_id AS id, d, dep, arr, trip_id, is_flex FROM (SELECT *, row_number() OVER (PARTITION BY query_id, d ORDER BY arr, is_flex, trip_id) AS r FROM (SELECT query_id, q.xd AS d, b.dep, b.arr, b.trip_id, false AS is_flex FROM (SELECT a.*, e.d AS xd FROM ask7 a JOIN ends6 e ON e.o = a.stop) q ASOF JOIN cover b ON q.stop = b.o AND q.xd = b.d AND q.at_s <= b.dep UNION ALL SELECT query_id, w.d, at_s, at_s + seconds, concat('walk:', w.o, ':', w.d), true FROM ask7 JOIN walks w ON w.o = stop)) WHERE r = 1"


def questions(spark) -> DataFrame:
    """every_question() with equal rows as often as the orders have them."""
    o = spark.table("orders")
    return o.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")).alias("stop"), ((F.col("o_orderkey") * 31) % 90000).cast("int").alias("at"))


def every_question(spark) -> DataFrame:
    """Times and stops at which someone sets out, one per order."""
    return questions(spark).distinct()


@query("d7_next_departure", _NEXT, *_ASK)
def _(spark, g):
    rides = cut(steps.minimal_cover(steps_of(g)))
    return asked_once(every_question(spark), lambda asked: asof.next_departures(asked, rides))


@query("d6_best_next_all", _BEST, *_ASK)
@query("d6_best_next", _BEST, *_ASK)
def _(spark, g):
    return asof.best_next(questions(spark).withColumnRenamed("query_id", "id"), cut(cover_of(g)))


def asked_once(asked: DataFrame, answer) -> DataFrame:
    """answer(questions) for every row of asked (query_id, stop, at); equal stops and times are asked once and joined back.

    answer takes and returns a query_id, here that of the pair.
    """
    pair = F.concat_ws("@", "stop", "at")
    asked = cut(asked.select("query_id", pair.alias("pair"), "stop", "at"))
    found = answer(asked.select(F.col("pair").alias("query_id"), "stop", "at").distinct())
    return asked.select("query_id", "pair").join(found.withColumnRenamed("query_id", "pair"), "pair").drop("pair")


@query("d7_next_departure_all", _NEXT, *_ASK)
def _(spark, g):
    rides = cut(steps.minimal_cover(steps_of(g)))
    return asked_once(every_question(spark), lambda asked: asof.next_departures(asked, rides))


# --- graphs

_EDGES = ("edges", "SELECT o, d, min(arr - dep) AS w FROM steps WHERE o <> d GROUP BY o, d")


def edges_of(g) -> DataFrame:
    return graph.relaxed_edges(steps_of(g).filter("o <> d"))


@query("e2_relaxed_edges", "SELECT o, d, CAST(w AS INT) AS w FROM edges", _EDGES)
def _(spark, g):
    return edges_of(g)


@query("d20_reversed_edges", "SELECT d AS o, o AS d, CAST(w AS INT) AS w FROM edges", _EDGES)
def _(spark, g):
    return graph.reversed_edges(edges_of(g))


_LOHI = ("lohi", "SELECT least(o, d) AS lo, greatest(o, d) AS hi, min(w) AS w FROM edges GROUP BY 1, 2")


@query("e9_undirected_edges", "SELECT lo, hi, CAST(w AS INT) AS w FROM lohi", _EDGES, _LOHI)
def _(spark, g):
    return graph.undirected_edges(edges_of(g))


@query("e10_degrees", "SELECT stop_id, count(*) AS degree FROM (SELECT lo AS stop_id FROM lohi UNION ALL SELECT hi FROM lohi) GROUP BY stop_id", _EDGES, _LOHI)
def _(spark, g):
    return graph.degrees(graph.undirected_edges(edges_of(g)))


@query("e19_horizon", "SELECT CAST(max(dep) + 1 AS INT) AS horizon FROM steps")
def _(spark, g):
    return profiles.horizon_of(steps_of(g))


def _relax(rounds: int) -> list[tuple[str, str]]:
    out = [("r0", "SELECT DISTINCT o AS src, o AS stop, CAST(0 AS BIGINT) AS dist FROM edges")]
    for i in range(1, rounds + 1):
        out.append((f"r{i}", f"SELECT src, stop, min(dist) AS dist FROM (SELECT * FROM r{i - 1} UNION ALL SELECT src, e.d, dist + w FROM r{i - 1} r JOIN edges e ON e.o = r.stop) GROUP BY src, stop"))
    return out


@query("i3_distances", "SELECT src, stop, CAST(dist AS BIGINT) AS dist FROM r8", _EDGES, *_relax(8))
def _(spark, g):
    edges = cut(edges_of(g))
    return graph.distances(edges, edges.select(F.col("o").alias("stop_id")).distinct())


@query("e20_set_distances", "SELECT concat('S', CAST(CAST(substr(src, 2) AS INT) % 6 AS STRING)) AS set_id, stop, CAST(min(dist) AS BIGINT) AS dist FROM r8 GROUP BY ALL", _EDGES, *_relax(8))
def _(spark, g):
    edges = cut(edges_of(g))
    sources = edges.select(F.col("o").alias("stop_id")).distinct()
    members = sources.select(F.concat(F.lit("S"), (F.substring("stop_id", 2, 20).cast("int") % 6).cast("string")).alias("set_id"), "stop_id")
    dist = graph.distances(edges, sources)
    return graph.set_distances(dist, members)


def parted(g) -> DataFrame:
    """The minimal cover with the route of each ride as its partition; walks have partition -1."""
    cover = cover_of(g).filter("o <> d")
    route = day_of(g).trips.select("trip_id", F.substring("route_id", 2, 10).cast("int").alias("part"))
    return cover.join(route, "trip_id", "left").withColumn("part", F.coalesce("part", F.lit(-1)))


_PARTED = (
    ("parted", "SELECT c.o, c.d, c.dep, c.arr, false AS is_flex, CAST(substr(t.route_id, 2, 10) AS INT) AS part FROM cover c JOIN g_trips t USING (trip_id) WHERE c.o <> c.d UNION ALL SELECT o, d, 0, seconds, true, -1 FROM walks"),
    ("into_s", "SELECT DISTINCT d AS stop, part, CASE WHEN is_flex THEN NULL ELSE arr END AS t FROM parted"),
    ("flexs", "SELECT d AS stop, part, bool_or(is_flex) AS flex FROM parted GROUP BY d, part"),
    ("outs", "SELECT o AS stop, d, part AS d_part, min(arr - dep) AS w, min(CASE WHEN is_flex THEN arr - dep END) AS walk FROM parted GROUP BY o, d, part"),
    ("anyt", "SELECT f.stop, f.part, d, d_part, CASE WHEN flex THEN w ELSE walk END AS w FROM flexs f JOIN outs USING (stop)"),
    ("waits", "SELECT q.stop, q.part, q.xd AS d, q.xp AS d_part, b.arr - q.t AS w FROM (SELECT i.stop, i.part, i.t, o.d AS xd, o.d_part AS xp FROM into_s i JOIN flexs f USING (stop, part) JOIN (SELECT DISTINCT o AS stop, d, part AS d_part FROM parted WHERE NOT is_flex) o ON o.stop = i.stop WHERE NOT flex) q ASOF JOIN (SELECT * FROM parted WHERE NOT is_flex) b ON q.stop = b.o AND q.xd = b.d AND q.xp = b.part AND q.t <= b.dep"),
    ("tedges", "SELECT stop AS o, part AS o_part, d, d_part, CAST(min(w) AS INT) AS w FROM (SELECT * FROM anyt UNION ALL SELECT * FROM waits) WHERE w IS NOT NULL GROUP BY ALL"),
    ("tstates", "SELECT o AS stop, o_part AS part FROM tedges UNION SELECT d, d_part FROM tedges"),
    ("tsig", "SELECT s.stop, s.part, coalesce(string_agg(concat(d, '/', CAST(d_part AS STRING), '/', CAST(w AS STRING)), ',' ORDER BY concat(d, '/', CAST(d_part AS STRING), '/', CAST(w AS STRING))), '') AS signature FROM tstates s LEFT JOIN tedges e ON e.o = s.stop AND e.o_part = s.part GROUP BY s.stop, s.part"),
    ("trep", "SELECT *, min(part) OVER (PARTITION BY stop, signature) AS rep FROM tsig"),
    ("tnew", "SELECT stop, part, CAST(dense_rank() OVER (PARTITION BY stop ORDER BY rep) - 1 AS INT) AS new_part FROM trep"),
)


@query("e4_arrivals", "SELECT d AS stop, part, CAST(count(DISTINCT CASE WHEN NOT is_flex THEN arr END) AS BIGINT) AS n, bool_or(is_flex) AS flex FROM parted GROUP BY d, part", *_PARTED)
def _(spark, g):
    return graph.arrivals(parted(g)).groupBy("stop", "part").agg(F.count("t").alias("n"), F.max("flex").alias("flex"))


@query("i21_transfer_edges", "SELECT o, o_part, d, d_part, w FROM tedges", *_PARTED)
def _(spark, g):
    return graph.transfer_edges(parted(g))


@query("e16_signatures", "SELECT stop, part, md5(signature) AS digest FROM tsig", *_PARTED)
def _(spark, g):
    return graph.signatures(graph.transfer_edges(parted(g))).select("stop", "part", F.md5("signature").alias("digest"))


@query("i22_state_merge", "SELECT stop, part, new_part FROM tnew", *_PARTED)
def _(spark, g):
    return graph.merged_states(graph.transfer_edges(parted(g)))


@query("e17_merged_edges", "SELECT e.o, a.new_part AS o_part, e.d, b.new_part AS d_part, min(w) AS w FROM tedges e JOIN tnew a ON a.stop = e.o AND a.part = e.o_part JOIN tnew b ON b.stop = e.d AND b.part = e.d_part GROUP BY ALL", *_PARTED)
def _(spark, g):
    edges = cut(graph.transfer_edges(parted(g)))
    return graph.remapped_edges(edges, graph.merged_states(edges))


@query("e18_states_per_stop", "SELECT stop, count(DISTINCT new_part) AS states FROM tnew GROUP BY stop", *_PARTED)
def _(spark, g):
    return graph.states_per_stop(graph.merged_states(graph.transfer_edges(parted(g))))


@query("c18_without_edge", "SELECT o, d, dep, arr, trip_id FROM steps WHERE NOT (o = 'N1' AND d = 'N2')")
def _(spark, g):
    return graph.without_edges(steps_of(g), spark.createDataFrame([("N1", "N2")], "o string, d string")).drop("is_flex")


def _components(rounds: int) -> list[tuple[str, str]]:
    out = [("walked", "SELECT o AS a, d AS b FROM walks"), ("k0", "SELECT DISTINCT a AS node, a AS root FROM walked")]
    for i in range(1, rounds + 1):
        out.append((f"k{i}", f"SELECT k.node, least(k.root, min(j.root)) AS root FROM k{i - 1} k JOIN walked w ON w.a = k.node JOIN k{i - 1} j ON j.node = w.b GROUP BY k.node, k.root"))
    return out


@query("i10_components", "SELECT node, root FROM k25", *_components(25))
def _(spark, g):
    return graph.connected_components(network_of(g)[1], "o", "d")


@query("i9_tree_leaves")
def _(spark, g):
    return graph.tree_leaves(graph.spanning_tree(graph.undirected_edges(edges_of(g))))


# --- profiles

_REQ = ["N0", "N4", "N11", "N17", "N23"]
_SOME = "('" + "', '".join(_REQ) + "')"


def required_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _REQ], "stop_id string")


def ba_steps(g) -> DataFrame:
    """Rides of one prefix and the walks of the day."""
    rides, walks = feed.network(feed.on_date(g, DATE, ["BA:"]))
    return rides.unionByName(walks)


@query("i4_earliest_arrivals")
def _(spark, g):
    return asked_once(every_question(spark), lambda asked: profiles.earliest_arrivals(asked, ba_steps(g)).select("query_id", "stop", "at"))


@query("i5_profile")
def _(spark, g):
    return profiles.closure(ba_steps(g), spark.createDataFrame([("N3",)], "stop_id string")).select("o", "d", "dep", "arr", "is_flex")


@query("i6_reduce")
def _(spark, g):
    return profiles.reduced(ba_steps(g), required_of(spark)).select("o", "d", "dep", "arr", "is_flex", F.size("legs").alias("legs"))


@query("i7_completed")
def _(spark, g):
    return profiles.reduced(ba_steps(g), required_of(spark), complete=True).select("o", "d", "dep", "arr", "is_flex", F.size("legs").alias("legs"))


@query("e8_goodness")
def _(spark, g):
    return profiles.stop_goodness(profiles.reduced(ba_steps(g), required_of(spark)))


