"""A timetable derived from the TPC-H-like tables, in one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramline.sources.gtfs import GtfsFeed

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")
DATE = "20250718"

_PREFIX = "CASE WHEN {k} % 3 = 0 THEN 'BA:' WHEN {k} % 3 = 1 THEN 'CT:' ELSE 'SC:' END"
_CLOCK = "concat(lpad(CAST(CAST(floor({t} / 3600.0) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(CAST(floor(({t} % 3600) / 60.0) AS INT) AS STRING), 2, '0'), ':', lpad(CAST({t} % 60 AS STRING), 2, '0'))"

VIEWS = {
    "g_trips": f"SELECT concat({_PREFIX.format(k='o_orderkey')}, CAST(o_orderkey AS STRING)) AS trip_id, concat('R', CAST(o_custkey % 10 AS STRING)) AS route_id, CAST(o_orderkey % 2 AS INT) AS direction_id, concat('S', CAST(o_orderkey % 6 AS STRING)) AS service_id, o_orderpriority AS trip_headsign FROM orders",
    "g_st0": "SELECT l_orderkey, l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INT) AS stop_sequence FROM lineitem",
    "g_st1": "SELECT l_orderkey, l_suppkey, l_partkey, stop_sequence, CAST((l_orderkey * 7919) % 93600 + stop_sequence * 300 + l_partkey % 200 AS INT) AS arr_s, CAST((l_orderkey * 7919) % 93600 + stop_sequence * 300 + l_partkey % 200 + 30 + l_suppkey % 30 AS INT) AS dep_s FROM g_st0",
    "g_stop_times": f"SELECT concat({_PREFIX.format(k='l_orderkey')}, CAST(l_orderkey AS STRING)) AS trip_id, concat('P', CAST(l_suppkey AS STRING)) AS stop_id, stop_sequence, CASE WHEN l_partkey % 97 = 0 THEN '' ELSE {_CLOCK.format(t='arr_s')} END AS arrival_time, {_CLOCK.format(t='dep_s')} AS departure_time FROM g_st1",
    "g_stops": "SELECT concat('N', CAST(n_nationkey AS STRING)) AS stop_id, n_name AS stop_name, CAST(37.0 + (n_nationkey % 5) * 0.003 AS DOUBLE) AS stop_lat, CAST(-122.0 + floor(n_nationkey / 5.0) * 0.003 AS DOUBLE) AS stop_lon, CASE WHEN n_nationkey % 7 = 6 THEN concat('N', CAST(n_nationkey - 1 AS STRING)) END AS parent_station FROM nation UNION ALL SELECT concat('P', CAST(s_suppkey AS STRING)), s_name, CAST(37.0 + (s_nationkey % 5) * 0.003 AS DOUBLE), CAST(-122.0 + floor(s_nationkey / 5.0) * 0.003 AS DOUBLE), concat('N', CAST(s_nationkey AS STRING)) FROM supplier",
    "g_calendar": "SELECT concat('S', CAST(n_nationkey AS STRING)) AS service_id, n_nationkey < 4 AS monday, n_nationkey < 4 AS tuesday, n_nationkey < 5 AS wednesday, n_nationkey < 4 AS thursday, n_nationkey <> 5 AS friday, n_nationkey >= 3 AS saturday, n_nationkey >= 4 AS sunday, '20250701' AS start_date, CASE WHEN n_nationkey = 2 THEN '20250715' ELSE '20250731' END AS end_date FROM nation WHERE n_nationkey < 6",
    "g_routes": "SELECT DISTINCT route_id, route_id AS route_short_name, concat('Route ', route_id) AS route_long_name, '' AS route_color, '' AS route_text_color FROM g_trips",
}


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Register the given tables and the views over them."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def feed(spark: SparkSession, sf_dir: str) -> GtfsFeed:
    """The derived timetable; its directions are made from head signs, as no table has them."""
    tables(spark, sf_dir)
    t = spark.table
    return GtfsFeed.of(stops=t("g_stops"), trips=t("g_trips"), calendar=t("g_calendar"), stop_times=t("g_stop_times"), routes=t("g_routes"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.table(name)


#: Further common tables of the oracle texts, in an order in which each needs only earlier ones.
_SECONDS = "CAST(substr({c}, 1, 2) AS INT) * 3600 + CAST(substr({c}, 4, 2) AS INT) * 60 + CAST(substr({c}, 7, 2) AS INT)"
ORACLE = VIEWS | {
    "st": f"SELECT trip_id, stop_id, stop_sequence, {_SECONDS.format(c='arrival_time')} AS arrival, {_SECONDS.format(c='departure_time')} AS departure FROM g_stop_times WHERE arrival_time <> '' AND departure_time <> ''",
    "up": "SELECT stop_id, stop_id AS anc, 0 AS depth FROM g_stops UNION ALL SELECT up.stop_id, s.parent_station, depth + 1 FROM up JOIN g_stops s ON s.stop_id = up.anc WHERE s.parent_station IS NOT NULL",
    "roots": "SELECT stop_id, arg_max(anc, depth) AS root_id FROM up GROUP BY stop_id",
    "active": f"SELECT service_id FROM g_calendar WHERE start_date <= '{DATE}' AND end_date >= '{DATE}' AND friday",
    "day_trips": "SELECT * FROM g_trips WHERE service_id IN (SELECT service_id FROM active)",
    "day_st": "SELECT st.* FROM st WHERE trip_id IN (SELECT trip_id FROM day_trips)",
    "dirs0": "SELECT route_id, direction_id, trip_headsign, count(*) AS n FROM g_trips GROUP BY ALL",
    "dirs": "SELECT route_id, direction_id, concat(max(CASE WHEN r = 1 THEN trip_headsign END), CASE WHEN count(*) > 1 THEN '*' ELSE '' END) AS direction FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY n DESC, trip_headsign) AS r FROM dirs0) GROUP BY route_id, direction_id",
    "nst": "SELECT trip_id, root_id AS stop_id, stop_sequence, arrival, departure FROM day_st JOIN roots USING (stop_id)",
    "steps0": "SELECT trip_id, stop_id AS o, lead(stop_id) OVER w AS d, departure AS dep, lead(arrival) OVER w AS arr FROM nst WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)",
    "steps": "SELECT o, d, dep, arr, trip_id FROM steps0 WHERE d IS NOT NULL",
    "roots_at": "SELECT stop_id, stop_name, stop_lon * 111000.0 * cos(radians(37.0)) AS x, stop_lat * 111000.0 AS y FROM g_stops WHERE parent_station IS NULL",
    "walks": "SELECT a.stop_id AS o, b.stop_id AS d, CAST(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1.0) AS INT) AS seconds FROM roots_at a JOIN roots_at b ON a.stop_id <> b.stop_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 500.0",
    "cover0": "SELECT s.*, w.seconds AS walk, min(arr) OVER (PARTITION BY s.o, s.d ORDER BY dep, arr DESC, trip_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM steps s LEFT JOIN walks w ON w.o = s.o AND w.d = s.d",
    "cover": "SELECT o, d, dep, arr, trip_id FROM cover0 WHERE (later IS NULL OR arr < later) AND (walk IS NULL OR arr - dep < walk)",
}


def sql(text: str, *more: tuple[str, str]) -> str:
    """text as a DuckDB query with the common tables that it needs; more: (name, text) of its own, kept as tables if named *_m."""
    known, order, need = ORACLE | dict(more), [*ORACLE, *(k for k, _ in more)], set()

    def want(body: str) -> None:
        import re

        for name in set(re.findall(r"[a-z_0-9]+", body)) & known.keys() - need:
            need.add(name)
            want(known[name])

    want(text)
    return "WITH RECURSIVE " + ", ".join(f"{k} AS {'MATERIALIZED ' if k.endswith('_m') else ''}({known[k]})" for k in order if k in need) + " " + text if need else text
