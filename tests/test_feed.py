"""Feeds on the hand-made timetable: filters, service days, stations, reading and writing."""

import pytest
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators import feed as ops
from tramline.operators import services
from tramline.sources import gtfs

WEEK = "monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string"


@pytest.fixture(scope="module")
def small(spark):
    make = spark.createDataFrame
    stops = make([("S1", "One", 37.0, -122.0, ""), ("S2", "Two, \"North\"", 37.1, -122.1, ""), ("S3", "Three", 37.2, -122.2, "")], gtfs.STOPS)
    trips = make([("R1", 0, "T1", "weekday"), ("R1", 1, "T2", "weekday"), ("R2", 0, "T3", "weekend"), ("R1", 0, "T4", "latenight"), ("R2", 0, "T5", "weekday"), ("R1", 0, "PREFIX:T6", "weekday")], "route_id string, direction_id int, trip_id string, service_id string")
    days, end = ["1"] * 5 + ["0"] * 2, ("20250701", "20250731")
    calendar = make([("weekday", *days, *end), ("weekend", *["0"] * 5, "1", "1", *end), ("latenight", *days, *end)], f"service_id string, {WEEK}, start_date string, end_date string")
    times = [("T1", "S1", "08:00", "S2", "08:30"), ("T2", "S2", "09:00", "S1", "09:30"), ("T3", "S1", "10:00", "S3", "10:45"), ("T4", "S1", "25:00", "S2", "25:30"), ("T5", "S2", "06:00", "S3", "06:30"), ("PREFIX:T6", "S1", "12:00", "S2", "12:30")]
    rows = [r for t, a, x, b, y in times for r in ((t, a, 1, x + ":00", x + ":00"), (t, b, 2, y + ":00", y + ":00"))] + [("T1", "S3", 3, "", "")]
    stop_times = make(rows, "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string")
    routes = make([("R1", "Route1", "Route One"), ("R2", "Route2", "Route Two")], "route_id string, route_short_name string, route_long_name string")
    directions = make([("R1", 0, "North"), ("R1", 1, "South"), ("R2", 0, "East")], gtfs.DIRECTIONS)
    return gtfs.GtfsFeed.of(stops, trips, calendar, stop_times, routes, directions)


def ids(df, c="trip_id"):
    return sorted(r[c] for r in df.select(c).distinct().collect())


def test_date_filter(small):
    friday, saturday = ops.on_date(small, "20250718"), ops.on_date(small, "20250719")
    assert ids(friday.trips) == ["PREFIX:T6", "T1", "T2", "T4", "T5"] and friday.stops.count() == 3
    assert ids(saturday.trips) == ["T3"] and ids(saturday.routes, "route_id") == ["R2"] and saturday.directions.count() == 1
    assert ops.on_date(small, "20250801").trips.count() == 0
    with pytest.raises(ValueError):
        ops.active_services(small.calendar, "2025-07-18")


def test_prefix_trips_routes(small):
    day = ops.by_prefixes(small, ["PREFIX:"])
    assert ids(day.trips) == ["PREFIX:T6"] and ids(day.stops, "stop_id") == ["S1", "S2"] and ids(day.calendar, "service_id") == ["weekday"]
    assert ops.by_prefixes(small, []).trips.count() == 6
    friday = ops.on_date(small, "20250718")
    assert ids(ops.by_routes(friday, ["R2"]).trips) == ["T5"] and ids(ops.by_routes(friday, exclude=["R1"]).trips) == ["T5"]


def test_service_days(small):
    span = ops.service_days(small, "20250717", 1)
    assert ids(span.trips) == sorted([f"{t}:sd-{d}" for d in (0, 1) for t in ("T1", "T2", "T4", "T5", "PREFIX:T6") if (t, d) != ("T4", 1)])
    at = {(r.trip_id, r.stop_sequence): r.arrival for r in span.stop_times.collect()}
    assert at["T1:sd-1", 1] == 8 * 3600 + 86400 and at["T4:sd-0", 2] == 25 * 3600 + 1800
    assert ids(ops.service_days(small, "20250718", 0).trips)[-2:] == ["T4:sd-0", "T5:sd-0"]
    with pytest.raises(ValueError):
        ops.service_days(small, "20250718", -1)


def test_parse_times(spark):
    rows = spark.createDataFrame([("08:30:15",), ("25:00:00x",), ("99:99:99",)], "t string")
    assert [r[0] for r in rows.select(C.parse_time(F.col("t"))).collect()] == [30615, 90000, 99 * 3600 + 99 * 60 + 99]
    for bad in ("8:30:00", "abc", ""):
        with pytest.raises(Exception, match="not a time"):
            spark.createDataFrame([(bad,)], "t string").select(C.parse_time(F.col("t"))).collect()
        assert spark.createDataFrame([(bad,)], "t string").select(C.parse_time(F.col("t"), strict=False)).first()[0] is None


def test_service_day_suffix(spark):
    get = lambda t: spark.createDataFrame([(t,)], "t string").select(C.service_day(F.col("t"), strict=False)).first()[0]
    assert (get("A:sd-2"), get("A:sd-1:sd-12"), get("A:sd-"), get("A"), get("A:sd-x")) == (2, 12, None, None, None)


def test_labels(spark):
    row = spark.range(1).select(C.format_signed_time(F.lit(-65)), C.short_duration(F.lit(5 * 3600 + 55 * 60 + 29)), C.short_duration(F.lit(2010)), C.elapsed_label(F.lit(3.14)), C.elapsed_label(F.lit(614.2)), C.clock_label(F.lit(90060))).first()
    assert list(row) == ["-00:01:05", "5h55m", "34m", "3.1s", "10m14s", "25:01"]
    dates = spark.range(1).select(C.offset_date(F.lit("20240228"), 2), C.offset_date(F.lit("20250101"), -1), C.day_of_week(F.lit("20250720")), C.weekday_label(F.lit("20250718"))).first()
    assert list(dates) == ["20240301", "20241231", 0, "Fri 07-18"]


def test_root_stops(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone"), ("w", "x"), ("s", "s")]
    stops = spark.createDataFrame(rows, "stop_id string, parent_station string")
    assert {r.stop_id: r.root_id for r in ops.root_stops(stops).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "y", "z": "gone", "w": "w", "s": "s"}
    assert ids(ops.ancestors(stops, spark.createDataFrame([("c",), ("x",)], "stop_id string")), "stop_id") == ["a", "b", "c", "x", "y"]


def test_missing_directions(spark):
    trips = spark.createDataFrame([("R", 0, "1", "s", "B"), ("R", 0, "2", "s", "A"), ("R", 1, "3", "s", "C")], gtfs.TRIPS)
    assert sorted(tuple(r) for r in gtfs.directions_of(trips).collect()) == [("R", 0, "A*"), ("R", 1, "C")]


def test_save_and_load(spark, small, tmp_path):
    day = ops.on_date(small, "20250718")
    gtfs.save_feed(day, f"file://{tmp_path}/feed")
    back = gtfs.load_day(spark, f"file://{tmp_path}/feed")
    for name, table in day.tables().items():
        columns = table.columns
        assert sorted(map(str, getattr(back, name).select(*columns).collect())) == sorted(map(str, table.collect())), name
    gtfs.save_feed(small, f"file://{tmp_path}/whole")
    with pytest.raises(ValueError):
        gtfs.load_day(spark, f"file://{tmp_path}/whole")


def test_patterns(spark, small):
    dates = services.date_range(spark, "20250717", 5)
    found = services.patterns(services.day_services(services.active_on(small.calendar, dates), dates.filter("date < '20250721'"), 1))
    marked = {r.date: r.duplicate_of for r in services.duplicates(found).collect()}
    assert marked == {"20250717": None, "20250718": None, "20250719": None, "20250720": None}
    back = services.from_json(services.to_json(found))
    assert sorted(map(str, back.collect())) == sorted(map(str, found.select("date", "pattern").collect()))
    with pytest.raises(Exception, match="consecutive"):
        services.from_json(spark.createDataFrame([("d", '{"sd-0":[],"sd-2":[]}')], "date string, document string")).collect()


def test_dense_ids(spark):
    rows = spark.createDataFrame([(f"k{i % 50:02d}",) for i in range(200)], "k string")
    assert {r.k: r.id for r in ops.dense_ids(rows, "k").collect()} == {f"k{i:02d}": i + 1 for i in range(50)}


def test_filters_on_times_do_not_repeat_the_parser(spark):
    raw = spark.range(3).select(F.col("id").cast("string").alias("trip_id"), F.lit("s").alias("stop_id"), F.lit(1).alias("stop_sequence"), F.concat(F.lit("0"), F.col("id").cast("string"), F.lit(":00:00")).alias("arrival_time"), F.lit("09:00:00").alias("departure_time"))
    times = gtfs.parsed_stop_times(raw)
    parsers = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    early = times.filter("arrival < 3700")
    assert parsers(early) == parsers(times)
    assert sorted(r.trip_id for r in early.collect()) == ["0", "1"]


def test_used_stops_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    stops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("z", None)], "stop_id string, parent_station string")
    used = spark.createDataFrame([("a",)] * 7, "stop_id string").mapInPandas(counted, "stop_id string")
    assert sorted(r.stop_id for r in ops.ancestors(stops, used).collect()) == ["a", "b", "c"]
    assert read.value == 7
