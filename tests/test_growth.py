"""Queries whose files and look-ups must not grow with copies of what they ask."""

import os

from pyspark.sql import functions as F

from tramline.operators import graph
from tramline.plans import demo, exchange_queries, timetable_queries
from tramline.sources import gtfs

SF = "/root/testdata/sf0.001"


def test_config_rows_write_no_file_a_text(spark, monkeypatch):
    folders, made = [], exchange_queries.shared_folder
    monkeypatch.setattr(exchange_queries, "shared_folder", lambda *a: folders.append(made(*a)) or folders[-1])
    found = exchange_queries.QUERIES["a18_config_rows"](spark, SF)
    rows = found.count()
    files = [f for _, _, names in os.walk(folders[0].removeprefix("file://")) for f in names if f.startswith("part-")]
    assert rows == spark.read.parquet(f"{SF}/supplier.parquet").count() > len(files)


def test_equal_questions_are_looked_up_once(spark, monkeypatch):
    asked, look_up = [], timetable_queries.asof.next_departures
    monkeypatch.setattr(timetable_queries.asof, "next_departures", lambda q, rides: asked.append(q.count()) or look_up(q, rides))
    twice = spark.createDataFrame([(100 * k + n, f"N{n}", 60) for k in range(2) for n in range(25)], "query_id long, stop string, at int")
    monkeypatch.setattr(timetable_queries, "every_question", lambda s: twice)
    found = timetable_queries.QUERIES["d7_next_departure"](spark, SF).collect()
    first, again = ({(r.query_id % 100, *r[1:]) for r in found if r.query_id // 100 == k} for k in range(2))
    assert asked == [25] and first == again and first


def test_equal_questions_are_sorted_once_and_the_cover_is_made_once(spark, monkeypatch):
    sorted_rows, made, look_up = [], spark.sparkContext.accumulator(0), timetable_queries.asof.asof_next

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    cover = spark.createDataFrame([("N1", "N2", 60, 90, "t", False), ("N1", "N2", 0, 45, "w", True), ("N1", "N3", 70, 95, "t", False), ("N3", "N1", 0, 20, "w", True)], "o string, d string, dep int, arr int, trip_id string, is_flex boolean")
    monkeypatch.setattr(timetable_queries, "cover_of", lambda g: cover.mapInPandas(counted, cover.schema))
    monkeypatch.setattr(timetable_queries.asof, "asof_next", lambda left, *more, **how: sorted_rows.append(left.count()) or look_up(left, *more, **how))
    times = [("N1", 50), ("N1", 40), ("N3", 50), ("N9", 50)]
    asked = spark.createDataFrame([(10 * k + n, *x) for k in range(3) for n, x in enumerate(times)], "query_id long, stop string, at int")
    for name in ("questions", "every_question"):
        monkeypatch.setattr(timetable_queries, name, lambda s: asked, raising=False)
    found = timetable_queries.QUERIES["d6_best_next"](spark, SF).collect()
    steps = {0: {("N2", 60, 90, "t", False), ("N3", 70, 95, "t", False)}, 1: {("N2", 40, 85, "w", True), ("N3", 70, 95, "t", False)}, 2: {("N1", 50, 70, "w", True)}}
    assert len(found) == 15 and {tuple(r) for r in found} == {(10 * k + n, *x) for k in range(3) for n, of in steps.items() for x in of}
    assert sum(sorted_rows) == 5 and made.value == 4


def test_an_order_at_two_stops_has_one_best_step(spark, monkeypatch):
    cover = spark.createDataFrame([("N1", "N3", 60, 90, "t", False), ("N2", "N3", 0, 20, "w", True), ("N2", "N4", 0, 20, "w", True)], "o string, d string, dep int, arr int, trip_id string, is_flex boolean")
    asked = spark.createDataFrame([(1, "N1", 50), (1, "N2", 50), (1, "N2", 50), (2, "N1", 50), (None, "N2", None)], "query_id long, stop string, at int")
    monkeypatch.setattr(timetable_queries, "cover_of", lambda g: cover)
    for name in ("questions", "every_question"):
        monkeypatch.setattr(timetable_queries, name, lambda s: asked, raising=False)
    walks = [(1, "N3", 50, 70, "w", True), (1, "N4", 50, 70, "w", True), (None, "N3", None, None, "w", True), (None, "N4", None, None, "w", True)]
    for name in ("d6_best_next", "d6_best_next_all"):
        found = timetable_queries.QUERIES[name](spark, SF).collect()
        assert sorted(map(tuple, found), key=repr) == sorted([*walks, (2, "N3", 60, 90, "t", False)], key=repr)


def test_saved_tables_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    kind = "trip_id string, stop_id string, stop_sequence int, arrival int, departure int"
    times = spark.createDataFrame([("t", "a", 1, 0, 5), ("t", "b", 2, 360_000, 360_001)], kind).mapInPandas(counted, kind)
    g = demo.feed(spark, SF)
    gtfs.save_feed(g.with_(stop_times=times, routes=g.routes.limit(0), calendar=None), f"{tmp_path}/feed")
    assert made.value == 2
    assert sorted(os.listdir(f"{tmp_path}/feed")) == ["calendar.txt", "directions.txt", "stop_times.txt", "stops.txt", "trips.txt"]
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/feed/stop_times.txt").filter("value like 't,%'").collect())
    assert lines == ["t,a,1,00:00:00,00:00:05", "t,b,2,100:00:00,100:00:01"]


def test_stop_times_are_parsed_once_for_the_day_and_the_feed(spark, monkeypatch):
    kept, write = [], exchange_queries.gtfs.save_feed
    monkeypatch.setattr(exchange_queries.gtfs, "save_feed", lambda f, folder: kept.append(f.stop_times) or write(f, folder))
    found = {r.name: r.services for r in exchange_queries.QUERIES["m2_calendar_problems"](spark, SF).collect()}
    assert found == {"day": 0, "feed": 6} and len(kept) == 2
    assert not any("lineitem" in name for df in kept for name in df.inputFiles())


def test_edited_steps_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = [("a", "b", 0, 5, "t", False), ("b", "c", 6, 9, "t", False), ("a", "c", 0, 20, "w", True)]
    kind = "o string, d string, dep int, arr int, trip_id string, is_flex boolean"
    steps = lambda: spark.createDataFrame(rows, kind).mapInPandas(counted, kind)
    graph.required_edge(steps(), "a", "b").collect()
    assert made.value == len(rows)
    graph.edited(steps(), [("forbid", "a", "c"), ("require", "a", "b")])[0].select(F.max("arr")).collect()
    assert made.value == 2 * len(rows)
