"""Paths, documents and look-ups: what raises, what stays apart, and keys with very many rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tramline.operators import asof, catalog, graph, paths, profiles, required, steps
from tramline.operators.components import connected_components
from tramline.sources import documents, gtfs

STEP = "o string, d string, dep int, arr int, trip_id string, is_flex boolean"


def test_asof_in_pieces_of_time(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), rng.randrange(1000)) for i in range(200)] + [(900, None, 5), (901, "a", None)]
    right = [(rng.choice("ab"), rng.randrange(0, 1000, 37), rng.randrange(5)) for _ in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, at int, v int")
    want = {i: min(((at, v) for kk, at, v in right if kk == k and t is not None and at >= t), default=(None, None)) for i, k, t in left}
    later = {i: min(((at, v) for kk, at, v in right if kk == k and t is not None and at > t), default=(None, None)) for i, k, t in left}
    for span in (None, 1, 50, 5000):
        for strict, wanted in ((False, want), (True, later)):
            found = asof.asof_next(a, b, ["k"], "t", "at", ["v"], strict, span)
            assert {r.i: (r.next_at, r.next_v) for r in found.collect()} == wanted


def test_one_key_with_very_many_rows(spark):
    """A window that looks at all rows after each would need minutes for these."""
    n = 200_000
    rides = spark.range(n).select(F.lit("a").alias("o"), F.lit("b").alias("d"), (F.col("id") % 86_400).cast("int").alias("dep"), (F.col("id") % 86_400 + 100 + F.col("id") % 7).cast("int").alias("arr"), F.col("id").cast("string").alias("trip_id"), F.lit(False).alias("is_flex"))
    began = time.time()
    cover = steps.minimal_cover(rides)
    assert 0 < cover.count() <= 86_400
    asked = spark.range(n).select(F.lit("a").alias("stop"), (F.col("id") % 90_000).cast("int").alias("at"))
    asof.asof_next(asked, rides.withColumnRenamed("o", "stop"), ["stop"], "at", "dep", ["arr"]).count()
    assert time.time() - began < 60


def test_paths_of_steps(spark):
    legs = spark.createDataFrame([("p", 1, "a", "b", 10, 20, "t", False), ("p", 2, "b", "c", 30, 40, "u", False), ("w", 1, "a", "c", 0, 50, "walk", True)], f"path_id string, pos int, {STEP}")
    whole = paths.of_legs(legs)
    assert {tuple(r)[:6] for r in whole.collect()} == {("p", "a", "c", 10, 40, False), ("w", "a", "c", 0, 50, True)}
    asked = spark.createDataFrame([("a", "c", 10, 40, False), ("a", "c", 7, 7, True)], "o string, d string, dep int, arr int, is_flex boolean")
    assert sorted(len(r.legs) for r in paths.with_paths(asked, whole).collect()) == [1, 2]
    with pytest.raises(Exception, match="no path for step"):
        paths.with_paths(asked.withColumn("dep", F.lit(11)).filter("not is_flex"), whole).collect()


def test_expanded_stops(spark):
    found = paths.expanded(spark.createDataFrame([("x", "a", "y"), ("y", "b", "z"), ("z", "c", "d")], "stop string, a string, b string"))
    assert {(r.stop, r.place): r.part for r in found.collect()} == {("x", 1): "a", ("x", 2): "b", ("x", 3): "c", ("x", 4): "d", ("y", 1): "b", ("y", 2): "c", ("y", 3): "d", ("z", 1): "c", ("z", 2): "d"}


def test_nearest_stop_of_a_lonely_one(spark):
    stops = spark.createDataFrame([("a", 37.0, -122.0), ("b", 37.0, -122.001), ("far", 38.0, -122.0)], "stop_id string, stop_lat double, stop_lon double")
    found = {r.stop_id: r.metres for r in steps.nearest_stop(stops).collect()}
    assert found.keys() == {"a", "b", "far"} and round(found["far"]) == 111_000
    assert steps.nearest_stop(stops.limit(1)).count() == 0


def test_components_of_hubs(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, rng.randrange(5001, 6000)) for _ in range(300)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root == (0 if n < 1000 else 1000 if n < 5000 else 5000) for n, root in found.items()) and len(found) == len({x for e in edges for x in e})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toml_that_is_none(spark):
    texts = spark.createDataFrame([("good", 'date = "20250718"\nn = [1, 2]'), ("bad", "= x"), ("none", None)], "name string, text string")
    rows = {r.name: r for r in documents.parsed_toml(texts).collect()}
    assert rows["good"].fields == {"date": "20250718", "n": "[1, 2]"} and rows["good"].problem is None
    assert rows["bad"].problem and rows["none"].fields == {}


def test_look_ups_and_groups(spark):
    stops = spark.createDataFrame([("1", "Main"), ("2", "Main"), ("3", "Lake")], "stop_id string, stop_name string")
    found = paths.looked_up(spark.createDataFrame([("Main",), ("Lake",), ("Sea",)], "name string"), stops)
    assert {tuple(r) for r in found.collect()} == {("Main", None, "ambiguous"), ("Lake", "3", None), ("Sea", None, "missing")}
    groups = spark.createDataFrame([("1", "g"), ("2", "g"), ("3", "h")], "stop_id string, rep string")
    assert {r.stop_id for r in required.only_groups_of(groups, stops.filter("stop_id = '1'")).collect()} == {"1", "2"}


def test_span_tree_and_back(spark):
    rows = [("r", "a", None, 0, "root", 0.0, 9.0), ("r", "b", "a", 1, "one", 1.0, 2.0), ("r", "c", "a", 1, "two", 4.0, 2.0), ("r", "d", "c", 2, 'deep "q"', 5.0, 1.0)]
    spans = spark.createDataFrame(rows, "run_id string, span_id string, parent_id string, depth int, name string, start double, duration double")
    flat = catalog.flattened_trace(documents.span_tree(spans, 3))
    assert sorted((r.path, r.depth, r.name, r.start) for r in flat.collect()) == [("", 0, "root", 0.0), ("/0000", 1, "one", 1.0), ("/0001", 1, "two", 4.0), ("/0001/0000", 2, 'deep "q"', 5.0)]
    with pytest.raises(RuntimeError):
        catalog.flattened_trace(documents.span_tree(spans, 3), 1)


def test_rounds_that_run_out_raise(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1), 1) for i in range(5)], "o string, d string, w int")
    with pytest.raises(RuntimeError):
        graph.distances(edges, spark.createDataFrame([("0",)], "stop_id string"), rounds=2)
    with pytest.raises(RuntimeError):
        rides = spark.createDataFrame([(str(i), str(i + 1), 10 * i, 10 * i + 5, "t", False) for i in range(5)], STEP)
        profiles.closure(rides, rounds=1)


def test_saved_day_has_no_calendar(spark, tmp_path):
    feed = gtfs.GtfsFeed.of(
        spark.createDataFrame([("a", 'A "quoted", name', 37.0, -122.0, "")], "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string"),
        spark.createDataFrame([("r", 0, "t", "s", "North")], gtfs.TRIPS),
        spark.createDataFrame([("s", *[True] * 7, "20250101", "20251231")], gtfs.CALENDAR),
        spark.createDataFrame([("t", "a", 1, "25:00:00", "25:00:30"), ("t", "a", 2, "", "")], "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string"),
        spark.createDataFrame([("r", "R", "Route", "", "")], gtfs.ROUTES),
    )
    gtfs.save_feed(feed, f"{tmp_path}/feed")
    found = gtfs.load_feed(spark, f"{tmp_path}/feed")
    assert found.stops.first()["stop_name"] == 'A "quoted", name' and found.stop_times.first()["arrival"] == 90_000 and found.calendar.count() == 1
    with pytest.raises(ValueError, match="empty calendar"):
        gtfs.load_day(spark, f"{tmp_path}/feed")
    gtfs.save_feed(feed.with_(calendar=None), f"{tmp_path}/day")
    assert gtfs.load_day(spark, f"{tmp_path}/day").trips.count() == 1
