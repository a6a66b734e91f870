"""Earliest arrivals at destinations and from profiles, against a plain search."""

import random

import pytest

from tests.test_network import STEP, dijkstra, network
from tramline.operators import profiles


@pytest.fixture(scope="module")
def rows():
    return network(31, stops=6, rides=150, walks=3)


def test_arrivals_from_profiles(spark, rows):
    rng = random.Random(1)
    asked = [(i, f"s{rng.randrange(6)}", rng.randrange(0, 3800)) for i in range(60)] + [(60, "nowhere", 5)]
    got = {}
    for r in profiles.arrivals_from_profiles(spark.createDataFrame(asked, "query_id int, stop string, at int"), profiles.closure(spark.createDataFrame(rows, STEP))).collect():
        got.setdefault(r.query_id, {})[r.stop] = r.at
    assert got == {i: dijkstra(rows, s, t) for i, s, t in asked}


def test_arrivals_at_destinations(spark, rows):
    rng, sets = random.Random(2), {0: {"s1", "s4"}, 1: {"s5"}, 2: {"s0", "s2", "s3", "nowhere"}}
    asked = [(i, rng.randrange(3), f"s{rng.randrange(6)}", rng.randrange(0, 3800)) for i in range(60)]
    targets = spark.createDataFrame([(k, s) for k, x in sets.items() for s in x], "set_id int, stop_id string")
    found = profiles.arrivals_to(spark.createDataFrame(asked, "query_id int, set_id int, stop string, at int"), targets, spark.createDataFrame(rows, STEP)).collect()
    want = {(i, s): t for i, k, stop, at in asked for s, t in dijkstra(rows, stop, at).items() if s in sets[k]}
    assert {(r.query_id, r.stop): r.at for r in found} == want and len(found) == len(want)
    assert all(1 <= r.seen <= len(sets[asked[r.query_id][1]]) for r in found)


def test_equal_arrivals_prefer_more_destinations(spark):
    steps = [("a", "x", 0, 5, "1", False), ("x", "z", 6, 20, "2", False), ("a", "z", 1, 20, "3", False), ("z", "x", 0, 0, "w", True), ("x", "y", 0, 0, "w", True), ("y", "x", 0, 0, "w", True)]
    targets = spark.createDataFrame([(0, "x"), (0, "z"), (0, "y")], "set_id int, stop_id string")
    found = profiles.arrivals_to(spark.createDataFrame([(1, 0, "a", 0)], "query_id int, set_id int, stop string, at int"), targets, spark.createDataFrame(steps, STEP))
    assert sorted(tuple(r)[1:] for r in found.collect()) == [("x", 5, 2), ("y", 5, 2), ("z", 20, 3)]


def test_many_queries_keep_no_rows_of_their_own_in_rounds(spark, rows, monkeypatch):
    rng, sets, kept = random.Random(3), {0: {"s1", "s4"}, 1: {"s5"}, 2: {"s0", "nowhere"}}, []

    def counted(df):
        kept.append((out := cut(df)).count())
        return out

    cut = profiles.cut
    monkeypatch.setattr(profiles, "cut", counted)
    asked = [(i, i % 3, f"s{rng.randrange(6)}", rng.randrange(0, 3800)) for i in range(2000)]
    queries = spark.createDataFrame(asked, "query_id int, set_id int, stop string, at int")
    steps = spark.createDataFrame(rows, STEP)
    ways = [dijkstra(rows, stop, at) for _, _, stop, at in asked]
    found = profiles.earliest_arrivals(queries.drop("set_id"), steps).collect()
    want = {(i, s): t for (i, *_), way in zip(asked, ways) for s, t in way.items()}
    assert {(r.query_id, r.stop): r.at for r in found} == want and len(found) == len(want)
    targets = spark.createDataFrame([(k, s) for k, x in sets.items() for s in x], "set_id int, stop_id string")
    found = profiles.arrivals_at(queries, targets, steps).collect()
    want = {(i, s): t for (i, k, *_), way in zip(asked, ways) for s, t in way.items() if s in sets[k]}
    assert {(r.query_id, r.stop): r.at for r in found} == want and len(found) == len(want)
    # Rounds keep paths, and the queries are kept as they are; before, each round kept a row a query and stop.
    assert max(kept) <= len(asked)


def test_closed_times_are_those_of_the_closure(spark, rows):
    steps, origins = spark.createDataFrame(rows, STEP), spark.createDataFrame([("s0",), ("s3",)], "stop_id string")
    for some in (None, origins):
        got, want = profiles.closed_times(steps, some), profiles.closure(steps, some).select("o", "d", "dep", "arr", "is_flex")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
