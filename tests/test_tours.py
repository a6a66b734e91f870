"""Tours: endings, insertions by meeting in the middle, one stop of every group, the farthest missing group."""

import itertools

import pytest
from pyspark.sql import functions as F

from tests.test_network import STEP, network
from tramline.operators import graph, profiles, tours


@pytest.fixture(scope="module")
def closed(spark):
    rows = network(21, stops=5, rides=200, walks=3)
    required = spark.createDataFrame([(f"s{i}",) for i in range(5)], "stop_id string")
    paths = profiles.reduced(spark.createDataFrame(rows, STEP), required, until=10**6, complete=True)
    return paths.select("o", "d", "dep", "arr", "is_flex").cache()


def made(spark, lists):
    return spark.createDataFrame([(f"t{i}", list(x)) for i, x in enumerate(lists)], "tour_id string, stops array<string>")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).distinct().collect())


def test_endings_equal_evaluated_suffixes(spark, closed):
    lists = [["s0", "s1", "s2", "s3", "s4"], ["s3", "s1", "s0"], ["s2", "s4"]]
    found = tours.endings(made(spark, lists), closed)
    for i, stops in enumerate(lists):
        for n in range(2, len(stops) + 1):
            want = tours.evaluated(made(spark, [stops[-n:]]), closed)
            got = found.filter(f"tour_id = 't{i}' and n = {n}")
            assert rows_of(got, "o", "d", "dep", "arr", "is_flex") == rows_of(want, "o", "d", "dep", "arr", "is_flex")


def test_mirrored_twice_is_the_same(closed):
    assert rows_of(tours.mirrored(tours.mirrored(closed)), *closed.columns) == rows_of(closed, *closed.columns)


@pytest.mark.parametrize("stops", [["s0", "s1"], ["s0", "s1", "s2"], ["s3", "s0", "s3", "s1", "s0", "s2", "s1", "s0"]])
def test_best_insertions_equal_whole_tours(spark, closed, stops):
    base, new = made(spark, [stops]), spark.createDataFrame([("s4",), ("s2",)], "stop_id string")
    tried = tours.insertions(base, new)
    cost = tours.evaluated(tried.select("tour_id", "stops"), closed).groupBy("tour_id").agg(F.min(F.col("arr") - F.col("dep")).alias("duration"))
    every = [tuple(r) for r in tried.join(cost, "tour_id").select("stop", "duration", "place").collect()]
    want = sorted(min(x for x in every if x[0] == s) for s in {x[0] for x in every})
    assert sorted(tuple(r) for r in tours.best_insertions(base, new, closed).select("stop", "duration", "place").collect()) == want


@pytest.mark.parametrize("groups,known", [({"s0": "a", "s1": "a", "s2": "b", "s3": "c", "s4": "c"}, None), ({"s0": "a", "s1": "b", "s2": "c", "s3": "d"}, None), ({"s0": "a", "s1": "b", "s2": "b", "s3": "c"}, 10**6)])
def test_one_stop_of_every_group(spark, closed, groups, known):
    reps = sorted(set(groups.values()))
    lists = [x for order in itertools.permutations(reps) for x in itertools.product(*[[s for s, r in groups.items() if r == rep] for rep in order])]
    ways = tours.evaluated(spark.createDataFrame([(">".join(x), list(x)) for x in lists], "tour_id string, stops array<string>"), closed)
    least = ways.agg(F.min(F.col("arr") - F.col("dep"))).first()[0]
    want = rows_of(ways.filter(F.col("arr") - F.col("dep") == least), "dep", "arr")
    df = spark.createDataFrame(list(groups.items()), "stop_id string, rep string")
    found = tours.shortest_group_tour(df, closed, known)
    assert rows_of(found, "dep", "arr") == want and {r.duration for r in found.collect()} == {least}
    assert all(sorted(groups[s] for s in r.stops) == reps for r in found.collect())


def test_group_tours_refuse_one_group(spark, closed):
    with pytest.raises(ValueError):
        tours.shortest_group_tour(spark.createDataFrame([("s0", "a")], "stop_id string, rep string"), closed)


def test_farthest_missing(spark):
    edges = spark.createDataFrame([("a", "b", 4), ("b", "c", 1), ("a", "d", 9), ("a", "e", 3), ("e", "x", 1)], "o string, d string, w int")
    apart = graph.distances(edges, spark.createDataFrame([(s,) for s in "abcdexz"], "stop_id string"))
    groups = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "C"), ("d", "D"), ("x", "D"), ("z", "Z")], "stop_id string, rep string")
    found = tours.farthest_missing(made(spark, [["a", "b"]]), groups, apart)
    assert sorted(map(tuple, found.collect())) == [("C", "c", 1), ("D", "x", 4), ("Z", "z", None)]
