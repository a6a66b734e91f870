"""Steps, connections, profiles, graphs and tours on seeded random networks, against plain programs."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tramline.operators import asof, catalog, graph, legs, profiles, steps, tours

STEP = "o string, d string, dep int, arr int, trip_id string, is_flex boolean"


def network(seed, stops=6, rides=120, walks=4):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(stops)]
    rows = []
    for i in range(rides):
        a, b = rng.sample(names, 2)
        dep = rng.randrange(0, 3600)
        rows.append((a, b, dep, dep + rng.randrange(1, 600), f"t{i:03d}", False))
    for _ in range(walks):
        a, b = rng.sample(names, 2)
        w = rng.randrange(60, 900)
        rows += [(a, b, 0, w, f"w:{a}:{b}", True), (b, a, 0, w, f"w:{b}:{a}", True)]
    return rows


def dijkstra(rows, stop, at):
    best, queue = {}, [(at, stop)]
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    while queue:
        t, s = heapq.heappop(queue)
        if s in best:
            continue
        best[s] = t
        for _, d, dep, arr, _, flex in out[s]:
            if flex or dep >= t:
                heapq.heappush(queue, (t + arr - dep if flex else arr, d))
    return best


def naive_cover(rows):
    kept = set()
    for r in rows:
        rides = [x for x in rows if x[:2] == r[:2] and not x[5]]
        walks = [x for x in rows if x[:2] == r[:2] and x[5]]
        short = min((x[3] - x[2] for x in walks), default=10**9)
        if r[5]:
            if (r[3] - r[2], r[4]) == (short, max(x[4] for x in walks if x[3] - x[2] == short)):
                kept.add(r)
        elif r[3] - r[2] < short and not any(x[2] >= r[2] and x[3] <= r[3] and (x[2:4] != r[2:4] or x[4] > r[4]) for x in rides):
            kept.add(r)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_minimal_cover(spark, seed):
    rows = network(seed, stops=3, rides=60)
    df = spark.createDataFrame(rows, STEP)
    cover = steps.minimal_cover(df)
    assert {tuple(r) for r in cover.select("o", "d", "dep", "arr", "trip_id", "is_flex").collect()} == naive_cover(rows)
    assert steps.out_of_order(cover).count() == 0
    rides = df.filter("not is_flex")
    assert steps.minimal_cover(rides).count() == rides.count() - steps.dominated(rides).count()


def test_walking_grid(spark):
    deg = 300 / 111_000.0
    import math

    rows = [(f"g{i}{j}", 37.0 + i * deg, -122.0 + j * deg / math.cos(math.radians(37))) for i in range(3) for j in range(3)]
    found = steps.walking(spark.createDataFrame(rows, "stop_id string, stop_lat double, stop_lon double"))
    lengths = [r.arr for r in found.collect()]
    assert len(lengths) == 40 and set(lengths) <= {299, 300, 424}
    assert steps.walking(spark.createDataFrame(rows, "stop_id string, stop_lat double, stop_lon double"), speed=0).count() == 0


def test_stop_times_to_steps(spark):
    rows = spark.createDataFrame([("t", "a", 1, 10, 20), ("t", "b", 5, 50, 60), ("t", "c", 9, 90, 95), ("u", "a", 1, 0, 1)], "trip_id string, stop_id string, stop_sequence int, arrival int, departure int")
    assert sorted(tuple(r)[:5] for r in steps.from_stop_times(rows).collect()) == [("a", "b", 20, 50, "t"), ("b", "c", 60, 90, "t")]


@pytest.mark.parametrize("seed", [3, 4])
def test_connections(spark, seed):
    rows = network(seed, stops=4, rides=80, walks=3)
    cover = naive_cover(rows)
    one = [r for r in cover if r[0] == "s0"]
    every = []
    for a in one:
        for b in cover:
            if a[1] == b[0] and b[1] != "s0":
                if a[5] and b[5]:
                    every.append(("s0", b[1], 0, a[3] + b[3], "", True))
                elif a[5]:
                    every.append(("s0", b[1], b[2] - a[3], b[3], "", False))
                elif b[5]:
                    every.append(("s0", b[1], a[2], a[3] + b[3], "", False))
                elif b[2] >= a[3]:
                    every.append(("s0", b[1], a[2], b[3], "", False))
    expected = {r[:4] + (r[5],) for r in naive_cover(list(set(every)))}
    df = steps.minimal_cover(spark.createDataFrame(rows, STEP))
    got = asof.connections(df.filter("o = 's0'"), df).select("o", "d", "dep", "arr", "is_flex")
    assert {tuple(r) for r in got.collect()} == expected


@pytest.mark.parametrize("seed", [5, 6])
def test_earliest_arrivals_and_reduction(spark, seed):
    rows = network(seed)
    df = spark.createDataFrame(rows, STEP)
    rng = random.Random(seed)
    asked = [(i, f"s{rng.randrange(3)}", rng.randrange(0, 3600)) for i in range(25)]
    queries = spark.createDataFrame(asked, "query_id int, stop string, at int")
    got = defaultdict(dict)
    for r in profiles.earliest_arrivals(queries, df).collect():
        got[r.query_id][r.stop] = r.at
    assert all(got[i] == dijkstra(rows, s, t) for i, s, t in asked)

    required = spark.createDataFrame([("s0",), ("s1",), ("s2",)], "stop_id string")
    small = profiles.reduced(df, required, until=10**6).select("o", "d", "dep", "arr", F.lit("p").alias("trip_id"), "is_flex")
    assert profiles.probe(df, small, queries, required).count() == 0
    # A reduced network reduces to itself, and each path's legs give its times.
    again = profiles.reduced(small, required, until=10**6)
    key = ["o", "d", "dep", "arr", "is_flex"]
    assert sorted(map(str, again.select(*key).collect())) == sorted(map(str, small.select(*key).collect()))
    paths = profiles.reduced(df, required, until=10**6)
    redone = paths.select("o", "d", *[F.col(c).alias(f"old_{c}") for c in key[2:]], *profiles.run_times(F.col("legs")))
    assert redone.filter("dep <> old_dep or arr <> old_arr or is_flex <> old_is_flex").count() == 0
    rows_of = paths.withColumn("path_id", F.monotonically_increasing_id())
    timed = legs.walks_in_sequence(legs.exploded(rows_of))
    assert legs.broken(timed).count() == 0
    late = legs.walks_at_last_moment(legs.exploded(rows_of.filter("not is_flex")))
    assert legs.broken(late.filter("dep > 0 or not is_flex")).count() == 0


def test_split_and_goodness(spark):
    df = spark.createDataFrame([("a", "h", 0, 10, "1", False), ("b", "h", 0, 20, "2", False), ("h", "c", 30, 40, "3", False), ("h", "d", 30, 50, "4", False)], STEP)
    required = spark.createDataFrame([(x,) for x in "abcd"], "stop_id string")
    paths = profiles.reduced(df, required)
    assert paths.count() == 4
    assert {r.stop: r.goodness for r in profiles.stop_goodness(paths).collect()}["h"] == 0
    parts = profiles.split_at(paths, "h")
    assert {(r.o, r.d, r.dep, r.arr) for r in parts.collect()} == {("a", "h", 0, 10), ("b", "h", 0, 20), ("h", "c", 30, 40), ("h", "d", 30, 50)}


def test_graphs(spark):
    edges = [("a", "b", 4), ("b", "c", 1), ("a", "c", 2), ("c", "d", 7), ("e", "f", 3)]
    df = spark.createDataFrame(edges, "o string, d string, w int")
    dist = {(r.src, r.stop): r.dist for r in graph.distances(df, spark.createDataFrame([("a",)], "stop_id string")).collect()}
    assert dist == {("a", "a"): 0, ("a", "b"): 4, ("a", "c"): 2, ("a", "d"): 9}
    tree = graph.spanning_tree(graph.undirected_edges(df))
    assert {tuple(r) for r in tree.collect()} == {("b", "c", 1), ("a", "c", 2), ("c", "d", 7), ("e", "f", 3)}
    assert {r[0] for r in graph.tree_leaves(tree).collect()} == {"a", "b", "d", "e", "f"}
    roots = {r.node: r.root for r in graph.connected_components(df, "o", "d").collect()}
    assert roots == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}


def test_tours_against_all_orders(spark):
    rows = network(11, stops=4, rides=160, walks=2)
    df = spark.createDataFrame(rows, STEP)
    names = ["s0", "s1", "s2", "s3"]
    required = spark.createDataFrame([(x,) for x in names], "stop_id string")
    paths = profiles.reduced(df, required, until=10**6, complete=True).cache()
    every = tours.evaluated(tours.orders(spark, names), paths)
    cost = {r.tour_id: r.m for r in every.groupBy("tour_id").agg(F.min(F.col("arr") - F.col("dep")).alias("m")).collect()}
    found = tours.shortest_tour(names, paths).collect()
    assert found and {r.duration for r in found} == {min(cost.values())}
    base = spark.createDataFrame([("t", ["s0", "s1", "s2"])], "tour_id string, stops array<string>")
    put = tours.best_insertions(base, required.filter("stop_id = 's3'"), paths).first()
    assert put.duration == min(cost[">".join(x)] for x in (["s0", "s3", "s1", "s2"], ["s0", "s1", "s3", "s2"]) if ">".join(x) in cost)
    groups = required.withColumn("rep", F.col("stop_id"))
    stops, duration, whole = tours.lazy_tour(groups, paths, ["s0", "s1"])
    assert whole and set(stops) == set(names) and duration <= min(cost.values())


def test_catalog(spark):
    wanted = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 3)], "id int, x string, y int")
    stored = spark.createDataFrame([(1, "a", None), (2, "b", 5), (4, "d", 4)], "id int, x string, y int")
    assert {tuple(r) for r in catalog.sync_actions(wanted, stored, "id").collect()} == {(1, "unchanged", ""), (2, "updated", "y"), (3, "inserted", ""), (4, "deleted", "")}
    doc = '{"name":"run","start":0,"duration":10,"children":[{"name":"a","start":1,"duration":2,"children":[{"name":"b","start":1,"duration":1}]},{"name":"c","start":4,"duration":5}]}'
    rows = catalog.flattened_trace(spark.createDataFrame([(7, doc)], "run_id int, document string")).orderBy("path").collect()
    assert [(r.path, r.depth, r.name) for r in rows] == [("", 0, "run"), ("/0000", 1, "a"), ("/0000/0000", 2, "b"), ("/0001", 1, "c")]
    spans = catalog.span_positions(spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 2.0)], "run_id int, start double, duration double"))
    assert sorted((r.left, r.width) for r in spans.collect()) == [(0.0, 100.0), (50.0, 20.0)]


def test_entry_imports_without_llm(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("tramline.llm") or name == "corpus_pipeline" else found(name, *a))
    names = set(entry.queries())
    assert "e3_minimal_cover" in names and not any(n.startswith("op") for n in names)
    assert set(entry.oracle_sql()) <= names
