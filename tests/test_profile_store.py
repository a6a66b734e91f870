"""The kept store of profiles, and networks with partitions by route, against plain programs."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_network import STEP, network
from tramline.operators import profile_store, profiles

KEY = ["o", "d", "dep", "arr", "is_flex"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*KEY).collect())


def stops_of(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "stop_id string")


def pairs_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "o string, d string")


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def test_only_missing_origins_are_closed(spark, folder, monkeypatch):
    df = spark.createDataFrame(network(51, stops=5, rides=80, walks=3), STEP)
    whole = rows(profiles.closure(df))
    expect = lambda *pairs: [r for r in whole if r[:2] in pairs]
    closed, plain = [], profiles.closure

    def spied(steps, origins=None, *args, **kwargs):
        closed.append(sorted(r.stop_id for r in origins.collect()))
        return plain(steps, origins, *args, **kwargs)

    monkeypatch.setattr(profiles, "closure", spied)
    first, more = [("s0", "s1"), ("s0", "s3"), ("s2", "s4")], [("s0", "s4"), ("s3", "s1"), ("s2", "s4")]
    assert rows(profile_store.kept_profiles(df, pairs_of(spark, *first), folder)) == expect(*first)
    assert rows(profile_store.kept_profiles(df, pairs_of(spark, *more, *more), folder)) == expect(*more)
    assert closed == [["s0", "s2"], ["s3"]]
    # Rows in another order are the same network; nothing is closed again.
    assert rows(profile_store.kept_profiles(df.orderBy(F.rand(3)), pairs_of(spark, *first, *more), folder)) == expect(*{*first, *more})
    assert len(closed) == 2
    # Another network has profiles of its own.
    fewer = df.filter("trip_id <> 't003'")
    found = rows(profile_store.kept_profiles(fewer, pairs_of(spark, ("s0", "s1")), folder))
    assert closed[2:] == [["s0"]] and found == [r for r in rows(plain(fewer)) if r[:2] == ("s0", "s1")]


def test_runs_that_did_not_end_are_not_read(spark, folder):
    df = spark.createDataFrame(network(52, stops=4, rides=40, walks=2), STEP)
    version = profile_store.network_version(df)
    wrong = profiles.closure(df).select(*KEY, "legs").withColumn("arr", F.col("arr") + 1).withColumn("part", profile_store._part("o"))
    wrong.write.partitionBy("part").parquet(f"{folder}/profiles/version={version}/run=lost")
    pair = ("s0", "s1")
    assert rows(profile_store.kept_profiles(df, pairs_of(spark, pair), folder)) == [r for r in rows(profiles.closure(df)) if r[:2] == pair]
    # An origin that two runs have closed is read from one of them.
    spark.createDataFrame([("s0",)], "o string").write.parquet(f"{folder}/origins/version={version}/run=zz")
    profiles.closure(df).select(*KEY, "legs").withColumn("part", profile_store._part("o")).write.partitionBy("part").parquet(f"{folder}/profiles/version={version}/run=zz")
    assert rows(profile_store.kept(pairs_of(spark, pair), folder, version)) == [r for r in rows(profiles.closure(df)) if r[:2] == pair]


def test_stops_without_rides_null_and_empty_pairs(spark, folder):
    df = spark.createDataFrame([("a", "b", 0, 5, "t", False)], STEP)
    assert rows(profile_store.kept_profiles(df, pairs_of(spark, ("b", "a"), (None, "b"), ("a", None)), folder)) == []
    version = profile_store.network_version(df)
    assert profile_store.complete(df, stops_of(spark, "b", "a"), folder) == 0  # b is known to lead nowhere
    assert rows(profile_store.kept(pairs_of(spark), folder, version)) == []
    assert rows(profile_store.kept(pairs_of(spark, ("a", "b")), folder, version)) == [("a", "b", 0, 5, False)]
    nothing = df.limit(0)
    assert rows(profile_store.kept_profiles(nothing, pairs_of(spark, ("a", "b")), folder)) == []


def routes_of(seed, data):
    """A route for most trips; the others are a route of their own."""
    rng = random.Random(seed)
    return {r[4]: f"r{rng.randrange(6)}" for r in data if not r[5] and rng.random() < 0.9}


@pytest.mark.parametrize("optimize", [False, True])
def test_partitions_are_those_of_the_rides(spark, optimize):
    data = network(53, stops=6, rides=150, walks=4)
    routes, need = routes_of(5, data), stops_of(spark, "s0", "s2", "s4", "elsewhere")
    df = spark.createDataFrame(data, STEP)
    net = profiles.routed_network(df, need, spark.createDataFrame(list(routes.items()), "trip_id string, route string"), optimize=optimize)
    stops = {r.id: (r.stop_id, r.role) for r in net.stops.collect()}
    parts = {r.part: r.route for r in net.partitions.collect()}
    assert sorted(stops) == list(range(1, len(stops) + 1)) and sorted(parts) == list(range(1, len(parts) + 1))
    assert [stops[len(stops) - 1], stops[len(stops)]] == [("START", "start"), ("END", "end")]
    assert {s for s, role in stops.values() if role == "required"} == {"s0", "s2", "s4"}
    plain = profiles.reduced(df, need)
    plain = profiles.fewer_edges(plain) if optimize else plain
    expected = [(r.o, r.d, r.dep, r.arr, r.is_flex) for r in plain.collect()]
    expected += [x for s in ("s0", "s2", "s4") for x in (("START", s, 0, 0, True), (s, "END", 0, 0, True))]
    found = net.steps.collect()
    assert sorted((stops[r.o_id][0], stops[r.d_id][0], r.dep, r.arr, r.is_flex) for r in found) == sorted(expected)
    seen = set()
    for r in found:
        rode = [routes.get(x.trip_id, x.trip_id) for x in r.legs or [] if not x.is_flex]
        assert (parts.get(r.o_part), parts.get(r.d_part)) == ((rode[0], rode[-1]) if rode else (None, None))
        seen.update(rode[:1] + rode[-1:])
    assert set(parts.values()) == seen


def test_equal_paths_stay_by_their_trips(spark):
    """Two ways with equal times: whatever the order of the rows, the last by its trips stays."""
    data = [("a", "m", 10, 20, "t1", False), ("m", "b", 25, 40, "t2", False), ("a", "n", 10, 21, "t3", False), ("n", "b", 22, 40, "t4", False)]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(data, 4), STEP)
        net = profiles.routed_network(df, stops_of(spark, "a", "b"), spark.createDataFrame([], "trip_id string, route string"))
        assert sorted(r.route for r in net.partitions.collect()) == ["t3", "t4"]
        assert net.steps.filter("not is_flex").count() == 1


def test_empty_network(spark):
    net = profiles.routed_network(spark.createDataFrame([], STEP), stops_of(spark, "a"), spark.createDataFrame([], "trip_id string, route string"))
    assert net.steps.count() == 0 and net.partitions.count() == 0
    assert sorted(r.stop_id for r in net.stops.collect()) == ["END", "START"]
