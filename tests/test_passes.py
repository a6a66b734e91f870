"""How often the rows of the large tables are gone through."""

import pytest

from tramline.operators import feed
from tramline.plans import demo

SF = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark):
    """(the derived timetable, its number of stop times, an accumulator of the stop times read)."""
    read, g = spark.sparkContext.accumulator(0), demo.feed(spark, SF)

    def pass_on(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    times = g.stop_times.toPandas()
    kind = g.stop_times.schema
    return g.with_(stop_times=spark.createDataFrame(times, kind).mapInPandas(pass_on, kind)), len(times), read


def test_a_span_reads_stop_times_once_for_all_its_days(counted):
    g, n, read = counted
    found = feed.world(g, demo.DATE, ["BA:"], 1).stop_times.collect()
    assert found and read.value == n


def test_used_services_read_stop_times_once(counted):
    from tramline.plans import path_queries

    g, n, read = counted
    found = {r.day: r.services for r in path_queries.used_services_of(g).collect()}
    assert found == {0: "S0,S3", 1: "S3"} and read.value == n


def test_steps_of_a_prefix_read_stop_times_once(counted):
    from tramline.plans.timetable_queries import ba_steps

    g, n, read = counted
    found = ba_steps(g).collect()
    assert {r.is_flex for r in found} == {True, False} and read.value == n


def test_transfer_edges_read_stop_times_once(counted):
    from tramline.operators import graph
    from tramline.plans.timetable_queries import parted

    g, n, read = counted
    edges = graph.transfer_edges(parted(g))
    assert edges.count() and graph.remapped_edges(edges, graph.merged_states(edges)).count() and read.value == n


def test_networks_read_stop_times_once_and_deal_only_the_cover(spark, counted):
    from pyspark.sql import functions as F

    from tramline.operators import networks, services, steps
    from tramline.plans.network_queries import specs_of

    g, n, read = counted
    specs, days = specs_of(spark), services.date_range(spark, "20250714", 7)
    found = networks.patterns(specs, days, g).filter("duplicate_of is null").cache()
    every = networks.keyed_steps(found, specs, g).cache()
    rides = every.filter("not is_flex")
    assert rides.count() and read.value == n
    # A day of one service keeps nothing that another of its rides replaces.
    one = rides.join(found.filter("spec_id = 1").select(*networks.NET, F.array_distinct(F.flatten("pattern")).alias("of")).filter("size(of) = 1"), networks.NET)
    assert one.count() == steps.minimal_cover(one, (*networks.NET, "o", "d")).count() > 0
