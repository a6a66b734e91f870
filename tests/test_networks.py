"""Networks of many specs and dates against networks built alone, and profiles by work chunks."""

import pytest
from pyspark.sql import functions as F

from tests.test_network import STEP, network
from tests.test_questions import small  # noqa: F401
from tramline.operators import feed, networks, profiles, services, steps
from tramline.plans import demo

KEY = ["o", "d", "dep", "arr", "is_flex"]
SPECS = [(0, ["BA:"], 0, 500.0, 1.0, 36 * 3600), (1, ["CT:", "SC:"], 1, 350.0, 2.0, 28 * 3600), (2, [], 0, 400.0, 0.0, 20 * 3600)]
REQUIRED = {0: ["N0", "N4", "N11"], 1: ["N1", "N5", "N12"], 2: ["N2", "N9"]}


def test_networks_equal_those_built_alone(spark, small):  # noqa: F811
    g = demo.feed(spark, small)
    specs = spark.createDataFrame(SPECS, "spec_id int, prefixes array<string>, later int, max_walk double, speed double, until int")
    required = spark.createDataFrame([(k, s) for k, x in REQUIRED.items() for s in x], "spec_id int, stop_id string")
    dates = services.date_range(spark, "20250717", 3)
    found = networks.prepared_networks(specs, required, dates, g).cache()
    instances = {(r.spec_id, r.date): r.duplicate_of for r in networks.patterns(specs, dates, g).collect()}
    assert len(instances) == 9 and any(instances.values())
    assert {(r.spec_id, r.date): r.duplicate_of for r in found.select("spec_id", "date", "duplicate_of").distinct().collect()}.items() <= instances.items()
    rows = {}
    for r in found.collect():
        rows.setdefault((r.spec_id, r.date), []).append(tuple(r[c] for c in KEY))
    for spec, prefixes, later, limit, speed, until in SPECS[:2]:
        for date in ("20250718",):
            day = feed.normalized(feed.by_prefixes(feed.service_days(g, date, later), prefixes))
            every = steps.from_stop_times(day.stop_times).unionByName(steps.walking(day.stops, limit, speed))
            stops = required.filter(F.col("spec_id") == spec).select("stop_id")
            alone = profiles.closure(every, stops, stops, window=(0, until, until)).filter("not thru").join(stops.withColumnRenamed("stop_id", "d"), "d", "left_semi")
            assert sorted(rows.get((spec, date), [])) == sorted(tuple(r) for r in alone.select(*KEY).collect())
    # A date that repeats another one has that one's network.
    for (spec, date), other in instances.items():
        if other:
            assert sorted(rows.get((spec, date), [])) == sorted(rows.get((spec, other), []))


def test_chunks_make_the_same_profile(spark):
    df = spark.createDataFrame(network(41, stops=5, rides=150, walks=3), STEP)
    origins = spark.createDataFrame([("s0",), ("s3",)], "stop_id string")
    whole = profiles.closure(df, origins, window=(300, 2500, 2200))
    parts = profiles.closure(df, origins, window=(300, 2500, 400))
    rows = lambda x: sorted(tuple(r) for r in x.select(*KEY).collect())
    assert rows(parts) == rows(whole)
    timed = parts.select("o", "d", *[F.col(c).alias(f"old_{c}") for c in KEY[2:]], *profiles.run_times(F.col("legs")))
    assert timed.filter("dep <> old_dep or arr <> old_arr or is_flex <> old_is_flex").count() == 0


def test_empty_windows_raise(spark):
    df = spark.createDataFrame([("a", "b", 0, 5, "t", False)], STEP)
    with pytest.raises(ValueError):
        profiles.closure(df, window=(10, 10, 5))
