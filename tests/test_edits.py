"""Lists of edits of a network against the ways along the stops they join."""

import pytest
from pyspark.sql import functions as F

from tests.test_network import STEP, naive_cover, network
from tramline.operators import graph, steps, tours


def test_three_edits_in_a_row(spark):
    rows = [r for r in network(51, stops=6, rides=260, walks=2) if (r[0], r[1]) != ("s5", "s0")]
    df = steps.minimal_cover(spark.createDataFrame(rows, STEP))
    found, parts = graph.edited(df, [("forbid", "s0", "s5"), ("require", "s1", "s2"), ("require", "s2", "s3"), ("forbid", "s4", "s1")])
    assert [tuple(r) for r in parts.orderBy("place").collect()] == [("s1+s2+s3", 1, "s1"), ("s1+s2+s3", 2, "s2"), ("s1+s2+s3", 3, "s3")]
    got = steps.minimal_cover(found).select("o", "d", "dep", "arr", "is_flex").collect()
    cover = naive_cover(rows)
    name = "s1+s2+s3"
    want = {(r[0], r[1], r[2], r[3], r[5]) for r in cover if not {r[0], r[1]} & {"s1", "s2", "s3"} and (r[0], r[1]) != ("s0", "s5")}
    want |= {(name, r[1], r[2], r[3], r[5]) for r in cover if r[0] == "s3" and r[1] in ("s0", "s4", "s5")}
    made = spark.createDataFrame([(x, [x, "s1", "s2", "s3"]) for x in ("s0", "s5")], "tour_id string, stops array<string>")
    ways = tours.evaluated(made, df, from_midnight=False).select("o", F.lit(name).alias("d"), "dep", "arr", "is_flex")
    assert {tuple(r) for r in got} == want | {tuple(r) for r in ways.collect()}


def test_edges_that_are_gone(spark):
    df = spark.createDataFrame([("a", "b", 0, 5, "t", False), ("b", "c", 6, 9, "t", False)], STEP)
    edits = [("require", "a", "b"), ("forbid", "a", "c")]
    assert graph.edited(df, edits)[0].select("o", "d").collect() == [("a+b", "c")]
    with pytest.raises(ValueError):
        graph.edited(df, [("require", "a", "b"), ("require", "a", "c")])
    with pytest.raises(ValueError):
        graph.edited(df, [("allow", "a", "b")])
