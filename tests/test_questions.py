"""Queries that answer every order and every origin, against plain programs over all of them."""

import random
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.test_network import dijkstra
from tramline.plans import demo, timetable_queries
from tramline.plans.timetable_queries import QUERIES, ba_steps, cover_of, steps_of


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """120 orders over 25 nations, 60 suppliers."""
    rng, at = random.Random(21), tmp_path_factory.mktemp("small")
    lines = [(k, n, rng.randrange(1, 400), rng.randrange(60)) for k in range(1, 121) for n in range(rng.randrange(2, 7))]
    tables = {
        "orders": {"o_orderkey": range(1, 121), "o_custkey": [rng.randrange(200) for _ in range(120)], "o_orderpriority": [rng.choice("ABC") for _ in range(120)]},
        "lineitem": {"l_orderkey": [x[0] for x in lines], "l_linenumber": [x[1] for x in lines], "l_partkey": [x[2] for x in lines], "l_suppkey": [x[3] for x in lines]},
        "nation": {"n_nationkey": range(25), "n_name": [f"nation {i}" for i in range(25)]},
        "supplier": {"s_suppkey": range(60), "s_name": [f"supplier {i}" for i in range(60)], "s_nationkey": [rng.randrange(25) for _ in range(60)]},
    }
    for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax"):
        tables["lineitem"][c] = [0.0] * len(lines)
    tables["lineitem"]["l_shipdate"] = ["1995-01-01"] * len(lines)
    for name in demo.TABLES:
        pq.write_table(pa.table({k: list(v) for k, v in tables.get(name, {"unused": [0]}).items()}), at / f"{name}.parquet")
    return f"file://{at}"


def _asked(spark):
    return {r.query_id: (r.stop, r.at) for r in timetable_queries.every_question(spark).collect()}


def test_every_order_is_asked(spark, small):
    found = defaultdict(dict)
    for r in QUERIES["i4_earliest_arrivals"](spark, small).collect():
        assert r.stop not in found[r.query_id]
        found[r.query_id][r.stop] = r.at
    asked = _asked(spark)
    rows = [tuple(r) for r in ba_steps(demo.feed(spark, small)).select("o", "d", "dep", "arr", "trip_id", "is_flex").collect()]
    assert len(asked) == 120 and found == {q: dijkstra(rows, *a) for q, a in asked.items()}


def test_next_steps_of_every_order(spark, small):
    got = {(r.query_id, r.d): (r.stop, r.at, r.arr) for r in QUERIES["d7_next_departure_all"](spark, small).collect()}
    best = {(r.id, r.d): r.arr for r in QUERIES["d6_best_next_all"](spark, small).collect()}
    asked, g = _asked(spark), demo.feed(spark, small)
    rides, cover = steps_of(g).collect(), cover_of(g).collect()
    first, least = {}, {}
    for q, (stop, at) in asked.items():
        for r in rides:
            if r.o == stop and r.dep >= at:
                first[q, r.d] = min(first.get((q, r.d), (stop, at, r.arr)), (stop, at, r.arr))
        for r in cover:
            if r.o == stop and (r.is_flex or r.dep >= at):
                arr = at + r.arr - r.dep if r.is_flex else r.arr
                least[q, r.d] = min(least.get((q, r.d), arr), arr)
    assert got == first and best == least
    # The other form of the query asks each order on its own.
    assert {(r.id, r.d): r.arr for r in QUERIES["d6_best_next"](spark, small).collect()} == best


def test_connections_of_every_origin(spark, small):
    found = QUERIES["d5_connections_all"](spark, small)
    cover = [r for r in cover_of(demo.feed(spark, small)).collect() if r.o != r.d]
    after, every = defaultdict(list), defaultdict(list)
    for r in cover:
        after[r.o].append(r)
    for a in cover:
        for b in after[a.d]:
            if b.d != a.o and (a.is_flex or b.is_flex or b.dep >= a.arr):
                long = a.arr - a.dep if a.is_flex else b.arr - b.dep
                flex = a.is_flex and b.is_flex
                dep, arr = (0, a.arr + b.arr) if flex else (b.dep - long, b.arr) if a.is_flex else (a.dep, a.arr + long) if b.is_flex else (a.dep, b.arr)
                every[a.o, b.d].append((dep, arr, flex))
    expected = set()
    for ends, rows in every.items():
        walk = min((arr for _, arr, flex in rows if flex), default=10**9)
        rides = {x for x in rows if not x[2] and x[1] - x[0] < walk}
        expected |= {(*ends, *x) for x in rides if not any(y != x and y[0] >= x[0] and y[1] <= x[1] for y in rides)}
        expected |= {(*ends, 0, walk, True)} if walk < 10**9 else set()
    got = [(r.o, r.d, r.dep, r.arr, r.is_flex) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len({x[0] for x in got}) > 15
