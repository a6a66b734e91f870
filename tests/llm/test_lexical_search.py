"""Ranked search, held against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from tramline.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    total, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in found:
            m = 75 + 25 * sum(c.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                rows.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(rows)[:20])]
    return sorted(out)


def fixture(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(80)] + ["École", "ñandú", "中文", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randrange(0, 50)))) for i in range(n)]
    docs += [(n + i, "t1 t2 T79, t79.") for i in range(30)] + [(n + 40, None), (n + 41, ""), (n + 42, "-- ..."), (n + 43, "t1 " * 4000 + "x" * 3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(25)]
    items += [(25, "t79 T2 t2"), (26, None), (27, "nothing here"), (28, "... !"), (29, "École É x")]
    return docs, items


def saved(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("leaf,shard,block", [(16, 16_384, 16_384), (2, 60, 16_384), (3, 200, 40)])
def test_op12_against_every_pair(spark, tmp_path, monkeypatch, leaf, shard, block):
    monkeypatch.setattr(ls, "LEAF", leaf)
    monkeypatch.setattr(ls, "SHARD_DOCS", shard)
    monkeypatch.setattr(ls, "BLOCK_TERMS", block)
    monkeypatch.setattr(ls, "PIECE", 100)
    docs, items = fixture(leaf, 250)
    assert sorted(map(tuple, ls.op12_lexical_search(spark, saved(spark, tmp_path, docs, items)).collect())) == plain(docs, items)


def test_sql_gives_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs, items = fixture(5, 120)
    path = saved(spark, tmp_path, docs, items)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(ls.SQL).fetchall()) == plain(docs, items)


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "c")], "k long, body string")
    items = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "d")], "q string, body string")
    found = sorted((r.item, r.rank, -1 if r.id is None else r.id) for r in ls.ranked(docs, items, "k", "body", "q", "body").collect())
    assert found == [("x", 1, -1), ("x", 1, -1), ("x", 2, 1), ("x", 2, 1), ("x", 3, 1), ("x", 3, 1)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.ranked(docs, items).collect() == []
    assert ls.ranked(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).collect() == []


def test_bounds_hold_below_every_node():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 300)
    ranks = np.concatenate([np.sort(rng.choice(30, n, replace=False)) for n in sizes])
    tree = ls.Tree(rng.integers(75, 300, 300), sizes, ranks, rng.integers(1, 9, len(ranks)), 30)
    for node in range(len(tree.low)):
        a, z = tree.to[tree.low[node]], tree.to[tree.high[node]]
        assert (tree.highest[node][tree.ranks[a:z]] >= tree.tfs[a:z]).all()
        assert tree.least[node] == tree.m[tree.low[node] : tree.high[node]].min()
        for child in tree.children[node]:
            assert tree.low[node] <= tree.low[child] < tree.high[child] <= tree.high[node]
    leaves = sorted((tree.low[n], tree.high[n]) for n in range(len(tree.low)) if not tree.children[n])
    assert leaves[0][0] == 0 and leaves[-1][1] == 300 and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
