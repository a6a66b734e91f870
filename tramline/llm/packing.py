"""Operator 2, packing: optimal length buckets, then batches within a token budget.

A histogram of the lengths of all documents is gathered, exact at any length. Its
size grows slowly: k distinct lengths need k * k / 2 tokens, so 100 TB of text have
some six million at most, three numbers each, as arrays on the driver. Dynamic
programming over it chooses at most `buckets` upper bounds that minimise the padding,
that is the sum of (bound - length). The best place of the last bucket never moves
back as lengths grow, so each round divides and conquers: d log d steps. Within a bucket every
document is padded to the bound, and a batch takes budget // bound documents (one
at least) in ascending id order.

Ranks inside a bucket are found without gathering it: rows are dealt by range of
(bucket, id), each range is numbered on its own, and the few counts per range
and bucket give the offsets.

Defined results: a null or empty text has length 0 and still takes a place in a
batch; among bounds with equal padding the dynamic programme takes the smaller
previous bound; rows of equal id are ordered by length and then by text hash; null ids
come first; fewer distinct lengths than buckets give fewer buckets; an empty
table gives an empty table; columns of docs other than id and text are not used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import WHITE, join_small, read_documents, table

BUCKETS = 8
BUDGET = 16_384


def word_count(text: Column) -> Column:
    """Words of a text: runs of other than the six white characters."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+", -1))).cast("long")


def best_bounds(sizes: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of the buckets with the least padding.

    sizes: the distinct lengths, ascending; counts and totals: documents and tokens
    of each. Cost of lengths (j, i] as one bucket: sizes[i] * documents - tokens.
    """
    d = len(sizes)
    if not d:
        return []
    docs, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(totals)])
    buckets = min(buckets, d)
    # best[i]: least cost of the first i lengths with at most k buckets; from_[k][i]: where the last one begins.
    best, came = sizes[np.arange(d)] * docs[1:] - tokens[1:], [np.zeros(d, np.int64)]
    for _ in range(1, buckets):
        before, now, at = np.concatenate([[0], best]), best.copy(), np.zeros(d, np.int64)
        todo = [(0, d - 1, 0, d - 1)]  # lengths, and the places where their last bucket may begin
        while todo:
            first, last, low, high = todo.pop()
            if first > last:
                continue
            i = (first + last) // 2
            j = slice(low, min(i, high) + 1)
            cost = before[j] + sizes[i] * (docs[i + 1] - docs[j]) - (tokens[i + 1] - tokens[j])
            at[i] = place = low + int(np.argmin(cost))
            now[i] = cost[place - low]
            todo += [(first, i - 1, low, place), (i + 1, last, place, high)]
        best = now
        came.append(at)
    bounds, i = [], d
    for at in reversed(came):
        if i:
            bounds.append(int(sizes[i - 1]))
            i = int(at[i - 1])
    return bounds[::-1]


def bounds_of(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The bucket bounds for a table with column n. A row for each distinct length reaches the driver, as Arrow columns."""
    found = lengths.groupBy("n").agg(F.count("*").alias("docs")).toArrow().sort_by("n")
    sizes, docs = (found.column(c).to_numpy().astype(np.int64) for c in ("n", "docs"))
    return best_bounds(sizes, docs, sizes * docs, buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """(id, n_tokens, bucket, bucket_length, batch, slot) for every row.

    length: the tokens of a row, the number of words if missing. batch counts from
    0 inside its bucket, slot from 0 inside its batch.
    """
    spark = docs.sparkSession
    plain = table(docs.select(F.col(id_col).alias("id"), (word_count(F.col(text_col)) if length is None else length).alias("n"), F.xxhash64(text_col).alias("tie")), "pack-lengths")
    bounds = bounds_of(plain, buckets)
    if not bounds:
        return plain.select("id", F.col("n").alias("n_tokens"), *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_length", "long"), ("batch", "long"), ("slot", "long"))])
    tops = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = plain.withColumn("bucket", F.size(F.filter(tops, lambda b: b < F.col("n"))))
    order = ["bucket", "id", "n", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(placed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "pack-ranges")
    counts = dealt.groupBy("bucket", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = table(counts.select("bucket", "part", before.alias("before")), "pack-offsets")
    own = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(*order[1:])) - 1
    ranked = join_small(dealt.withColumn("own", own), offsets, ["bucket", "part"], "inner")
    top = F.element_at(tops, F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(top, F.lit(1)))).cast("long")
    rank = (F.col("before") + F.col("own")).cast("long")
    return ranked.select("id", F.col("n").alias("n_tokens"), "bucket", top.alias("bucket_length"), F.floor(rank / room).cast("long").alias("batch"), (rank % room).cast("long").alias("slot"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def _sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same programme with one common table per bucket, over all pairs of lengths."""
    steps = ["c1 AS (SELECT i, top * docs - tokens AS cost, 0 AS j FROM p WHERE i > 0)"]
    for k in range(2, buckets + 1):
        steps.append(
            f"c{k} AS (SELECT i, CAST(k // 1000000 AS BIGINT) AS cost, CAST(k % 1000000 AS BIGINT) AS j FROM (SELECT p.i, min(CAST(b.cost + p.top * (p.docs - q.docs) - (p.tokens - q.tokens) AS HUGEINT) * 1000000 + q.i) AS k "
            f"FROM p JOIN p q ON q.i < p.i JOIN (SELECT 0 AS i, 0 AS cost UNION ALL SELECT i, cost FROM c{k - 1}) b ON b.i = q.i WHERE p.i > 0 GROUP BY p.i))"
        )
    walk = [f"e{buckets} AS (SELECT max(i) AS i FROM p)"]
    for k in range(buckets, 1, -1):
        walk.append(f"e{k - 1} AS (SELECT c.j AS i FROM c{k} c JOIN e{k} e ON c.i = e.i)")
    ends = " UNION ".join(f"SELECT p.top FROM e{k} e JOIN p ON p.i = e.i WHERE p.i > 0" for k in range(1, buckets + 1))
    return rf"""
WITH n AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
h AS (SELECT n AS top, count(*) AS docs, sum(n) AS tokens FROM n GROUP BY n),
p AS (SELECT row_number() OVER (ORDER BY top) AS i, top, CAST(sum(docs) OVER (ORDER BY top) AS BIGINT) AS docs, CAST(sum(tokens) OVER (ORDER BY top) AS BIGINT) AS tokens FROM h UNION ALL SELECT 0, 0, 0, 0),
{", ".join(steps)}, {", ".join(walk)},
tops AS ({ends}),
t AS (SELECT top, row_number() OVER (ORDER BY top) - 1 AS bucket FROM tops),
b AS (SELECT doc_id, n, (SELECT min(top) FROM t WHERE top >= n) AS top FROM n),
r AS (SELECT b.*, t.bucket, row_number() OVER (PARTITION BY b.top ORDER BY doc_id) - 1 AS rank, greatest(1, {budget} // greatest(b.top, 1)) AS room FROM b JOIN t USING (top))
SELECT doc_id, n AS n_tokens, CAST(bucket AS INTEGER) AS bucket, top AS bucket_length, CAST(rank // room AS BIGINT) AS batch, CAST(rank % room AS BIGINT) AS slot FROM r"""


SQL = _sql()
