"""Operator 5, nearest neighbours by collision counting.

Every vector is projected on `projections` random lines and each projection is
kept as a sorted array of its own (no compound hashes). A query's window on each
array is centred on its own projection and grows by virtual rehashing: radius
1, c, c^2, ... times the base width. A vector inside the query's window on at
least `threshold` arrays has collided often enough and is verified with its exact
inner product. A query stops growing once it has a share of the band to verify
(VERIFIED; a share, so recall does not fall as tables grow), or when its windows
cover the band. The README has the recall measured against brute force.

The largest inner product becomes the smallest distance by one more coordinate,
sqrt(M^2 - |x|^2); queries have 0 there and are brought to the length M. That
coordinate must not outweigh the others, so the vectors of a shard are cut by length
into bands (BAND), and M is the largest length of the band. Bands are asked from the
longest on; one whose bound |q| M can't beat the k-th score found is left out.

The index is dealt over shards by a hash of the id, so each shard holds about
`shard_rows` vectors whatever the table's size; the stated query set meets every
shard in blocks of `query_rows`. A vector is sent once for each block and a query once
for each shard, which is what a query set that grows with the table costs. Each (shard,
block) gives its k best per query, and these are ranked once more over all shards.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, as queries or as
candidates; rows that repeat a vec_id count one by one, as candidates and as queries
(rows that also have the same vector are one query), but a query never meets rows of its
own id; ties go to the smaller vec_id; with fewer than k candidates
all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import table

K = 20
PROJECTIONS = 96
SHARD_ROWS = 16_384
#: Queries that meet a shard in one group, and those whose windows are held together there.
QUERY_ROWS, HELD = 4_096, 1_024
#: Share of the arrays on which a vector must collide.
THRESHOLD = 0.6
#: Base width of a window, in lengths of the band, and growth of the radius.
WIDTH, GROWTH = 0.4, 1.25
#: The longest vector of a band is at most so many times longer than the shortest.
BAND = 1.1
#: Share of a band that is verified before a query may stop, and k times this at least.
VERIFIED = 0.15
#: Vectors that are verified at least, times k.
LEAST = 10
SEED = 5


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector takes part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return plain.filter(finite & F.exists("v", lambda x: x != 0))


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """The length of each row, also where squares leave the range of doubles."""
    top = np.maximum(np.abs(vectors).max(axis=1), np.finfo(float).tiny)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))


class Band:
    """The sorted arrays of the vectors of similar length in one shard, in units of the longest."""

    def __init__(self, vectors: np.ndarray, lines: np.ndarray):
        rest = np.sqrt(np.maximum(1 - (vectors**2).sum(1), 0))
        points = np.hstack([vectors, rest[:, None]]) @ lines
        points = np.ascontiguousarray(points.T)  # an array for each line
        order = np.argsort(points, axis=1, kind="stable")
        self.sorted = np.take_along_axis(points, order, axis=1)
        # ranks[j, i]: the place of vector i in the j-th sorted array.
        self.ranks = np.empty(order.shape, np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, order, np.arange(len(vectors), dtype=self.ranks.dtype)[None, :], axis=1)

    def candidates(self, at: np.ndarray, need: int, threshold: float):
        """Positions of the vectors to verify, query by query; at: the projections of the queries, brought to length 1."""
        m, n = self.ranks.shape
        bounds = []
        moved, inside, kind = np.empty_like(self.ranks), np.empty(self.ranks.shape, bool), np.uint8 if m < 256 else np.uint16

        def windows(i: int):
            """Begin and length of the windows of all queries at the i-th radius."""
            while len(bounds) <= i:
                radius = WIDTH * GROWTH ** len(bounds)
                left, right = (np.stack([np.searchsorted(self.sorted[j], at[:, j] + sign * radius, side) for j in range(m)], axis=1) for sign, side in ((-1, "left"), (1, "right")))
                bounds.append((left.astype(self.ranks.dtype), (right - left).astype(self.ranks.dtype), (left.max(axis=1) == 0) & (right.min(axis=1) == n)))
            return bounds[i]

        def colliding(q: int, i: int) -> tuple[np.ndarray, bool]:
            """The vectors in enough of the query's windows at the i-th radius, and whether that is enough of them."""
            left, size, everything = windows(i)
            np.subtract(self.ranks, left[q][:, None], out=moved)
            np.less(moved, size[q][:, None], out=inside)
            hits = np.flatnonzero(inside.view(np.uint8).sum(axis=0, dtype=kind) >= threshold * m)
            return hits, len(hits) >= need or bool(everything[q])

        i = 0
        for q in range(len(at)):
            # Collisions only grow with the radius, so the least radius that does is found from the last query's.
            hits, enough = colliding(q, i)
            while not enough:
                i += 1
                hits, enough = colliding(q, i)
            while i:
                fewer, enough = colliding(q, i - 1)
                if not enough:
                    break
                hits, i = fewer, i - 1
            yield hits


class Shard:
    """The vectors of one shard, the longest first, cut into bands of similar length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray):
        lengths = lengths_of(vectors)
        order = np.lexsort((ids, -lengths))
        self.ids, self.vectors, self.lengths, self.lines = ids[order], vectors[order], lengths[order], lines
        self.cuts = [0]
        while self.cuts[-1] < len(ids):
            self.cuts.append(int(np.searchsorted(-self.lengths, -self.lengths[self.cuts[-1]] / BAND, "right")))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float = VERIFIED, threshold: float = THRESHOLD) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, scores) of the k best found, query by query."""
        size = lengths_of(queries)
        # The order of inner products does not depend on the query's length, and windows tell most at the length of the band.
        at = (queries / size[:, None]) @ self.lines[:-1]
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in query_ids]
        for low, high in zip(self.cuts, self.cuts[1:], strict=False):
            longest, need = self.lengths[low], min(high - low, max(LEAST * k, int(share * (high - low))))
            # No vector of the band can beat k found ones that are past its bound.
            asked = [q for q, (hits, scores) in enumerate(found) if len(hits) < k or scores[-1] <= size[q] * longest * (1 + 1e-9)]
            if not asked:
                continue
            if need == high - low:
                tried = (np.arange(need) for _ in asked)
            else:
                band = Band(self.vectors[low:high] / longest, self.lines)
                tried = (hits for i in range(0, len(asked), HELD) for hits in band.candidates(at[asked[i : i + HELD]], need, threshold))
            for q, hits in zip(asked, tried, strict=True):
                hits = low + hits
                hits = hits[self.ids[hits] != query_ids[q]]
                scores = np.concatenate([found[q][1], self.vectors[hits] @ queries[q]])
                hits = np.concatenate([found[q][0], hits])
                best = np.lexsort((self.ids[hits], -scores))[:k]
                found[q] = hits[best], scores[best]
        return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, projections: int = PROJECTIONS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query. vectors and queries: (id, v)."""
    vectors = table(vectors, "ann-vectors")
    facts = vectors.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("size")).first()
    spark = vectors.sparkSession
    out = "query_id long, mark long, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = facts["size"]
    vectors = vectors.filter(F.size("v") == size)
    # mark tells queries apart that share an id.
    queries = table(queries.filter(F.size("v") == size).withColumn("mark", F.xxhash64("v")).dropDuplicates(["id", "mark"]), "ann-queries")
    shards, blocks = -(-facts["n"] // shard_rows), -(-queries.count() // query_rows)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lines = np.random.default_rng(SEED).standard_normal((size + 1, projections))

    def place(df, n, label):
        return df.withColumn(label, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

    left = place(vectors, shards, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = place(queries, blocks, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            shard = Shard(rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()), lines)
            ids = asked["id"].to_numpy()
            for q, mark, (hits, scores) in zip(ids.tolist(), asked["mark"].tolist(), shard.search(ids, np.stack(asked["v"].to_numpy()), k), strict=True):
                found.append(pd.DataFrame({"query_id": q, "mark": mark, "vec_id": shard.ids[hits], "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "mark": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["shard", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.filter(F.col("id") % 20 == 0))
