"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.lineage import cut

#: A node with more than a HEAVY-th of the link ends, and more than LIGHT, is a hub; there are fewer than HEAVY of them.
HEAVY, LIGHT, SALTS = 2_000, 64, 1_024


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keep=None, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges; root is the smallest node it reaches.

    Each round links every node's larger neighbours to its smallest one (large
    star) and then its smaller neighbours likewise (small star); the depth of the
    trees falls by about half each time. keep(df) materialises a round's edges
    and cuts lineage; a checkpoint is used where it is missing. Rows with a null
    end are ignored, loops keep their node as its own root.
    """
    keep = keep or cut
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = edges.select("u").union(edges.select("v")).distinct()
    links = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = links.agg(F.count("*").alias("n"), F.lit(None).cast("decimal(38,0)").alias("h")).first()
    for _ in range(rounds if before["n"] else 0):
        links = keep(_small_star(_large_star(links, before["n"]), before["n"]))
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        if before["n"]:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.withColumnRenamed("u", "node").join(found.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _with_least(links: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """links joined with least (u, m, n) by u.

    Hubs with more than one link in HEAVY, if there are any, are broadcast; their
    links are dealt out by a salt in the join of the rest, so that they stay apart.
    """
    limit = max(2 * n // HEAVY, LIGHT)
    if least.filter(F.col("n") > limit).isEmpty():
        return links.join(least.select("u", "m").hint("merge"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > limit).select("u", F.col("m").alias("hub_m")))
    rest = least.filter(F.col("n") <= limit).select("u", F.lit(-1).alias("salt"), "m").hint("merge")
    salted = links.join(hubs, "u", "left").withColumn("salt", F.when(F.col("hub_m").isNull(), -1).otherwise(F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")))
    return salted.join(rest, ["u", "salt"], "left").select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.filter("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    below = _with_least(links, least, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
