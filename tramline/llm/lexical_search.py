"""Operator 12, ranked lexical search through trees of documents.

Items are the queries; a block of them with a bounded number of distinct terms is
broadcast. One pass over the documents keeps of each text its number of terms and the
frequencies of the block's terms (its restricted vector), written as a table with the
corpus counts. From the counts come the weights; then each task makes of its vectors,
shard by shard, an FP-tree: terms of a vector stand in descending order of document
frequency, so vectors with the same frequent terms share a path. A node's documents
stand side by side in that order. For each node the tree keeps the highest frequency of
each term and the smallest m of the documents below it. A document's score grows with its
frequencies and falls with m, so scoring these maxima bounds all scores below a node.

Each item walks the tree depth first, the child with the higher bound first, and leaves
out a node whose bound is under the item's 20th score so far (equal bounds are
visited, as ties go to smaller ids); in the leaves documents are scored exactly. The bests
of a task's first shards count for the next. A window over item and score ends it.

Defined results: null and empty texts have no terms and never rank; an item without
terms or hits has no rows; rows sharing an id rank one by one, and so do repeated items (null
ids first among ties); empty tables give an empty table. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tramline.llm.common import read_documents, table, tidy
from tramline.llm.exchange import packed, unpacked

TOP = 20
#: Distinct terms and bytes of a block of items; a single larger item is a block of its own.
BLOCK_TERMS, BLOCK_BYTES = 16_384, 8 << 20
#: Documents and vector entries of a shard, documents of a leaf, bytes of text split at once.
SHARD_DOCS, SHARD_ENTRIES, LEAF, PIECE = 16_384, 2_000_000, 16, 1 << 20
#: Separators (ASCII but letters and digits) as spaces, A-Z lower-cased; all bytes from 0x80 on belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None):
    """The terms of a text, as lists of bytes for pieces of a bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = cut if cut >= 0 else data.find(b" ", end)
            end = cut + 1 if cut >= 0 else len(data)
        yield data[at:end].split()
        at = end


def blocks_of(items: DataFrame):
    """Blocks of items as lists of (id, Counter of terms), bounded by distinct terms and bytes."""
    block, distinct, size = [], set(), 0
    for item, text in items.toLocalIterator():
        found = Counter(t for part in terms_of(text) for t in part)
        if block and (len(distinct.union(found)) > BLOCK_TERMS or size + len(text or "") > BLOCK_BYTES):
            yield block
            block, distinct, size = [], set(), 0
        block.append((item, found))
        distinct.update(found)
        size += len(text or "")
    if block:
        yield block


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Restricted vectors of docs (id, text) in rows of many documents, with what they add to the corpus counts."""
    number = {t: i for i, t in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast(number)
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def run(it):
        known = shared.value
        for b in it:
            ids, lengths, sizes, terms, tfs, total = [], [], [], [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = 0, []
                for part in terms_of(text):
                    n += len(part)
                    found.append(np.fromiter(map(known.get, part, repeat(-1)), np.int32, len(part)))
                if n:
                    total += 1
                    own, tf = np.unique(np.concatenate(found), return_counts=True)
                    own, tf = (own[1:], tf[1:]) if own[0] < 0 else (own, tf)
                    ids.append(i)
                    lengths.append(n)
                    sizes.append(len(own))
                    terms.append(own)
                    tfs.append(tf)
            own = np.concatenate(terms) if terms else np.zeros(0, np.int32)
            columns = [packed(np.array(lengths, "<i8"), np.array(sizes, "<i8")), packed(own.astype("<i4"), (np.concatenate(tfs) if tfs else own).astype("<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), *[pa.array([x], pa.binary()) for x in columns], pa.array([sum(lengths)]), pa.array([total]), pa.array([np.bincount(own, minlength=len(known))], pa.list_(pa.int64()))], ["ids", "docs", "entries", "n_terms", "n_docs", "df"])

    return table(docs.mapInArrow(tidy(run), f"ids array<{docs.schema['id'].dataType.simpleString()}>, docs binary, entries binary, n_terms long, n_docs long, df array<long>"), "term-vectors")


class Tree:
    """The FP-tree of a shard: nodes as ranges of documents, with maxima of every term and minima of m."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, width: int):
        """ranks: each document's terms, by descending document frequency, documents one after the other."""
        ends = np.cumsum(sizes)
        path = ranks.astype(">u4").tobytes()
        paths = [path[4 * (z - n) : 4 * z] for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        sizes = sizes[self.order]
        take = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat((ends[self.order] - sizes), sizes)
        self.m, self.ranks, self.tfs, self.to = m[self.order], ranks[take], tfs[take], np.append(0, np.cumsum(sizes))
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self._split([self._shared(paths[a], paths[b]) for a, b in zip(self.order[:-1].tolist(), self.order[1:].tolist(), strict=True)])
        self._maxima(width)

    @staticmethod
    def _shared(a: bytes, b: bytes) -> int:
        """How many first terms two paths have in common."""
        n = min(len(a), len(b)) // 4
        x, y = np.frombuffer(a, ">u4", n), np.frombuffer(b, ">u4", n)
        apart = np.flatnonzero(x != y)
        return int(apart[0]) if len(apart) else n

    def _split(self, shared: list[int]) -> None:
        """Nodes from the root on: ranges of documents, each cut where its common path ends; small neighbours share a leaf."""
        shared = np.array(shared, np.int64)
        self.low, self.high, self.children = [0], [len(self.order)], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            inner = shared[low : high - 1]
            cuts = [low, *(np.flatnonzero(inner == inner.min()) + low + 1).tolist(), high]
            start = low
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                # A run of small subtrees ends before it outgrows a leaf, and before a large subtree.
                if z - start > LEAF and a > start:
                    self._child(node, start, a, todo)
                    start = a
                if z - start > LEAF:
                    self._child(node, start, z, todo)
                    start = z
            if start < high:
                self._child(node, start, high, todo)

    def _child(self, node: int, low: int, high: int, todo: list[int]) -> None:
        self.children[node].append(len(self.low))
        todo.append(len(self.low))
        self.low.append(low)
        self.high.append(high)
        self.children.append([])

    def _maxima(self, width: int) -> None:
        nodes = len(self.low)
        self.highest = np.zeros((nodes, width), np.int32)
        self.least = np.array([self.m[a:z].min() for a, z in zip(self.low, self.high, strict=True)])
        for node in range(nodes - 1, -1, -1):  # children have higher numbers
            if self.children[node]:
                self.highest[node] = self.highest[self.children[node]].max(0)
            else:
                a, z = self.to[self.low[node]], self.to[self.high[node]]
                np.maximum.at(self.highest[node], self.ranks[a:z], self.tfs[a:z])

    def search(self, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: list, ids: list) -> list:
        """best, (-score, has id, id) of up to TOP documents, with the shard's better ones; weights: of the item's terms, weight_of: of all."""
        tf = self.highest[:, terms].astype(np.int64)
        bounds = (weights * (1_000_000_000 * tf // (1000 * tf + 12 * self.least[:, None]))).sum(1).tolist()
        todo = [0]
        while todo:
            node = todo.pop()
            if bounds[node] <= 0 or (len(best) == TOP and bounds[node] < -best[-1][0]):
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=bounds.__getitem__)
                continue
            low, high = self.low[node], self.high[node]
            a, z = self.to[low], self.to[high]
            tf = self.tfs[a:z]
            doc = self.doc[a:z]
            gains = weight_of[self.ranks[a:z]] * (1_000_000_000 * tf // (1000 * tf + 12 * self.m[doc]))
            sums = np.append(0, np.cumsum(gains))
            scores = sums[self.to[low + 1 : high + 1] - a] - sums[self.to[low:high] - a]
            found = np.flatnonzero(scores >= max(1, -best[-1][0] if len(best) == TOP else 1))
            if len(found):
                own = [ids[i] for i in self.order[low + found].tolist()]
                best = sorted(best + [(-s, i is not None, i) for s, i in zip(scores[found].tolist(), own, strict=True)])[:TOP]
        return best


def _searched(block: list, restricted: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(item, number, id, score): the best documents of each task for each item of the block."""
    spark = restricted.sparkSession
    total, length = restricted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    total, length = int(total or 0), int(length or 0)
    # One row for each term of the block.
    df = np.zeros(max(len(vocabulary), 1), np.int64)
    for place, held in restricted.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col")).collect():
        df[place] = held
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    queries = []
    for found in (x for _, x in block):
        own = np.fromiter((number[t] for t in found), np.int64, len(found))
        queries.append((rank[own], weight[own] * np.fromiter(found.values(), np.int64, len(found))))
    shared = spark.sparkContext.broadcast((queries, rank, total, length))
    id_type = restricted.schema["ids"].dataType.elementType
    kinds = [pa.int32(), to_arrow_type(id_type), pa.int64()]

    def shards(it):
        ids, docs, entries, held = [], [], [], 0
        for b in it:
            for own, x, y in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                ids += own
                docs.append(unpacked(x, "<i8", "<i8"))
                entries.append(unpacked(y, "<i4", "<i8"))
                held += len(entries[-1][0])
                if len(ids) >= SHARD_DOCS or held >= SHARD_ENTRIES:
                    yield ids, docs, entries
                    ids, docs, entries, held = [], [], [], 0
        if ids:
            yield ids, docs, entries

    def search(it):
        queries, rank, total, length = shared.value
        best = [[] for _ in queries]
        for ids, docs, entries in shards(it):
            n, sizes = (np.concatenate(x) for x in zip(*docs, strict=True))
            terms, tfs = (np.concatenate(x) for x in zip(*entries, strict=True))
            ranks = rank[terms]
            doc = np.repeat(np.arange(len(n)), sizes)
            sort = np.lexsort((ranks, doc))
            tree = Tree(75 + 25 * n * total // length, sizes, ranks[sort], tfs[sort], len(rank))
            weight_of = np.zeros(len(rank), np.int64)
            for k, (own, weights) in enumerate(queries):
                weight_of[own] = weights
                best[k] = tree.search(own, weights, weight_of, best[k], ids)
                weight_of[own] = 0
        rows = [(k, i, -s) for k, found in enumerate(best) for s, _, i in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*rows, strict=True)) or [[]] * 3, kinds, strict=True)], ["number", "id", "score"])

    found = restricted.select("ids", "docs", "entries").mapInArrow(tidy(search), f"number int, id {id_type.simpleString()}, score long")
    return found


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the TOP documents of every item, highest score first, ties to the smaller id."""
    spark, out = docs.sparkSession, []
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = items.schema[item_col].dataType
    for block in blocks_of(items.select(F.col(f"`{item_col}`"), F.col(f"`{item_text}`"))):
        vocabulary = sorted(set().union(*[found for _, found in block]))
        best = _searched(block, vectors(plain, vocabulary), vocabulary)
        rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))
        best = best.withColumn("rank", rank).filter(F.col("rank") <= TOP)
        # Ids of a block's items, as a literal that the block bounds.
        named = F.array(*[F.lit(i).cast(kind) for i, _ in block])
        out.append(best.select(F.element_at(named, F.col("number") + 1).alias("item"), "rank", "id", "score"))
    if not out:
        return plain.limit(0).select(F.lit(None).cast(kind).alias("item"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionAll, out)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(read_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH found AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
corpus AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM found WHERE len(terms) > 0),
wanted AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
freq AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row_number() OVER () AS row, doc_id, len(terms) AS n, unnest(terms) AS term FROM found)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM freq, corpus GROUP BY term),
scored AS (
  SELECT item_id, doc_id, row, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM freq JOIN wanted USING (term) JOIN weights USING (term), corpus GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
