"""Operator 8, SimHash near-dedup: a grid over segment popcounts finds candidates, exact checks link them.

A 64-bit fingerprint becomes 32 counts of set bits, one per 2-bit segment. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so fingerprints at most 2 bits apart lie at most 2 steps apart on
the grid, and then both lie within one step of a common cell. Each distinct
fingerprint is therefore put into its own cell and the cells one step away (65 at
most, about 49); fingerprints that share a cell are candidates. Segments of two bits make
some 2^48 cells, so that chance rarely fills one even with 10^9 fingerprints. In a cell of up
to SMALL_CELL fingerprints every pair is verified exactly. A fuller cell, as groups of
close copies make them, forms no pairs, so that it doesn't grow with their square: two fingerprints differ in 2 bits or fewer if and only if some 64-bit
value differs from each in 1 bit or fewer. Such a value has at most 65
fingerprints about it, whatever the data, and they all link to the smallest of
them. So no group, however large, costs more than a fixed number of rows a
fingerprint, and exact copies share one fingerprint.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and links like any other; a null doc_id never becomes a
component id unless the whole component has none; repeated rows share their
component; an empty table gives an empty table.

`similar_groups` groups by the exact Jaccard similarity of shingle sets instead. Two
bits of 64 only reach very close copies (a similarity of 0.8 is about 10 bits away,
where a bound by segment counts excludes nothing), so it links, beside the
fingerprints above, the fingerprints of samples: each of `VIEWS` samples holds the
`SAMPLE` shingles that come first in an order of its own, and is itself a SimHash.
Two texts with similarity s share a given one with probability of about s^SAMPLE, at
least one of 24 with 0.9999 at 0.8. A sample of few shingles says nothing about
texts that short, so texts of up to SMALL_SET shingles are also candidates by each
shingle of their prefixes: of the |x| shingles of a text, the rarest first, the first
|x| - ceil(s |x|) + 1; two texts that are similar enough share one of those for certain.

Every candidate pair is verified exactly over the whole texts. Members of a candidate
group meet its smallest document and that of a salted part of it. After that, members
of a group that are not yet connected with most of it meet all members they are not
connected with, so no link inside a candidate group is lost: as pairs in groups of up to
GROUP members, in larger ones in blocks of bounded size, of which only links leave. A
group of copies, however large, costs two pairs a member.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import fresh, read_documents, slices, table, tidy
from tramline.llm.substring_dedup import WordHashes, windows
from tramline.operators.components import connected_components

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 18
#: Fingerprints of a cell up to which its pairs are compared.
SMALL_CELL = 8
VIEWS, SAMPLE, SALTS = 24, 5, 16
#: Members up to which the pairs of a candidate group are formed; beyond, rows that a block holds on either side.
GROUP = 64
#: Shingles up to which a text is found by its rarest shingles.
SMALL_SET = 64
_TURNS = np.random.default_rng(8).integers(1, 1 << 63, VIEWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one whole text as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, six white characters
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts, ends = (ends - sizes + 1)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batches(it):
        for b in slices(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x, width) for x in b.column(1).to_pylist()], pa.int64())], ["id", "fp"])

    return plain.mapInArrow(tidy(batches), f"id {plain.schema['id'].dataType.simpleString()}, fp long")


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect all fingerprints (column fp, distinct) at most 2 bits apart."""
    # The count of each pair of bits, in those two bits; steps turn bits, so that nothing is carried over.
    low, high = f"(fp & {0x5555555555555555}L)", f"(shiftrightunsigned(fp, 1) & {0x5555555555555555}L)"
    cell = distinct.withColumn("x", F.expr(f"({low} ^ {high}) | shiftleft({low} & {high}, 1)"))
    count = "(shiftrightunsigned(x, 2 * j) & 3)"
    near = f"""concat(array(x),
      transform(filter(sequence(0, 31), j -> {count} < 2), j -> x ^ shiftleft(if({count} = 0, 1L, 3L), 2 * j)),
      transform(filter(sequence(0, 31), j -> {count} > 0), j -> x ^ shiftleft(if({count} = 1, 1L, 3L), 2 * j)))"""
    cells = cell.select("fp", F.explode(F.expr(near)).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = table(cells.join(shared.hint("merge"), "cell"), "simhash-cells")
    # Few fingerprints in a cell: each pair is compared there.
    lists = crowded.filter(F.col("n") <= SMALL_CELL).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    pairs = "flatten(transform(fps, a -> transform(fps, b -> named_struct('b', least(a, b), 'a', greatest(a, b), 'far', bit_count(a ^ b)))))"
    few = lists.select(F.expr(f"filter({pairs}, p -> p.a <> p.b and p.far <= 2)").alias("near")).filter("size(near) > 0").select(F.inline("near")).select("b", "a")
    # Many: no pairs are formed.
    candidates = table(crowded.filter(F.col("n") > SMALL_CELL).select("fp").distinct(), "simhash-candidates")
    about = candidates.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("z"))
    # At most 65 distinct fingerprints are within one bit of z, so the list is bounded.
    groups = about.groupBy("z").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    many = groups.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a <> b")
    return few.unionByName(many).distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fp, first, component_id): each distinct fingerprint's smallest id and that of its component."""
    distinct = table(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    keep = lambda df: table(df, "simhash-links")
    roots = connected_components(keep(linked(distinct)), keep=keep).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least.hint("merge"), "root").select("fp", "first", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of docs."""
    prints = table(fingerprints(docs, width, id_col, text_col), "simhash-prints")
    return prints.join(components(prints).hint("merge"), "fp").select("id", "fp", "component_id")


def shingle_set(text: str | None, known: WordHashes, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, A-Z lower-cased; fewer words than width make one shingle."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    n = min(width, len(low.split()))
    return np.unique(windows([low.decode("utf-8", "surrogatepass")], known, n)[0]) if n else np.zeros(0, np.uint64)


def view_prints(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of each sample of a shingle set."""
    if not len(shingles):
        return np.zeros(VIEWS, np.int64)
    n, least = min(SAMPLE, len(shingles)), np.zeros((VIEWS, 0), np.uint64)
    for at in range(0, len(shingles), BLOCK):
        turned = shingles[None, at : at + BLOCK] * _TURNS[:, None]
        turned ^= turned >> np.uint64(29)
        least = np.hstack([least, turned])
        least = np.partition(least, n - 1, axis=1)[:, :n] if least.shape[1] > n else least
    least = least * np.uint64(0x9E3779B97F4A7C15)
    bits = np.unpackbits(np.ascontiguousarray(least).view(np.uint8).reshape(VIEWS, n, 8), axis=2).sum(axis=1)
    return np.packbits(bits * 2 > n, axis=1).view("<i8").reshape(VIEWS)


def prefixes(classes: DataFrame, similarity: float) -> DataFrame:
    """(rep, size, view, key): the shingles of small sets by which they meet each similar small set."""
    small = classes.select("rep", "size", F.explode("small").alias("key"))
    counted = small.join(small.groupBy("key").agg(F.count("*").alias("n")).hint("merge"), "key")
    # The order has to be the same for all sets; shingles of one set only take their place in it but meet none.
    place = F.row_number().over(Window.partitionBy("rep").orderBy("n", "key"))
    first = counted.withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1)
    return first.filter("n > 1").select("rep", "size", F.lit(VIEWS).alias("view"), "key")


def unlinked(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """(view, key, rep, size, root, most, n): the members of candidate groups that no links hold together yet.

    root is a member's component, most the one with most of the group's n members.
    """
    group = ["view", "key"]
    members = keyed.select("rep", "size", *group).join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    members = table(members.withColumn("root", F.coalesce("root", "rep")), "simhash-members")
    parts = members.groupBy(*group, "root").agg(F.count("*").alias("n"))
    # Pairs of two were verified already.
    mixed = parts.groupBy(*group).agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("n")).filter("roots > 1 and n > 2").select(*group, "most", "n")
    return table(members.join(mixed.hint("merge"), group), "simhash-mixed")


def pairs_left(mixed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): in groups of up to GROUP members the pairs that no links connect and whose sizes allow the similarity."""
    group = ["view", "key"]
    mixed = mixed.filter(F.col("n") <= GROUP)
    few = mixed.filter("root <> most").select(*group, F.col("rep").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("x_size"))
    met = few.join(mixed.hint("merge"), group).filter("root <> x_root and (root = most or x_root < root)")
    met = met.filter(F.least("size", "x_size") >= similarity * F.greatest("size", "x_size") - 1e-9)
    return met.select(F.greatest("rep", "x").alias("a"), F.least("rep", "x").alias("b")).distinct()


def links_in_blocks(mixed: DataFrame, texts, width: int, similarity: float) -> DataFrame:
    """(a, b): the links that members of groups of more than GROUP have outside their component.

    The members outside a group's main component are asked against all of it, in
    blocks of about GROUP rows on either side, through an index of the block's
    shingles; only links leave a task. texts(ids) gives (id, text) of (id) rows.
    """
    group = ["view", "key"]
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    base = mixed.filter(F.col("n") > GROUP).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    base = table(base, "simhash-blocks")
    if base.isEmpty():
        return base.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    asked = base.filter("root <> most").select(*group, F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "rep", "root", F.lit(True).alias("asks"))
    where = table(asked.select(*group, "x").distinct(), "simhash-asking")
    met = base.select(*group, F.col("block").alias("y"), "rep", "root", F.lit(False).alias("asks")).join(where.hint("merge"), group)
    rows = asked.unionByName(met).join(texts(base.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep").hint("merge"), "rep")

    def compare(rows):
        known = WordHashes()
        sets = [shingle_set(x, known, width) for x in rows["text"]]
        reps, roots, asks = rows["rep"].to_numpy(), rows["root"].to_numpy(), rows["asks"].to_numpy()
        sizes, others = np.array([len(x) for x in sets]), np.flatnonzero(~asks)
        found = [np.zeros((0, 2), np.int64)]
        if len(others):
            # The index: every shingle of the others, sorted, with its owner.
            hashes, owner = np.concatenate([sets[i] for i in others]), np.repeat(others, sizes[others])
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            for i in np.flatnonzero(asks):
                low, high = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
                hits = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
                both = np.bincount(owner[hits], minlength=len(sets))
                near = others[(both[others] >= similarity * (sizes[i] + sizes[others] - both[others])) & (roots[others] != roots[i])]
                found.append(np.stack([np.maximum(reps[near], reps[i]), np.minimum(reps[near], reps[i])], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    return rows.groupBy(*group, "x", "y").applyInPandas(compare, "a long, b long").distinct()


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id): documents linked by texts whose shingle sets have at least that Jaccard similarity.

    group_id is the smallest id of the group. Rows sharing an id are one document; rows without an id are left out.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")

    def sketch(it):
        known = WordHashes()
        for b in slices(it):
            texts = b.column(2).to_pylist()
            same = [xxhash.xxh3_128_digest(b" ".join((x or "").encode("utf-8", "surrogatepass").lower().split())) for x in texts]
            sets = [shingle_set(x, known, width) for x in texts]
            views = [view_prints(x).tolist() for x in sets]
            small = [x.view(np.int64).tolist() if len(x) <= SMALL_SET else [] for x in sets]
            columns = [pa.array(same, pa.binary()), pa.array([fingerprint(x, width) for x in texts], pa.int64()), pa.array(views, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int64())), pa.array(list(map(len, sets)), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["id", "mark", "same", "fp", "views", "small", "size"])

    plain = plain.withColumn("mark", F.xxhash64("text"))
    rows = table(plain.select("id", "mark", "text").mapInArrow(tidy(sketch), "id long, mark long, same binary, fp long, views array<long>, small array<long>, size long"), "simhash-sketches")
    # Texts of equal words form a class, which goes on as its smallest document.
    first_row = F.min(F.struct("id", "mark"))
    classes = table(rows.groupBy("same").agg(first_row["id"].alias("rep"), first_row["mark"].alias("mark"), F.min("fp").alias("fp"), F.min("views").alias("views"), F.min("small").alias("small"), F.min("size").alias("size")), "simhash-classes")
    sampled = classes.select("rep", "size", F.posexplode("views").alias("view", "key"))
    keyed = table(sampled.unionByName(prefixes(classes, similarity)), "simhash-keys").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    salted = keyed.groupBy("view", "key", "salt").agg(F.min("rep").alias("near"))
    least = keyed.groupBy("view", "key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1").select("view", "key", "least")
    met = keyed.join(least.hint("merge"), ["view", "key"]).join(salted.hint("merge"), ["view", "key", "salt"])
    pairs = met.select("rep", F.explode(F.array("near", "least")).alias("other"))
    first = table(classes.groupBy("fp").agg(F.min("rep").alias("rep")), "simhash-first")
    links = table(linked(first.select("fp")), "simhash-links")
    close = links.join(first.select(F.col("fp").alias("a"), F.col("rep")).hint("merge"), "a").join(first.select(F.col("fp").alias("b"), F.col("rep").alias("other")).hint("merge"), "b").select("rep", "other")
    alike = classes.join(first.withColumnRenamed("rep", "other").hint("merge"), "fp").select("rep", "other")
    pairs = pairs.unionByName(close).unionByName(alike).filter("rep <> other").select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct()
    pairs = table(pairs, "simhash-pairs")

    def verify(it):
        known = WordHashes()
        for b in slices(it, 200):
            a, z, x, y = (b.column(i).to_pylist() for i in range(4))
            kept = []
            for i in range(b.num_rows):
                p, q = shingle_set(x[i], known, width), shingle_set(y[i], known, width)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= similarity * (len(p) + len(q) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([z[i] for i in kept], pa.int64())], ["a", "b"])

    keep = lambda df: table(df, "simhash-links")

    def texts_of(wanted: DataFrame) -> DataFrame:
        # Each class goes by its own text, as rows that share an id may belong to several.
        own_text = classes.select(F.col("rep").alias("id"), "mark").distinct().join(wanted.hint("merge"), "id")
        return table(plain.join(own_text.hint("merge"), ["id", "mark"]).groupBy("id", "mark").agg(F.min("text").alias("text")).select("id", "text"), "simhash-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
        return keep(both.select("a", "b", "x", "y").mapInArrow(tidy(verify), "a long, b long"))

    # A document may stand in several rows: its classes are linked through its id.
    own = classes.select("same", "rep").join(rows.select("same", "id").hint("merge"), "same").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = verified(pairs).unionByName(own.filter("a <> b"))
    roots = keep(connected_components(edges, keep=keep))
    mixed = unlinked(keyed, roots)
    left = table(pairs_left(mixed, similarity).join(pairs.hint("merge"), ["a", "b"], "left_anti"), "simhash-left")
    more_links = keep(verified(left).unionByName(links_in_blocks(mixed, texts_of, width, similarity)))
    if not more_links.isEmpty():
        # Only the components that the new links join are looked at again.
        joins = more_links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")).hint("merge"), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")).hint("merge"), "b", "left")
        joined = connected_components(keep(joins.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), keep=keep)
        more = joined.select(F.col("node").alias("root"), F.col("root").alias("least"))
        known = roots.unionByName(joined.join(roots.select("node").hint("merge"), "node", "left_anti"))
        roots = keep(known.join(more.hint("merge"), "root", "left").select("node", F.coalesce("least", "root").alias("root")))
    return rows.select("id").distinct().join(roots.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("group_id"))


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-duplicates: of each group the document with the smallest id stays."""
    [name] = fresh(docs.columns, "gone")
    gone = table(similar_groups(docs, width, similarity, id_col, text_col).filter("id <> group_id").select(F.col("id").alias(name)), "simhash-gone")
    return docs.join(gone.hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_documents(spark, sf_dir, "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
