"""Operator 3, line dedup: levelled sorted runs of line hashes, DataFrame functions only.

Each text is split once: the hash of every line's key, with its row and position,
goes to a table laid out by batch. Batches have ascending ids. Each groups its keys
to one row each (128-bit hash, first and last document, lines), merge-anti-joins the
runs of earlier batches and adds the keys not seen before as a new run. A run is a
Parquet table bucketed and sorted by the hash, so that joins don't shuffle the run's
side; Spark sorts the files of a bucket again, as it doesn't trust their order. When a
level holds `fanout` runs they are compacted into one run of the next level. As ids
ascend, a key's owner never changes: it is the smallest document of the batch that
first held it.

Lines whose key has another owner are dropped. One row per key and task leaves the
map side of the grouping. The join that finds a key's lines is split in two: the few
keys with a great share of a batch's lines are broadcast (fewer than HEAVY by
arithmetic), so their lines stay where they are; the others are shuffled.

Defined results: a null or empty text is one empty line; keys shorter than
`min_chars` code points are never dropped; rows sharing a doc_id count as parts
of one document (copies inside one document stay), and each loses only its own
lines; a null doc_id is a document of its own that comes first; ids are numbers; an
empty table gives an empty table; other columns ride along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import WHITE, fresh, read_documents, set_aside, shared_dir, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Keys of more than a HEAVY-th of a batch's lines, and of LIGHT lines at least, are joined without a shuffle of their lines.
HEAVY, LIGHT = 2_000, 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """line stripped, with A-Z lower-cased. Where all characters are ASCII, lower() is the same and faster."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def row_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class LineRuns:
    """The sorted runs, by level. add() takes a batch of keys and tells which were seen before."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, keys: DataFrame) -> DataFrame:
        """keys as a table bucketed and sorted by the hash, kept as plain files in the shared folder."""
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.option("path", shared_dir(self.spark, "line-run")).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        run = self.spark.table(name)
        run.schema  # noqa: B018  resolves the table before its name goes; the files stay
        self.spark.sql(f"DROP TABLE {name}")
        return run

    def add(self, keys: DataFrame) -> DataFrame:
        """keys: one row per key. Returns them with `seen`, true where a run holds the key; new ones form a run."""
        marked = keys.withColumn("seen", F.lit(False))
        for i, run in enumerate(run for level in self.levels for run in level):
            had = run.select(*KEY, F.lit(True).alias(f"in{i}"))
            marked = marked.join(had.hint("merge"), KEY, "left").withColumn("seen", F.col("seen") | F.coalesce(F.col(f"in{i}"), F.lit(False))).drop(f"in{i}")
        written = self._write(marked)
        self.levels[0].append(written.filter("not seen").select(*KEY))
        return written

    def compact(self) -> None:
        """Merge full levels into the next one. Runs are disjoint, so their union is the merged run."""
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fanout:
                merged = self.levels[at][0]
                for run in self.levels[at][1:]:
                    merged = merged.unionByName(run)
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._write(merged.repartition(self.buckets, *KEY)))
                self.levels[at] = []


def line_rows(docs: DataFrame, cuts: list, min_chars: int) -> DataFrame:
    """(batch, id, mark, pos, h1, h2): every line that counts, written once and laid out by batch.

    docs: (id, text). mark is a hash of the text, which tells rows apart that share an id.
    """
    spark = docs.sparkSession
    batch = F.lit(0)
    for c in cuts:
        batch = batch + F.when(F.col("id") > c, 1).otherwise(0)
    marked = docs.select(batch.alias("batch"), "id", row_mark(F.col("text")).alias("mark"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = marked.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    # Two seeds of the same hash: the second starts from the hash of a constant.
    lines = lines.select("batch", "id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    path = shared_dir(spark, "line-rows")
    lines.write.partitionBy("batch").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def lost_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(id, mark, pos): the lines of a batch whose key another document owns; known: its keys, as LineRuns.add returns them."""
    shared = F.coalesce(F.col("first") < F.col("last"), F.lit(False)) | (F.col("nameless") & F.col("first").isNotNull())
    again = known.filter(F.col("seen") | shared).select(*KEY, "seen", "nameless", "first", "n")
    # Keys with more than one line in HEAVY of the batch: there are fewer than HEAVY of them, whatever the data.
    limit = max((known.agg(F.sum("n")).first()[0] or 0) // HEAVY, LIGHT)
    heavy, light = F.broadcast(again.filter(F.col("n") > limit)), again.filter(F.col("n") <= limit)
    found = lines.join(heavy, KEY).unionByName(lines.join(F.broadcast(again.filter(F.col("n") > limit).select(*KEY)), KEY, "left_anti").join(light.hint("merge"), KEY))
    other = F.when(F.col("nameless"), F.col("id").isNotNull()).otherwise(F.col("id") > F.col("first"))
    return found.filter(F.col("seen") | other).select("id", "mark", "pos")


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, gone): the positions of the lines to drop, for rows that lose any. id is null-safe and numeric."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    cuts = docs.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    every = line_rows(docs, cuts, min_chars)
    runs, gone = LineRuns(spark, buckets, fanout), []
    for i in range(len(cuts) + 1):
        lines = every.filter(F.col("batch") == i).drop("batch")
        # The owner is the smallest id, or the document without one; plain numbers keep the aggregation hashed.
        keys = lines.groupBy(*KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("nameless"), F.count("*").alias("n"))
        lost = lost_lines(lines, runs.add(keys))
        gone.append(table(lost.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone")), "line-drops"))
        if i < len(cuts):
            runs.compact()
    found = gone[0]
    for g in gone[1:]:
        found = found.unionByName(g)
    return found


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text left after line dedup, and n_lines and n_dropped (replaced if docs has such columns)."""
    docs = docs.drop("n_lines", "n_dropped")
    own_id, own_mark, other_id, other_mark, gone, lines, kept = fresh([*docs.columns, "n_lines", "n_dropped"], "own_id", "own_mark", "other_id", "other_mark", "gone", "lines", "kept")
    drops = dropped_lines(docs, min_chars, batches, fanout, id_col, text_col).select(F.col("id").alias(other_id), F.col("mark").alias(other_mark), F.col("gone").alias(gone))
    text = F.col(f"`{text_col}`")
    marked = docs.withColumn(own_id, F.col(f"`{id_col}`")).withColumn(own_mark, row_mark(text))
    joined = marked.join(drops.hint("merge"), F.col(own_id).eqNullSafe(F.col(other_id)) & (F.col(own_mark) == F.col(other_mark)), "left")
    # Positions are kept by a hashed set difference, so that long documents stay linear.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = F.when(F.col(gone).isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.col(lines)[i]), "\n"))
    out = joined.withColumn(lines, split_lines(text)).withColumn(kept, rest)
    columns = [F.col(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))


def drop_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the text left after line dedup; all other columns, whatever their names, are unchanged."""
    docs, back = set_aside(docs, "n_lines", "n_dropped")
    return back(dedup_lines(docs, min_chars))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
o AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS owner FROM k),
d AS (SELECT *, length(key) >= 10 AND doc_id <> owner AS gone FROM o)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""
