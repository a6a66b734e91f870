"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup and packing, stage after stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next. All but the last return the
columns of documents, whatever their names; n_chars follows the text. Rows sharing an id
are judged one by one but never make each other lose text. A document whose text a stage
empties stays, as an empty document, until packing, where it has no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import line_dedup, packing, quality_rules, simhash, substring_dedup
from tramline.llm.common import table


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars brought up to the text, where docs has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules reject go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines that a document with a smaller id holds go."""
    return _recounted(line_dedup.drop_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of documents with a similarity of 0.8 or more over five-word shingles the first stays."""
    return simhash.keep_one_of_each(docs, width=5, similarity=0.8)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: words in 13-word windows that a document with a smaller id holds go."""
    return _recounted(substring_dedup.dedup_substrings(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: batches within length buckets."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("substring_dedup", substrings), ("packing", pack)]

#: SQL has no sampled fingerprints; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
