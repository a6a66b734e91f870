"""Operator 10, quality classifier: neighbours vote in a latent-semantic space.

A text's terms are its byte pairs and a few marks of shape (repeated words,
repeated lines), hashed to `TERMS` columns, weighted by log frequency and inverse
document frequency over all documents, and scaled to length one. A truncated
singular value decomposition of the labelled rows gives `DIMS` latent dimensions;
it is fitted on at most `sample` labelled rows, those with the smallest hash of
their id. Their latent vectors and labels are broadcast (sample * DIMS floats, a
fixed bound). Every document is projected and compared with all of them by exact
cosine products, block by block; the `k` most similar vote with their similarity
to the power `sharpness` as weight. No label, language, source or id enters a score.

Defined results: a null or empty text, or one without terms, gets the share of
label 1 among the labelled rows; without labelled rows every score is 0.5; a null
id is held in; ties among neighbours (cosines equal to nine decimals) go to the labelled
row with the smaller hash of its id; of labelled rows that share an id the one with the
least text votes; repeated rows are scored one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import WHITE, read_documents, slices, tidy

TERMS = 2048
SHAPES = 16
DIMS = 64
SAMPLE = 6000
K = 25
SHARPNESS = 8
BLOCK = 512
CUT = 0.3


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the TERMS terms of one whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(TERMS, np.int64)
    room = TERMS - SHAPES
    for at in range(0, max(len(data) - 1, 0), 1 << 22):
        part = data[at : at + (1 << 22) + 1].astype(np.int32)
        pairs = part[:-1] * 256 + part[1:]
        counts[:room] += np.bincount((pairs * 40503 & 0xFFFF) % room, minlength=room)
    words = (text or "").split()
    if words:
        # Shapes: words that repeat the one before, words and lines met before; each by its share, in five steps of weight.
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        shares = (sum(map(str.__eq__, words[1:], words)) / len(words), 1 - len(set(words)) / len(words), 1 - len(set(lines)) / max(len(lines), 1))
        for i, share in enumerate(shares):
            for step in range(5):
                if share * 5 > step + (0.25 if i != 1 else 0.5):
                    counts[room + 5 * i + step] = len(data)
    return counts


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each term, documents), over all documents. TERMS numbers reach the driver."""

    def batches(it):
        total, n = np.zeros(TERMS, np.int64), 0
        for b in it:
            for text in b.column(0).to_pylist():
                total += term_counts(text) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])

    rows = docs.select("text").mapInArrow(batches, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found, n = np.zeros(TERMS, np.int64), 0
    for r in rows:
        if r["term"] < 0:
            n = r["n"]
        else:
            found[r["term"]] = r["n"]
    return found, n


class Voters:
    """The labelled vectors in latent space."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray):
        self.idf, self.labels = idf, labels.astype(np.float64)
        rows = _weights(counts, idf)
        self.centre = rows.mean(axis=0)
        rows = rows - self.centre
        rng = np.random.default_rng(10)
        basis = rows.T @ rng.standard_normal((len(rows), min(DIMS + 16, len(rows))))
        for _ in range(4):
            basis = np.linalg.qr(rows.T @ (rows @ np.linalg.qr(basis)[0]))[0]
        _, _, v = np.linalg.svd(rows @ basis, full_matrices=False)
        self.basis = basis @ v.T[:, :DIMS]
        self.vectors = self._unit(rows @ self.basis)
        self.base = float(self.labels.mean())

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, k: int = K, sharpness: float = SHARPNESS) -> np.ndarray:
        cosines = self._unit((_weights(counts, self.idf) - self.centre) @ self.basis) @ self.vectors.T
        # Rounded, so that equal vectors tie and a row's neighbours don't depend on those it is computed with.
        cosines, k = np.round(cosines, 9), min(k, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cosines, near, axis=1).min(axis=1)
        for row in np.flatnonzero((cosines >= least[:, None]).sum(axis=1) > k):  # ties across the k-th place
            near[row] = np.argsort(-cosines[row], kind="stable")[:k]
        near.sort(axis=1)
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** sharpness
        total = weight.sum(axis=1)
        votes = np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), self.base)
        return np.where(counts.any(axis=1), np.clip(votes, 0, 1), self.base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, part: int = 0, sample: int = SAMPLE) -> Voters | None:
    """Voters from a bounded sample of the labelled rows that are not held out. docs: (doc_id, text)."""
    frequency, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float64) + 0.1
    labelled = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    chosen = labelled.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(sample)
    # At most `sample` ids: small by the bound, so they may be broadcast.
    # Of rows that share an id one counts, so that their number is bounded as well.
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "draw", "label").agg(F.min("text").alias("text")).select("draw", "label", "text")

    def batches(it):
        for b in slices(it):
            counts = [term_counts(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.astype("<u4").tobytes() for c in counts], pa.binary())], ["draw", "label", "counts"])

    rows = sorted(texts.mapInArrow(tidy(batches), "draw long, label int, counts binary").collect(), key=lambda r: (r["draw"], bytes(r["counts"])))
    if not rows:
        return None
    return Voters(np.stack([np.frombuffer(r["counts"], "<u4") for r in rows]), np.array([r["label"] for r in rows]), idf)


def score(docs: DataFrame, voters: Voters | None) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    kept = docs.sparkSession.sparkContext.broadcast(voters)

    def batches(it):
        for b in slices(it):
            texts, found = b.column(1).to_pylist(), []
            for at in range(0, len(texts), BLOCK):
                part = texts[at : at + BLOCK]
                found.append(np.full(len(part), 0.5) if kept.value is None else kept.value.scores(np.stack([term_counts(x) for x in part])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir, "doc_id", "text")
    voters = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("quality")))
    return score(docs, voters).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
