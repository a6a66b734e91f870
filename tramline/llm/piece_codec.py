"""Operator 6, SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and what follows it up to the next
marker. Where no piece of the model holds a marker after another character,
merges never cross from one chunk into the next, so a text's ids are its chunks'
ids one after the other. Each Python worker keeps a table of the distinct chunks it
has met, segments a new one once with the sentencepiece library, and joins the ids
back by position with array look-ups. The table is bounded: beyond `CHUNKS_KEPT`
it starts anew. The condition on the pieces is checked when the model is loaded;
a model that breaks it, or normalises, or has user-defined pieces is refused.

Defined results: a null or empty text has the begin and end ids only and decodes
to the empty text; repeated rows are encoded one by one; an empty table gives an
empty table; other columns pass through `encode`, columns named ids or decoded
are replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import read_documents

MARK = "▁"
CHUNKS_KEPT = 600_000
#: Texts whose new chunks are segmented together.
TOGETHER = 256
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _chunks(text: str | None) -> list[str]:
    """The chunks of a text, each without its first marker."""
    if not text:
        return []
    chunks = text.split(" ")
    if "" in chunks or MARK in text:  # runs of markers belong to one chunk
        chunks = [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
    return chunks


def refuse(serialized: bytes) -> None:
    """Raise for models that normalise texts or have user-defined pieces, as their description tells."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # without protobuf only the probe of ChunkTable tells
        return
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(serialized)
    if any(p.type == p.USER_DEFINED for p in model.pieces):
        raise ValueError("the model has user-defined pieces, which may cross a whitespace marker")
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError("the model normalises texts; distinct chunks can't be segmented alone")


class ChunkTable(dict):
    """chunk without its first marker -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        refuse(self.model.serialized_model_proto())
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a whitespace marker; distinct chunks can't be segmented alone")
        probe = "x  y\t \ufb01 z \n"
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError("the model normalises texts; distinct chunks can't be segmented alone")
        self.begin, self.end = self._bytes([self.model.bos_id()]), self._bytes([self.model.eos_id()])
        self.lone = self._bytes(self.model.encode("a ")[len(self.model.encode("a")) :])

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]):
        """Each whole text's ids with begin and end, as the library gives them, as little-endian 32-bit bytes."""
        for at in range(0, len(texts), TOGETHER):
            split = [_chunks(x) for x in texts[at : at + TOGETHER]]
            if len(self) > CHUNKS_KEPT:
                self.clear()
            new = list(set().union(*split).difference(self))
            # The library puts a marker before what it encodes, as the chunk has.
            for chunk, ids in zip(new, self.model.encode([c.replace(MARK, " ") for c in new], num_threads=1), strict=True):
                self[chunk] = self._bytes(ids) if chunk else self.lone
            for chunks in split:
                yield b"".join([self.begin, *map(self.__getitem__, chunks), self.end])

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(1)
def chunk_table(path: str) -> ChunkTable:
    """The table of a Python worker; Spark keeps workers from task to task."""
    return ChunkTable(path)


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with column ids: array<int> of each whole text."""
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def batches(it):
        table = chunk_table(model_path)
        for b in it:
            done = list(table.encode_all(b.column(b.schema.get_field_index(text_col)).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in done])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(done), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    return docs.mapInArrow(batches, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with column decoded: the text that the library's decode() gives; null ids give null."""
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def batches(it):
        table = chunk_table(model_path)
        for b in it:
            done = [None if x is None else table.model.decode(x) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(batches, schema)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded, without moving either out of the task."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batches(it):
        table = chunk_table(model_path)
        for b in it:
            sizes, shas, back = [], [], []
            for ids in table.encode_all(b.column(1).to_pylist()):
                sizes.append(len(ids) // 4)
                shas.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain.mapInArrow(batches, f"id {plain.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_documents(spark, sf_dir, "doc_id", "text")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
