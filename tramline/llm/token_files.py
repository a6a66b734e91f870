"""Operator 4, token-id files: tokenised documents as Simple-8b words, in ascending id order.

Rows are dealt by range of their id and sorted, each task encodes its texts and
writes files of bounded size, under a name of its own that becomes final by a
rename, so a repeated task replaces what an earlier attempt left. A file holds a
header, the documents' ids and lengths, the word offset of every block of 4,096
ids, and the words. Readers decode all blocks of a file together, or only those
that a document needs.

Where white space always separates tokens, which the tokenizer's own description
tells, texts are split into runs of other characters, and these into a word of letters
and one of marks, as Arrow arrays. Each distinct word (or run that is no such two) is
tokenised once by the tokenizers library and its ids are taken by position; the tables
of a Python worker are bounded by bytes and begun anew when full. Other tokenizers
encode whole texts.

Defined results: a null or empty text has the end id only; null ids come first;
rows of equal id are ordered by their text and stay apart; an empty table gives
no file and an empty table; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm import simple8b
from tramline.llm.common import join_small, read_documents, shared_dir, table, tidy

END_ID = 2
MAGIC = b"TKS8\x01\x00\x00\x00"
HEADER = struct.Struct("<8sQQQ")
#: Ids in a file, at most but for its last document.
FILE_IDS = 16 << 20
#: Ids coded together.
GROUP = 64 * simple8b.BLOCK
#: Bytes up to which the table of a Python worker's words grows (that of its other chunks: half as many), and what an entry takes besides its own bytes.
TABLE_BYTES, ENTRY_BYTES = 96 << 20, 160
#: Characters whose chunks are looked up together.
TOGETHER = 1 << 20
# Fixed value: the word pattern of the tokenizers this serves. No alternative matches white space, and what none matches goes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Letters that are composed and whose lower case depends on no other one.
LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
#: The printable ASCII characters that are neither letters nor digits nor white space.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
LETTERS_MARKS = re.compile(f"[{LETTERS}]+[{re.escape(MARKS)}]*")
#: Words of letters or of marks that are encoded as one text, with a digit, which is always a word of its own, between them.
JOINED, BETWEEN = 64, "0"
#: Texts encoded at once: the library's results take about 100 bytes a token until their ids are read.
AT_ONCE = 128


def steps_of(spec: dict) -> tuple[list[dict], list[dict]]:
    """The normalizers and pre-tokenizers of a tokenizer's JSON, in order."""
    flat = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    return flat(spec["normalizer"], "normalizers"), flat(spec["pre_tokenizer"], "pretokenizers")


def apart(spec: dict) -> bool:
    """Whether runs of characters between ASCII white space can be encoded one by one.

    They can if texts are only composed, lower-cased and have white space replaced by a
    space, if words are then found by WORDS and everything else goes, and if no added
    token looks at its neighbours or holds white space.
    """
    normalizers, pretokenizers = steps_of(spec)
    space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    plain = all(x == space or x in ({"type": "NFC"}, {"type": "Lowercase"}) for x in normalizers)
    bytes_ = len(pretokenizers) == 2 and pretokenizers[1]["type"] == "ByteLevel" and not pretokenizers[1]["add_prefix_space"] and not pretokenizers[1]["use_regex"]
    added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) and x["content"].split() == [x["content"]] for x in spec["added_tokens"])
    return plain and bytes_ and pretokenizers[0] == split and added and spec["post_processor"] is None


class ChunkIds(dict):
    """Run of characters without white space -> its ids as little-endian 32-bit bytes; `words` has the same of words of letters or of marks.

    Tokenizers that don't work run by run (see `apart`) encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        self.apart, self.held = apart(spec), 0
        if self.apart:
            normalizers, pretokenizers = steps_of(spec)
            # White space inside a chunk goes with or without the replacement, which is slow.
            kept = [x for x in normalizers if x["type"] != "Replace"]
            self.composed = Tokenizer.from_str(json.dumps(spec | {"normalizer": {"type": "Sequence", "normalizers": kept}}))
            # Printable ASCII is composed already and stands for itself at byte level.
            self.ascii = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": pretokenizers[0]}))
            self.lower = any(x["type"] == "Lowercase" for x in normalizers)
            # Letters and then marks are two words, unless an added token could stand there.
            self.two_words = not any(LETTERS_MARKS.fullmatch(x["content"]) for x in spec["added_tokens"])
            self.words, self.words_held = {}, 0
            # Words can be joined where the digit has one id of its own and is in no added token.
            alone = [self._of(x, [BETWEEN])[0] for x in (self.ascii, self.composed)]
            named = BETWEEN + (spec["model"].get("end_of_word_suffix") or "")
            own = alone[0] == alone[1] and [self.ascii.id_to_token(x) for x in alone[0]] == [named]
            self.between = alone[0][0] if own and not any(BETWEEN in x["content"] for x in spec["added_tokens"]) else None

    @staticmethod
    def _of(tokenizer, texts: list[str]) -> list[list[int]]:
        # The fast form leaves out offsets, which aren't used.
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [x.ids for at in range(0, len(texts), AT_ONCE) for x in encode(texts[at : at + AT_ONCE], add_special_tokens=False)]

    def _bytes_of(self, tokenizer, words: list[str]) -> list[bytes]:
        """The ids of words of letters or of marks as bytes; many are encoded as one text and told apart by the digit between them."""
        if self.between is None:
            return [np.array(ids, "<u4").tobytes() for ids in self._of(tokenizer, words)]
        runs = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        out = []
        for run, ids in zip(runs, self._of(tokenizer, [BETWEEN.join(run) for run in runs]), strict=True):
            values = np.array(ids, "<u4")
            ends = np.flatnonzero(values == self.between)
            data, begins = values.tobytes(), [0, *(4 * ends + 4).tolist()]
            if len(begins) != len(run):
                raise ValueError("words that were encoded together cannot be told apart")
            out += [data[i:j] for i, j in zip(begins, [*(4 * ends).tolist(), len(data)], strict=True)]
        return out

    def _words_bytes(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words of letters or of marks."""
        found = {"": b""}
        plain = [x for x in words if x.isascii() and x]
        accented = [x for x in words if not x.isascii()]
        for tokenizer, some in ((self.ascii, plain), (self.composed, accented)):
            found.update(zip(some, self._bytes_of(tokenizer, some), strict=True))
        return [found[x] for x in words]

    def _chunks_bytes(self, chunks: list[str]) -> list[bytes]:
        """The ids of other chunks."""
        return [np.array(ids, "<u4").tobytes() for ids in self._of(self.composed, chunks)]

    def _looked_up(self, texts: pa.Array, known: dict, held: int, most: int, encode) -> tuple[pa.Array, int]:
        """(ids, held): the ids of each text, by the table of known ones, which learns the others and begins anew beyond most bytes."""
        coded = texts.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, keys))
        new = [key for key, x in zip(keys, found, strict=True) if x is None]
        if new:
            if held > most:
                known.clear()
                held = 0
            learnt = encode(new)
            known.update(zip(new, learnt, strict=True))
            held += sum(map(len, new)) + sum(map(len, learnt)) + ENTRY_BYTES * len(new)
            rest = iter(learnt)
            found = [next(rest) if x is None else x for x in found]
        return pa.array(found, pa.large_binary()).take(coded.indices), held

    def _ids_of(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk, as bytes; letters and then marks are looked up as two words."""
        letters, marks = pc.ascii_rtrim(chunks, MARKS), pc.utf8_ltrim(chunks, LETTERS)
        two = pc.and_(pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(marks)), pc.binary_length(chunks)), self.two_words)
        none = pa.scalar("", chunks.type)
        letters, marks, others = pc.if_else(two, letters, none), pc.if_else(two, marks, none), pc.if_else(two, none, chunks)
        if self.lower:
            letters = pc.utf8_lower(letters)
        out = []
        for words in (letters, marks):
            ids, self.words_held = self._looked_up(words, self.words, self.words_held, TABLE_BYTES, self._words_bytes)
            out.append(ids)
        ids, self.held = self._looked_up(others, self, self.held, TABLE_BYTES // 2, self._chunks_bytes)
        return pc.binary_join_element_wise(*out, ids, pa.scalar(b"", pa.large_binary()))

    def _ids_of_run(self, texts: list[str | None]) -> tuple[memoryview, list[int]]:
        """The ids of all texts as bytes, and where each text's begin and the last one's end."""
        split = pc.ascii_split_whitespace(pa.array([text or "" for text in texts], pa.large_string()))  # at the six ASCII white characters
        coded = split.flatten().dictionary_encode()
        ids = self._ids_of(coded.dictionary).take(coded.indices)
        _, offsets, data = ids.buffers()
        return memoryview(data or b""), np.frombuffer(offsets, "<i8")[split.offsets.to_numpy()].tolist()

    def encode_all(self, texts: list[str | None], end_id: int):
        """The ids of each whole text and the end id, as bytes."""
        end = np.array([end_id], "<u4").tobytes()
        if not self.apart:
            for text in texts:
                yield np.array(self._of(self.tokenizer, [text or ""])[0], "<u4").tobytes() + end
            return
        for at, until in self._runs(texts):
            data, bounds = self._ids_of_run(texts[at:until])
            for i, j in zip(bounds, bounds[1:]):
                yield b"".join((data[i:j], end))

    @staticmethod
    def _runs(texts: list[str | None]):
        """Bounds of runs of texts of about TOGETHER characters."""
        at, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= TOGETHER:
                yield at, i + 1
                at, chars = i + 1, 0
        if at < len(texts):
            yield at, len(texts)


@lru_cache(1)
def chunk_ids(path: str) -> ChunkIds:
    """The table of a Python worker; Spark keeps workers from task to task."""
    return ChunkIds(path)


class Writer:
    """Collects one file: documents in order, ids coded as whole groups fill up."""

    def __init__(self):
        self.ids, self.sizes, self.rest, self.held, self.words, self.offsets, self.n_words, self.n = [], [], [], 0, [], [], 0, 0

    def add(self, doc_id: int, data: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(data) // 4)
        self.rest.append(data)
        self.held += len(data) // 4
        self.n += len(data) // 4
        if self.held >= GROUP:
            self._code(self.held // GROUP * GROUP)

    def _code(self, n: int) -> None:
        values = np.frombuffer(b"".join(self.rest), "<u4")
        for at in range(0, n, GROUP):
            words, offsets = simple8b.encode(values[at : min(at + GROUP, n)])
            self.words.append(words)
            self.offsets.append(offsets[:-1] + self.n_words)
            self.n_words += len(words)
        self.rest, self.held = [values[n:].tobytes()], len(values) - n

    def finish(self) -> bytes:
        if self.held:
            self._code(self.held)
        offsets = np.concatenate([*self.offsets, [self.n_words]]).astype("<u8")
        body = [np.array(self.ids, "<i8"), np.array(self.sizes, "<u4"), offsets, *[w.astype("<u8") for w in self.words]]
        return HEADER.pack(MAGIC, len(self.ids), self.n, len(offsets)) + b"".join(x.tobytes() for x in body)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, their numbers of ids, all ids) of one file."""
    magic, docs, n, blocks = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    ids = np.frombuffer(data, "<i8", docs, at)
    sizes = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    offsets = np.frombuffer(data, "<u8", blocks, at + 12 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", offset=at + 12 * docs + 8 * blocks)
    return ids, sizes, simple8b.decode(words, offsets, n)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, as executors in Python need it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


NULL_ID = -(1 << 63)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to folder; returns (file, docs, ids), one row per file. Names of files sort as their documents do."""
    spark = docs.sparkSession
    folder = _qualified(spark, folder)
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    sorted_docs = plain.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")

    def batches(it):
        store, root = _open(folder)
        ids_of, part, attempt = chunk_ids(tokenizer), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done, writer = [], Writer()

        def close():
            name = f"part-{part:06d}-{len(done):05d}.tks"
            with store.open_output_stream(f"{root}/.{name}-{attempt}") as out:
                out.write(writer.finish())
            store.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")
            done.append((name, len(writer.ids), writer.n))

        for b in it:
            for doc_id, data in zip(b.column(0).to_pylist(), ids_of.encode_all(b.column(1).to_pylist(), end_id), strict=True):
                writer.add(doc_id, data)
                if writer.n >= FILE_IDS:
                    close()
                    writer = Writer()
        if writer.ids:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["file", "docs", "ids"])

    return table(sorted_docs.mapInArrow(tidy(batches), "file string, docs long, ids long"), "token-file-list")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, file, place) of every document, from the files that files lists."""
    folder = _qualified(spark, folder)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def batches(it):
        store, root = _open(folder)
        for b in it:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as source:
                    ids, sizes, values = read_file(source.read())
                ends = np.cumsum(sizes.astype(np.int64))
                data = memoryview(values.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(np.arange(len(ids), dtype=np.int64)), pa.array(ids), pa.array(ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["file", "place", "id", "inside", "n_tokens", "ids_crc32"])

    rows = files.select("file").repartition(parts, "file").mapInArrow(batches, "file string, place long, id long, inside long, n_tokens long, ids_crc32 long")
    # A row per file: a running sum over so few needs no split.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table(files.select("file", before.alias("before")), "token-file-starts")
    joined = join_small(rows, starts, "file", "inner")
    return joined.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("id"), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file", "place")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "token-files")
    files = write(read_documents(spark, sf_dir, "doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder, files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
