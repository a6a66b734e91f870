"""Operator 13, alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE file of the tokenizers library and encodes a space and the text;
B is a sentencepiece model, which puts that space itself. Byte places where a token of
both ends cut the tokens into groups; a link is a token of A and one of B that share bytes.

The libraries' spans are the coarse cuts: A's character offsets and the byte spans of
sentencepiece's immutable proto (return type "proto" of current versions). A span that
holds as many bytes as its token decodes to is right as it is. Others belong to characters
that several tokens share, whose pieces have the same or an empty span: from the last right
span on, those ends are counted by the decoded bytes.

Neither tokenizer's tokens reach over a space that follows something else than white
space, so a text is a row of marked words, each aligned once by a Python worker
(a table of bounded size) and put together by position. Corpus-wide, documents are
gathered in chunks, written once as a table bucketed by chunk; a chunk sends each
linked id pair with the number of its documents to the part of the pair's hash, one entry however
frequent the pair, and gets the whole counts back, bucket to bucket. The highest count
of each A id is one number for each entry of A's vocabulary, which bounds what is broadcast.

Defined results: null and empty texts, and texts whose tokens don't give back a space
and the text (they hold U+2581), have no tokens; rows sharing an id count as documents
of their own; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tramline.llm.common import read_documents, slices, table, tidy
from tramline.llm.exchange import bucketed, chunk_numbers, cuts_of, packed, packed_keys, unpacked, unpacked_keys
from tramline.llm.piece_codec import MARK, refuse

#: Bytes of text in a chunk of documents, of words aligned together, and words in each half of a worker's table.
CHUNK, TOGETHER, WORDS_KEPT = 3 << 20, 1 << 15, 160_000
#: A marked word: a space and what follows up to the next space after something else than white space.
_WORD = re.compile(r" (?:[^ ]+|(?<=\s) )*")
_MIXED_SPACE = re.compile(r"\s ")
_BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>")
#: An odd factor that spreads pair keys over the parts, and its inverse.
SPREAD = 0x9E3779B97F4A7C15
BACK = pow(SPREAD, -1, 1 << 64)


def byte_level() -> dict[str, int]:
    """The byte of each character of byte-level BPE: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def marked_words(text: str) -> list[str]:
    """The marked words of a space and the text, each without its first space."""
    if _MIXED_SPACE.search(text) or text[0] == " ":
        return [w[1:] for w in _WORD.findall(" " + text)]
    return text.split(" ")


def byte_ends(begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from their spans in bytes and the sizes of their decoded bytes.

    A span is right if it holds its token's bytes and begins where the bytes so far end;
    ends of other tokens are counted on from the last right one.
    """
    counted = np.cumsum(sizes)
    right = (end - begin == sizes) & (begin == counted - sizes)
    last = np.maximum.accumulate(np.where(right, np.arange(len(sizes)), -1))
    base = np.where(last >= 0, end[last] - counted[last], 0)
    return np.where(right, end, base + counted)


class Aligner(dict):
    """marked word -> (links as 64-bit keys, numbers of A tokens, B tokens and groups, groups as text), or None where bytes differ."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.older: dict = {}
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte = byte_level()
        with open(a_path, encoding="utf-8") as f:
            kind = json.load(f)
        if kind["model"]["type"] != "BPE" or (kind.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or kind.get("normalizer"):
            raise ValueError("A has to be a byte-level BPE file without a normalizer")
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in kind["model"]["vocab"].items():
            self.a_bytes[i] = bytes(byte[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        refuse(self.b.serialized_model_proto())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of B crosses a whitespace marker")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) and _BYTE_PIECE.fullmatch(p) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        # Of an empty text the library makes nothing, while a last space of a text is a marker of its own.
        self.lone = [x for i in self.b.encode("a ")[len(self.b.encode("a")) :] for x in (i, -1, 0)]
        self.a_sizes, self.b_sizes = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])
        # Decimal ids of A, then of B, with what follows them in the groups' text: another id, the other side, a group, nothing.
        ids = [*range(len(self.a_bytes)), *range(len(self.b_bytes))]
        self.names = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in ids]

    def tokens(self, text: str):
        """(A ids, their byte ends, B ids, their byte ends) of a text that begins with a space, or None where the bytes differ."""
        data = text.encode()
        encoded = self.a.encode(text, add_special_tokens=False)
        a = np.array(encoded.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        # Character offsets as byte offsets: a byte begins a character unless it is a continuation byte.
        starts = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
        a_ends = byte_ends(starts[spans[:, 0]], starts[spans[:, 1]], self.a_sizes[a])
        # The proto's spans leave out the space that the model puts first; they count from the second byte on.
        spans = [x for p in self.b.encode(text[1:], return_type="proto").pieces for x in (p.id, p.begin, p.end)] or self.lone
        b, begin, end = np.array(spans, np.int64).reshape(-1, 3).T
        begin, end = begin + 1, end + 1
        begin[0] = 0
        b_ends = byte_ends(begin, end, self.b_sizes[b])
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return None
        return a, a_ends, b, b_ends

    def _enter(self, words: list[str]) -> bool:
        """Align the words, which stand one after the other; False where their bytes differ."""
        marked = [" " + w for w in words]
        found = self.tokens("".join(marked))
        if found is None:
            return False
        a, a_ends, b, b_ends = found
        a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
        # Links: the B tokens that share bytes with each A token stand together.
        low, high = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
        n = high - low
        links = (np.repeat(a, n) << 32) | b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        links_to = np.cumsum(n)
        at = np.searchsorted(b_ends, a_ends)  # both ascend to the end of the text
        a_cut = np.flatnonzero(b_ends[at] == a_ends)
        b_cut, both = at[a_cut] + 1, a_ends[a_cut]
        a_cut = a_cut + 1
        word_ends = np.cumsum([len(w.encode()) for w in marked])
        groups_to = np.searchsorted(both, word_ends) + 1
        if (both[groups_to - 1] != word_ends).any():
            raise ValueError("a token reaches over the end of a marked word")
        a_to, b_to = a_cut[groups_to - 1], b_cut[groups_to - 1]
        names, names_to = self._names(a, b, a_cut, b_cut, groups_to), (a_to + b_to).tolist()
        links, ends = links.astype("<u8").tobytes(), (8 * links_to[a_to - 1]).tolist()
        figures = np.diff(np.stack([a_to, b_to, groups_to], 1), axis=0, prepend=0).astype("<i4").tobytes()
        at = name = 0
        for k, (word, end, to) in enumerate(zip(words, ends, names_to, strict=True)):
            self[word] = links[at:end], figures[12 * k : 12 * k + 12], "".join(names[name:to])
            at, name = end, to
        return True

    def _names(self, a, b, a_cut, b_cut, groups_to) -> list[str]:
        """The ids with their marks in the order of the groups' text: a group's A tokens, its B tokens, the next group's."""
        sides = np.empty(2 * len(a_cut), np.int64)
        sides[0::2], sides[1::2] = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
        own = np.repeat(np.arange(len(sides)) & 1, sides)
        ids = np.empty(len(own), np.int64)
        ids[own == 0], ids[own == 1] = a, b + len(self.a_bytes)
        mark = np.zeros(len(ids), np.int64)
        last = np.cumsum(sides) - 1
        mark[last[0::2]], mark[last[1::2]] = 1, 2
        mark[last[1::2][groups_to - 1]] = 3
        return list(map(self.names.__getitem__, (mark * (len(self.names) // 4) + ids).tolist()))

    def learn(self, words) -> None:
        """Align words that are not in the table yet, many at a time; those whose end or bytes say that they can't stand before others, alone."""
        run, size = [], 0
        for word in words:
            if not word or word[-1].isspace() or MARK in word:
                if not self._enter([word]):
                    self[word] = None
                continue
            run.append(word)
            size += len(word) + 1
            if size >= TOGETHER:
                self._together(run)
                run, size = [], 0
        if run:
            self._together(run)

    def _together(self, run: list[str]) -> None:
        if not self._enter(run):
            for word in run:
                if not self._enter([word]):
                    self[word] = None

    def align_all(self, texts: list[str | None]):
        """Each text's (links, figures, groups as text) by marked word, or None where it has no tokens."""
        for at in range(0, len(texts), 128):
            split = [marked_words(t) if t else [] for t in texts[at : at + 128]]
            if len(self) > WORDS_KEPT:  # words still in use are taken over from the older half
                self.older = dict(self)
                self.clear()
            older, new = self.older, [w for w in set().union(*split) if w not in self]
            self.update({w: older[w] for w in new if w in older})
            self.learn([w for w in new if w not in older])
            for words in split:
                found = list(map(self.__getitem__, words))
                yield None if not found or None in found else found


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The table of a Python worker; Spark keeps workers from task to task."""
    return Aligner(a_path, b_path)


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): each text's groups, array<struct<a: array<int>, b: array<int>>>, empty where it has no tokens."""
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def batches(it):
        known = aligner(a_path, b_path)
        for b in it:
            rows = [[] if x is None else [[[*map(int, side.split(","))] for side in g.split("|")] for e in x for g in e[2].split(";")] for x in known.align_all(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"a": x, "b": y} for x, y in row] for row in rows], kind)], ["id", "groups"])

    return plain.mapInArrow(batches, f"id {plain.schema['id'].dataType.simpleString()}, groups array<struct<a: array<int>, b: array<int>>>")


def write_aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs (id, text) aligned, as a table of chunks of documents, bucketed by the chunk's number.

    A chunk holds its documents' ids, figures (A tokens, B tokens, groups, links) and digests of the groups;
    its distinct pairs as ascending spread keys, with the number of its documents that hold each; and
    each document's pairs, as numbers among those, with how often it links them.
    """
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def runs(it):
        ids, texts, size = [], [], 0
        for b in it:
            for part in slices([b], 256):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(t)
                    size += len(t or "")
                    if size >= CHUNK:
                        yield ids, texts
                        ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def align(it):
        known, numbers = aligner(a_path, b_path), chunk_numbers()
        for ids, texts in runs(it):
            figures, digests, links = np.zeros((len(ids), 4), np.int64), [], []
            for k, found in enumerate(known.align_all(texts)):
                if found is None:
                    digests.append("")
                    links.append(b"")
                    continue
                links.append(b"".join([e[0] for e in found]))
                figures[k, :3] = np.frombuffer(b"".join([e[1] for e in found]), "<i4").reshape(-1, 3).sum(0)
                figures[k, 3] = len(links[k]) // 8
                digests.append(hashlib.sha256(";".join([e[2] for e in found]).encode()).hexdigest())
            every = np.frombuffer(b"".join(links), "<u8") * np.uint64(SPREAD)
            keys = np.sort(np.unique(every))  # few beside the links
            which = np.searchsorted(keys, every)
            held, often = np.unique(np.repeat(np.arange(len(ids)), figures[:, 3]) * max(len(keys), 1) + which, return_counts=True)
            doc, pair = np.divmod(held, max(len(keys), 1))
            docs_with = np.bincount(pair, minlength=len(keys)).astype("<i8")
            columns = [packed(figures.ravel().astype("<i8")), packed_keys(keys), packed(docs_with), packed(np.bincount(doc, minlength=len(ids)).astype("<i8")), packed(np.diff(pair, prepend=0).astype("<i4"), often.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers)]), pa.array([ids], pa.list_(id_type)), pa.array([digests]), *[pa.array([x], pa.binary()) for x in columns]], ["chunk", "ids", "digests", "figures", "pairs", "docs_with", "pairs_of", "held"])

    schema = f"chunk long, ids array<{docs.schema['id'].dataType.simpleString()}>, digests array<string>, figures binary, pairs binary, docs_with binary, pairs_of binary, held binary"
    return bucketed(docs.mapInArrow(tidy(align), schema), "chunk", "aligned")


def pair_counts(chunks: DataFrame, parts: int) -> DataFrame:
    """For each part and chunk the corpus-wide document counts of the chunk's pairs there; in one row a part, the highest of each A id there."""

    def send(it):
        for b in it:
            for chunk, pairs, docs_with in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                keys, counts = unpacked_keys(pairs), unpacked(docs_with, "<i8")[0]
                cuts = cuts_of(keys, parts).tolist()
                rows = [(packed_keys(keys[x:y]), packed(counts[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(parts, chunk)), pa.array(np.arange(parts, dtype=np.int32)), *[pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]], ["chunk", "part", "pairs", "counts"])

    def add(t: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x) for x in t["pairs"].to_pylist()]
        sizes = [len(x) for x in keys]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, which, np.concatenate([unpacked(x, "<i8")[0] for x in t["counts"].to_pylist()]))
        whole = [packed(x) for x in np.split(totals[which], np.cumsum(sizes)[:-1])]
        a, group = np.unique((distinct * np.uint64(BACK)) >> np.uint64(32), return_inverse=True)
        best = np.zeros(len(a), np.int64)
        np.maximum.at(best, group, totals)
        none = [None] * (t.num_rows - 1)
        return pa.table([t["chunk"], t["part"], pa.array(whole, pa.binary()), pa.array([a.astype(np.int64), *none], pa.list_(pa.int64())), pa.array([best, *none], pa.list_(pa.int64()))], ["chunk", "part", "totals", "a", "best"])

    sent = chunks.select("chunk", "pairs", "docs_with").mapInArrow(tidy(send), "chunk long, part int, pairs binary, counts binary")
    return table(sent.groupBy("part").applyInArrow(add, "chunk long, part int, totals binary, a array<long>, best array<long>"), "pair-counts")


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs."""
    spark = docs.sparkSession
    chunks = write_aligned(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), a_path, b_path)
    counts = pair_counts(chunks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    # One number for each id of A's vocabulary at most.
    found = counts.filter("a is not null").select(F.explode(F.arrays_zip("a", "best")).alias("x")).groupBy(F.col("x.a").alias("a")).agg(F.max("x.best").alias("best")).toPandas()
    highest = np.zeros(int(found["a"].max()) + 1 if len(found) else 1, np.int64)
    highest[found["a"].to_numpy(np.int64)] = found["best"]
    shared = spark.sparkContext.broadcast(highest)
    id_type = docs.schema[id_col].dataType
    out = pa.schema([("id", to_arrow_type(id_type)), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        figures, pairs, pairs_of, held = (left[c][0].as_py() for c in ("figures", "pairs", "pairs_of", "held"))
        totals = np.concatenate([unpacked(x, "<i8")[0] for x in right.sort_by("part")["totals"].to_pylist()])
        a = ((unpacked_keys(pairs) * np.uint64(BACK)) >> np.uint64(32)).astype(np.int64)
        figures, sizes = unpacked(figures, "<i8")[0].reshape(-1, 4), unpacked(pairs_of, "<i8")[0]
        pair, often = unpacked(held, "<i4", "<i4")
        pair, often = np.cumsum(pair, dtype=np.int64), often.astype(np.int64)
        ends = np.cumsum(sizes)

        def by_doc(x):
            sums = np.append(0, np.cumsum(x))
            return sums[ends] - sums[ends - sizes]

        n_best, count_sum = by_doc(often * (totals == shared.value[a])[pair]), by_doc(often * totals[pair])
        return pa.Table.from_arrays([left["ids"].combine_chunks().flatten(), *[pa.array(x) for x in figures.T], pa.array(n_best), pa.array(count_sum), left["digests"].combine_chunks().flatten().cast(pa.string())], schema=out)

    kept = chunks.select("chunk", "ids", "digests", "figures", "pairs", "pairs_of", "held")
    return kept.groupBy("chunk").cogroup(counts.select("chunk", "part", "totals").groupBy("chunk")).applyInArrow(meet, f"id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_documents(spark, sf_dir, "doc_id", "text")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
