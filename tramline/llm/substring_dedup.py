"""Operator 7, substring dedup: a count-min prefilter, then exact grouping of the windows it lets through.

Pass 1 counts every 13-word window in count-min sketches, one per partition, and
merges them. Counters saturate at two, as only "once" and "more often" matter:
two bits a cell, kept as two bit maps, in two rows of hash cells. Merging goes
segment by segment through a shuffle, one dense segment in memory at a time. A
sketch never underestimates, so a window estimated to occur once does so, and no
repeat is lost. Pass 2 reads the documents again and sends on only the windows
estimated repeated, each distinct window once a chunk of texts: inside a chunk the
smallest document is already known, so a passage that many documents share weighs
little more than another. They are grouped by a 96-bit hash of the words (of 10^13 windows
two different ones agree with a chance of about one in a thousand), in buckets of a range of hashes each, and every document but the smallest loses
the words covered. Windows travel packed, many to a row, which halves the shuffle.

The sketch follows the input (1.5 cells a window at least) up to 2^`max_bits` cells
a row, 2^29 by default: 128 MB for the two rows that are broadcast, by that bound.
For more windows the texts are read and hashed once, their windows written packed by 2, 4, 8, ...
ranges of hashes, and both passes run over one range's files after the other, each
with a sketch of its own: the filter and the buckets are as good, and a window costs as much, at any size.

Defined results: a null text has no words; texts with fewer words than a window
lose none; a null doc_id counts as smaller than any other; rows sharing a doc_id
never make each other lose words; an empty table gives an empty table. Texts that
lose no word stay as they are in `dedup_substrings`, others are their kept words
joined by one space.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import fresh, read_documents, set_aside, shared_dir, slices, table, tidy

WINDOW = 13
ROWS = 2
#: Bits of the cell number inside a segment: 512 KB a segment and bit map.
SEGMENT_BITS = 22
#: Bytes up to which a task's table of word hashes grows, and what an entry takes besides the word.
WORD_BYTES, ENTRY_BYTES = 24 << 20, 160
#: Characters hashed together.
CHUNK = 1 << 20
#: Windows that a task holds before it writes them by range (20 bytes each), windows of a written row at most, and tasks that write a range.
HELD, PIECE, SALTS = 1 << 21, 1 << 15, 8
NULL_ID = -(1 << 63)
#: Odd multipliers, one per word of a window, drawn once from a fixed seed.
_DRAW = np.random.default_rng(7)
MULTIPLIERS = _DRAW.integers(1, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """XXH64 of each distinct word, computed once until the table is full and begins anew."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held >= WORD_BYTES:
            self.clear()
            self.held = 0
        self.held += len(word) + ENTRY_BYTES
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def windows(texts: list[str | None], known: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, number of the text, start) of every window of the texts, in that order."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six white characters
        if len(words) >= width:
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            sizes[i] = len(words)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.concatenate(parts)
    n = len(hashes) - width + 1
    sums = np.zeros((2, n), np.uint64)
    for j in range(width):
        for row in range(2):
            sums[row] += hashes[j : j + n] * MULTIPLIERS[row, j]
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = (start + width <= np.repeat(sizes, sizes))[:n]
    return _mix(sums[0][whole]), _mix(sums[1][whole]) & np.uint64(0xFFFFFFFF), owner[:n][whole], start[:n][whole]


def chunks(ids: list, texts: list[str | None]):
    """Runs of rows of about CHUNK characters, in ascending id order, so that equal windows meet early."""
    order = sorted(range(len(ids)), key=lambda i: NULL_ID if ids[i] is None else ids[i])
    part, chars = [], 0
    for i in order:
        part.append(i)
        chars += len(texts[i] or "")
        if chars >= CHUNK:
            yield part
            part, chars = [], 0
    if part:
        yield part


def text_blocks(it, width: int):
    """(h1, h2, owner, start, docs) for each chunk of the texts in batches (id, text); docs() gives (ids, marks) by number of the text, in ascending id order."""
    known = WordHashes()
    for b in it:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for part in chunks(ids, texts):

            def docs(part=part):
                own = np.array([NULL_ID if ids[i] is None else ids[i] for i in part], np.int64)
                return own, np.array([zlib.crc32((texts[i] or "").encode("utf-8", "surrogatepass")) for i in part], np.uint32)

            yield *windows([texts[i] for i in part], known, width), docs


def dealt_blocks(it):
    """The blocks in batches (h1, h2, refs, docs) of one range, as `deal` packs them."""
    for b in it:
        for i in range(b.num_rows):
            h1, h2, refs, docs = (b.column(k)[i].as_py() for k in range(4))
            ids, marks = _columns(docs, "<i8", "<u4")
            owner, start = _columns(refs, "<u4", "<u4")
            yield np.frombuffer(h1, "<u8"), np.frombuffer(h2, "<u4").astype(np.uint64), owner.astype(np.int64), start.astype(np.int64), lambda ids=ids, marks=marks: (np.cumsum(ids), marks)


def deal(blocks, range_bits: int, held_most: int):
    """Batches (range, h1, h2, refs, docs) of the windows of blocks, packed by range, about held_most windows at a time.

    The bits of its range, equal in all windows of a row, are shifted out of h1.
    """
    held, n = [], 0
    for block in blocks:
        if len(block[0]):
            held.append(block[:4] + block[4]())
            n += len(block[0])
        if n >= held_most:
            yield from _dealt(held, range_bits)
            held, n = [], 0
    if held:
        yield from _dealt(held, range_bits)


def _dealt(held: list, range_bits: int):
    moved = np.cumsum([0, *[len(x[4]) for x in held[:-1]]])
    h1, h2, start, own, marks = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3, 4, 5))
    owner = np.concatenate([x[2] + k for x, k in zip(held, moved, strict=True)])
    held.clear()
    ascending = np.argsort(own, kind="stable")
    rank = np.empty(len(own), np.int64)
    rank[ascending] = np.arange(len(own))
    owner, own, marks = rank[owner], own[ascending], marks[ascending]
    place = (h1 >> np.uint64(64 - range_bits)).astype(np.int32)
    order = np.lexsort((owner, place))
    h1, h2, owner, start, place = h1[order] << np.uint64(range_bits), h2[order].astype("<u4"), owner[order], start[order].astype("<u4"), place[order]
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
    rows, size = [[], [], [], [], []], 0
    pieces = [(k, min(k + PIECE, z)) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for k in range(a, z, PIECE)]
    for a, z in pieces:
        used, ref = np.unique(owner[a:z], return_inverse=True)
        for column, value in zip(rows, (int(place[a]), h1[a:z].astype("<u8").tobytes(), h2[a:z].tobytes(), _pack(ref.astype("<u4"), start[a:z]), _pack(np.diff(own[used], prepend=np.int64(0)).astype("<i8"), marks[used].astype("<u4"))), strict=True):
            column.append(value)
        size += 12 * (z - a)
        if size >= 4 << 20 or z == len(place):
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], ["range", "h1", "h2", "refs", "docs"])
            rows, size = [[], [], [], [], []], 0


def dealt_windows(docs: DataFrame, width: int, range_bits: int, parts: int, held_most: int = HELD) -> DataFrame:
    """(h1, h2, refs, docs, range): every window hashed once and written packed, in folders by range, so that a range is read without the others.

    A range's rows go to up to SALTS tasks, which write a file each, so there are few files and no task has a range to itself.
    """
    spark = docs.sparkSession
    rows = docs.mapInArrow(tidy(lambda it: deal(text_blocks(it, width), range_bits, held_most)), "range int, h1 binary, h2 binary, refs binary, docs binary")
    path = shared_dir(spark, "dealt-windows")
    rows.repartition(max(parts, 1 << range_bits), "range", F.pmod(F.crc32("docs"), F.lit(SALTS))).write.partitionBy("range").parquet(path)
    return spark.read.schema("h1 binary, h2 binary, refs binary, docs binary, range int").parquet(path)


def cells_of(h1: np.ndarray, h2: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each window in the two rows of a sketch with 2^bits cells a row."""
    return (h1 >> np.uint64(64 - bits)).astype(np.int64), (_mix(h1 * MULTIPLIERS[1, 63] + h2) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """Two saturating bits a cell: `once` and `more`, as bit maps of ROWS rows."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
        self.more = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)

    def add(self, row: int, cells: np.ndarray) -> None:
        cells = np.sort(cells)
        first = np.ones(len(cells), bool)
        np.not_equal(cells[1:], cells[:-1], out=first[1:])
        at, value = _bytes(cells[first])
        again = self.once[row, at] & value
        self.once[row, at] |= value
        self.more[row, at] |= again
        at, value = _bytes(np.unique(cells[~first]))
        self.more[row, at] |= value


def _bytes(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct cells as byte numbers and the bits to set there."""
    if not len(cells):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    byte = cells >> 3
    starts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    return byte[starts], np.bitwise_or.reduceat((1 << (cells & 7)).astype(np.uint8), starts)


def pack_cells(bitmap: np.ndarray) -> bytes:
    """The set bits of a bit map as gaps of one byte each, 255 for "255 further and no bit yet"."""
    gaps = np.diff(np.flatnonzero(np.unpackbits(bitmap, bitorder="little")), prepend=-1)
    far = gaps // 255
    out = np.full(len(gaps) + int(far.sum()), 255, np.uint8)
    out[np.cumsum(far + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack_cells(data: bytes, size: int) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    bits = np.zeros(size * 8, np.uint8)
    bits[np.cumsum(gaps, dtype=np.int64)[gaps != 255] - 1] = 1
    return np.packbits(bits, bitorder="little")


def sketch_windows(source: DataFrame, blocks, bits: int) -> list[tuple[int, bytes]]:
    """The merged `more` bit maps of the windows that blocks finds in source as (segment, compressed bytes), of both rows one after the other."""
    size = 1 << (min(bits, SEGMENT_BITS) - 3)
    per_row = (1 << (bits - 3)) // size

    def count(it):
        sketch = Sketch(bits)
        for h1, h2, owner, _, _ in blocks(it):
            if len(h1):
                order = np.argsort(h1, kind="stable")
                h1, h2, owner = h1[order], h2[order], owner[order]
                fresh = np.concatenate([[True], (h1[1:] != h1[:-1]) | (owner[1:] != owner[:-1])])  # once a document
                for row, cells in enumerate(cells_of(h1[fresh], h2[fresh], bits)):
                    sketch.add(row, cells)
        for row in range(ROWS):
            for k in range(per_row):
                once, more = sketch.once[row, k * size : (k + 1) * size], sketch.more[row, k * size : (k + 1) * size]
                if once.any():
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([row * per_row + k], pa.int32()), "once": [pack_cells(once)], "more": [pack_cells(more)]})

    def merge(it):
        segment, once, more = None, None, None
        for b in it:
            for k, x, y in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                x, y = unpack_cells(x, size), unpack_cells(y, size)
                if k != segment:
                    if segment is not None:
                        yield _merged(segment, more)
                    segment, once, more = k, x, y
                else:
                    more |= y | (once & x)
                    once |= x
        if segment is not None:
            yield _merged(segment, more)

    parts = source.mapInArrow(tidy(count), "segment int, once binary, more binary")
    merged = parts.repartition(ROWS * per_row, "segment").sortWithinPartitions("segment").mapInArrow(tidy(merge), "segment int, more binary")
    # Bounded by the sketch: ROWS * 2^bits / 8 bytes in all.
    return [(r["segment"], bytes(r["more"])) for r in merged.collect()]


def _merged(segment: int, more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "more": [zlib.compress(more.tobytes(), 1)]})


def cell_bits(docs: DataFrame, max_bits: int) -> tuple[int, int]:
    """(bits of the cells a row, bits of the ranges): together the power of two over 1.5 cells for each window that the texts can hold."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    need = int(max(np.ceil(np.log2(max(1.5 * chars / 6, 1))), 16))
    return min(need, max_bits), max(need - max_bits, 0)


def judged_range(source: DataFrame, blocks, bits: int, parts: int, written: bool) -> DataFrame | str:
    """(part, docs): starts that go among the windows that blocks finds in source; if written, the folder that holds them."""
    spark = source.sparkSession
    found = spark.sparkContext.broadcast(sketch_windows(source, blocks, bits))
    size = 1 << (min(bits, SEGMENT_BITS) - 3)
    # A bucket holds the windows of a range of hashes, about 2^20 before the filter.
    bucket_bits = max(bits - 21, 4)

    def candidates(it):
        more = np.zeros(ROWS * (1 << (bits - 3)), np.uint8)
        for segment, data in found.value:
            more[segment * size : (segment + 1) * size] = np.frombuffer(zlib.decompress(data), np.uint8)
        more = more.reshape(ROWS, -1)
        for h1, h2, owner, start, docs in blocks(it):
            passed = np.ones(len(h1), bool)
            for row, cells in enumerate(cells_of(h1, h2, bits)):
                passed &= (more[row, cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
            if passed.any():
                yield from _send(h1[passed], h2[passed], owner[passed], start[passed], *docs(), bucket_bits, parts)

    def judge(it):
        for _, blobs in _runs(it):
            open_ = [_unpack(x) for x in blobs if x["h1"] is not None]
            yield from (_reply(x["part"], x["docs"]) for x in blobs if x["h1"] is None)
            if open_:
                h1, h2, ids, marks, starts = (np.concatenate(x) for x in zip(*open_, strict=True))
                order = np.lexsort((ids, h2, h1))
                h1, h2, ids, marks, starts = h1[order], h2[order], ids[order], marks[order], starts[order]
                head = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
                lost = ids > ids[np.flatnonzero(head)][np.cumsum(head) - 1]
                yield from _replies(ids[lost], marks[lost], starts[lost], parts)

    sent = source.mapInArrow(tidy(candidates), SENT)
    judged = sent.repartition(max(parts, 1 << min(bucket_bits, 16)), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(judge), REPLY)
    if not written:
        return judged
    path = shared_dir(spark, "judged-windows")
    judged.write.parquet(path)
    found.destroy()
    return path


def repeated_windows(docs: DataFrame, width: int = WINDOW, max_bits: int = 29) -> DataFrame:
    """(id, mark, starts): starts of windows whose words also start in a document with a smaller id.

    docs: (id long, text). mark is the crc32 of the text, which tells rows apart that share an id.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, range_bits = cell_bits(docs, max_bits)
    docs = docs.select(F.col("id").cast("long").alias("id"), "text")
    if range_bits:
        # Each range is written, so that its sketch can go before the next.
        dealt = dealt_windows(docs, width, range_bits, parts)
        judged = [judged_range(dealt.filter(F.col("range") == at).drop("range"), dealt_blocks, bits, parts, True) for at in range(1 << range_bits)]
    else:
        judged = [judged_range(docs, partial(text_blocks, width=width), bits, parts, False)]
    replies = judged[0] if len(judged) == 1 else docs.sparkSession.read.schema(REPLY).parquet(*judged)

    def gather(it):
        for _, blobs in _runs(it, "part"):
            ids, marks, starts = (np.concatenate(x) for x in zip(*[_columns(x["docs"], "<i8", "<u4", "<u4") for x in blobs], strict=True))
            order = np.lexsort((starts, marks, ids))
            ids, marks, starts = ids[order], marks[order], starts[order]
            heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(ids)).astype(np.int32)), pa.array(starts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[heads]), pa.array(marks[heads].astype(np.int64)), lists], ["id", "mark", "starts"])

    return table(replies.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(gather), "id long, mark long, starts array<int>"), "repeated-windows")


REPLY = "part int, docs binary"
#: Rows between the tasks hold many windows each, as columns of bytes. Without h1: starts known to go, on their way to `part`.
SENT = "bucket int, part int, h1 binary, h2 binary, refs binary, docs binary"


def _send(h1, h2, owner, start, own, marks, bucket_bits, parts):
    """Rows for one chunk: the occurrences in the smallest document of each window, and what is known to go already."""
    order = np.lexsort((start, owner, h2, h1))  # chunks come in ascending id order
    h1, h2, owner, start = h1[order], h2[order], owner[order], start[order]
    key = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    stays = own[owner] == own[owner[np.flatnonzero(key)]][np.cumsum(key) - 1]
    gone = ~stays
    for b in _replies(own[owner[gone]], marks[owner[gone]], start[gone], parts):
        part = b.column(0)
        empty = pa.nulls(len(part), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(part.to_numpy() % (1 << bucket_bits), pa.int32()), part, empty, empty, empty, b.column(1)], schema=_SENT)
    h1, h2, owner, start = h1[stays], h2[stays], owner[stays], start[stays]
    bucket = (h1 >> np.uint64(64 - bucket_bits)).astype(np.int32)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    rows = [[], [], [], [], []]
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        used, ref = np.unique(owner[a:z], return_inverse=True)
        rows[0].append(int(bucket[a]))
        rows[1].append(h1[a:z].astype("<u8").tobytes())
        rows[2].append(h2[a:z].astype("<u4").tobytes())
        rows[3].append(_pack(ref.astype("<u4"), start[a:z].astype("<u4")))
        rows[4].append(_pack(np.diff(own[used], prepend=np.int64(0)).astype("<i8"), marks[used].astype("<u4")))
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.nulls(len(rows[0]), pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], schema=_SENT)


_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("refs", pa.binary()), ("docs", pa.binary())])


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length, their bytes turned so that like ones stand together, compressed."""
    return zlib.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), 1)


def _columns(data: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zlib.decompress(data), np.uint8), 0, []
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    for t in map(np.dtype, types):
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def _unpack(x: dict):
    h1, h2 = np.frombuffer(x["h1"], "<u8"), np.frombuffer(x["h2"], "<u4")
    ref, start = _columns(x["refs"], "<u4", "<u4")
    ids, marks = _columns(x["docs"], "<i8", "<u4")
    return h1, h2, np.cumsum(ids)[ref], marks[ref], start


def _reply(part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "docs"])


def _replies(ids, marks, starts, parts):
    """Starts that go, packed for the partition that will gather each document's."""
    if len(ids):
        part = (ids % parts).astype(np.int32)
        order = np.lexsort((starts, ids, part))
        ids, marks, starts, part = ids[order], marks[order], starts[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        data = [_pack(ids[a:z].astype("<i8"), marks[a:z].astype("<u4"), starts[a:z].astype("<u4")) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(data, pa.binary())], ["part", "docs"])


def _runs(it, key: str = "bucket"):
    """(key, rows) for each run of equal keys in sorted batches, one run in memory at a time."""
    now, held = None, []
    for b in it:
        for row in b.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def cut(text: str | None, starts, width: int) -> tuple[str, int, int]:
    """(kept words joined by one space, words, words removed) of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if starts is None or not len(starts):
        return b" ".join(words).decode("utf-8", "surrogatepass"), len(words), 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.asarray(starts, np.int64))
    edges[at] += 1
    np.add.at(edges, np.minimum(at + width, len(words)), -1)
    covered = np.cumsum(edges[:-1]) > 0
    kept = [words[i] for i in np.flatnonzero(~covered).tolist()]
    return b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), int(covered.sum())


def removed(docs: DataFrame, width: int = WINDOW, max_bits: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text, n_words and n_removed (replaced if docs has such columns)."""
    docs = docs.drop("kept_text", "n_words", "n_removed")
    own, crc, other, mark, starts_of = fresh([*docs.columns, "kept_text", "n_words", "n_removed"], "own", "crc", "other", "mark", "starts")
    at = docs.columns.index(text_col)
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lost = repeated_windows(plain, width, max_bits).select(F.col("id").alias(other), F.col("mark").alias(mark), F.col("starts").alias(starts_of))
    marked = docs.withColumn(own, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))).withColumn(crc, F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    joined = marked.join(lost.hint("merge"), (F.col(own) == F.col(other)) & (F.col(crc) == F.col(mark)), "left").select(*[f"`{c}`" for c in docs.columns], starts_of)
    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def apply(it):
        for b in slices(it):
            texts, starts = b.column(at).to_pylist(), [None if not x.is_valid else x.values.to_numpy() for x in b.column(b.num_columns - 1)]
            done = [cut(x, s, width) for x, s in zip(texts, starts, strict=True)]
            new = [pa.array([x[0] for x in done], pa.string()), *[pa.array([x[i] for x in done], pa.int64()) for i in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "kept_text", "n_words", "n_removed"])

    return joined.mapInArrow(tidy(apply), schema)


def dedup_substrings(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated words; texts that lose none and all other columns, whatever their names, are unchanged."""
    docs, back = set_aside(docs, "kept_text", "n_words", "n_removed")
    done = removed(docs, width, id_col=id_col, text_col=text_col)
    return back(done.withColumn(text_col, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"`{text_col}`"))))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = removed(read_documents(spark, sf_dir, "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
bad AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM bad),
pos AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
