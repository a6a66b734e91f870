"""Operator 11, language-model scoring: a Katz backoff bigram model, counted, stored and evaluated by Spark.

A token is a word with A-Z lower-cased, or the end of a document; the first token
follows a start mark. A token w after a context v has

    P(w | v) = d(r) * r / c(v)            where the bigram was counted r > 0 times,
    P(w | v) = alpha(v) * P(w)            otherwise, P(w) alone after an unknown v,

with Good-Turing discounts d(r) up to `RELIABLE` counts (Katz 1987), for bigrams and
for single tokens, whose discounted mass is the probability of any unknown word. alpha(v)
is (mass the bigrams after v have left) / (1 - sum of P(w) over the w seen after v),
so every context's probabilities add up to one exactly. A context that keeps no mass,
as all its bigrams are frequent, is given one count more, which is that mass.

Texts are cut into chunks of whole documents, written once, compressed, as a table
bucketed by chunk. From there on:

1. each chunk sends its distinct tokens and bigrams, as sorted 64-bit hashes with
   the counts in training documents, to the parts that the hashes fall in. A part adds
   them up and answers every chunk with the whole counts, marking in one chunk each
   n-gram as owned. The answers are written: the count tables, partitioned by hash;
2. each chunk meets its answers (buckets, so chunks don't move again), scores
   what was seen, and sends what its owned bigrams add to their contexts, together with the
   tokens that have to back off, to the part of the context. That part knows the context's
   weight and returns sums for documents.

Whatever one token, context or bigram is worth in the corpus, it is one entry a
chunk, so a hot one weighs little more than another. N-grams are told apart by 64-bit hashes of
their words (of 10^9 different ones two agree with a chance of about three in a hundred).

Defined results: null and empty texts are one end token; null ids are kept; rows
sharing an id are scored one by one and all count; without training documents every
token is unknown; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tramline.llm.common import read_documents, table, tidy
from tramline.llm.exchange import bucketed, chunk_numbers, cuts_of, packed, packed_keys, unpacked, unpacked_keys

#: Counts up to which Good-Turing discounts hold; higher ones are reliable.
RELIABLE = 5
#: Bytes of text a chunk, and bytes hashed at once.
CHUNK, BLOCK = 6 << 20, 1 << 20
_DRAW = np.random.default_rng(11)
#: Odd random numbers for the bytes and their places, the contexts and the tokens.
_BYTE = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _LEFT, _RIGHT = _DRAW.integers(1, 1 << 63, 3, dtype=np.uint64) * np.uint64(8) + np.uint64(5)
START, END = _DRAW.integers(1, 1 << 63, 2, dtype=np.uint64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of the bytes, hashed over its lower-cased bytes."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # a block ends where a word does
            gap = np.flatnonzero(~_IS_WORD[data[at:end]])
            while not len(gap) and end < len(data):
                more = np.flatnonzero(~_IS_WORD[data[end : end + BLOCK]])
                gap, end = more + (end - at), min(end + BLOCK, len(data))
            end = at + int(gap[-1]) + 1 if len(gap) else len(data)
        part = data[at:end]
        inside = _IS_WORD[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        where = np.flatnonzero(first)
        if len(where):
            heads = np.flatnonzero(first[inside])
            sizes = np.diff(np.append(heads, np.count_nonzero(inside)))
            powers = np.multiply.accumulate(np.full(int(sizes.max()), _PLACE, np.uint64))
            place = np.arange(len(part) - np.count_nonzero(~inside)) - np.repeat(heads, sizes)
            hashes.append(mixed(np.add.reduceat(_BYTE[_LOWER[part[inside]]] * powers[place], heads)))
            starts.append(where + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


class Tokens:
    """The tokens of a chunk, documents one after the other: hash, hash of the context, number of the document."""

    def __init__(self, text: bytes, lengths: np.ndarray):
        words, starts = word_hashes(np.frombuffer(text, np.uint8))
        ends = np.searchsorted(starts, np.cumsum(lengths))
        self.sizes = np.diff(ends, prepend=0) + 1
        last = np.cumsum(self.sizes) - 1
        self.token = np.empty(len(words) + len(lengths), np.uint64)
        plain = np.ones(len(self.token), bool)
        plain[last] = False
        self.token[plain], self.token[last] = words, END
        self.first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        self.context = np.roll(self.token, 1)
        self.context[self.first] = START
        self.doc = np.repeat(np.arange(len(lengths)), self.sizes)

    def bigrams(self) -> np.ndarray:
        return mixed(self.context * _LEFT + self.token * _RIGHT)


def discounts(n: list[int]) -> np.ndarray:
    """d(0), d(1), ...: Good-Turing discounts from the numbers of n-grams counted 1, 2, ... times.

    Where the numbers give no discounts between 0 and 1 up to RELIABLE, the highest limit
    that has them is taken; where there is none, single counts lose a half.
    """
    for most in range(min(RELIABLE, len(n) - 1), 1, -1):
        if min(n[: most + 1]) > 0:
            gone = (most + 1) * n[most] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - gone) / (1 - gone) if gone != 1 else 0.0 for r in range(1, most + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d])
    return np.array([1.0, 0.5])


class Discounted:
    """Counts with their discounts: kept(c) is d(c) * c, left(c) the rest of c."""

    def __init__(self, n: list[int]):
        self.d = np.append(discounts(n), 1.0)

    def kept(self, counts: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(counts, len(self.d) - 1)] * counts

    def left(self, counts: np.ndarray) -> np.ndarray:
        return (1 - self.d[np.minimum(counts, len(self.d) - 1)]) * counts


class Model:
    """What all tasks share: the numbers of n-grams by count, tokens N, distinct tokens V."""

    def __init__(self, ones: list[int], twos: list[int], total: int, distinct: int):
        self.one, self.two, self.total, self.distinct = Discounted(ones), Discounted(twos), total, distinct
        left = float(sum(self.one.left(np.arange(1, RELIABLE + 2)) * np.array(ones)))
        self.rest, self.base = (left, float(total)) if left > 0 else (1.0, total + 1.0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by the count of w; 0 stands for all unknown words together."""
        return np.where(counts > 0, self.one.kept(counts), self.rest) / self.base


CHUNKS = "chunk long, sizes binary, flags binary, text binary"
ANSWER = "chunk long, part int, ones binary, twos binary, stats array<long>"
LINE = "chunk long, pos int, id {}, training boolean, n_tokens long, n_known long, base_score double, score double"


def _texts_in_chunks(rows):
    """(positions, texts, flags) of runs of rows with about CHUNK bytes."""
    run, size = [], 0
    for row in rows:
        run.append(row)
        size += len(row[0])
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def write_chunks(docs: DataFrame) -> DataFrame:
    """docs (id, text, training) as compressed chunks of whole documents, a table bucketed by the chunk's number."""
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def cut(it):
        numbers = chunk_numbers()
        rows = ((x.encode("utf-8", "surrogatepass") if x else b"", i, bool(t)) for b in it for i, x, t in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True))
        for run in _texts_in_chunks(rows):
            # A line feed after each text, so that no word reaches into the next.
            text = zstandard.compress(b"".join(x[0] + b"\n" for x in run), 3)
            sizes, flags = packed(np.array([len(x[0]) + 1 for x in run], "<i8")), packed(np.array([x[2] for x in run], "u1"))
            ids = pa.array([[x[1] for x in run]], pa.list_(id_type))
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *[pa.array([x], pa.binary()) for x in (sizes, flags, text)], ids], ["chunk", "sizes", "flags", "text", "ids"])

    written = docs.mapInArrow(tidy(cut), f"{CHUNKS}, ids array<{docs.schema['id'].dataType.simpleString()}>")
    return bucketed(written, "chunk", "katz-chunks")


def _distinct(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their counts in training documents."""
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, trained, len(found)).astype(np.int64)


def count(chunks: DataFrame, parts: int) -> DataFrame:
    """The count tables: for each part and chunk the counts of the chunk's n-grams there, ascending by hash, owned ones marked."""

    def send(it):
        for b in it:
            for chunk, sizes, flags, text in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                tokens = Tokens(zstandard.decompress(text), unpacked(sizes, "<i8")[0])
                trained = unpacked(flags, "u1")[0][tokens.doc].astype(np.float64)
                rows = [[], [], [], []]
                for n, keys in enumerate((tokens.token, tokens.bigrams())):
                    keys, counts = _distinct(keys, trained)
                    cuts = cuts_of(keys, parts).tolist()
                    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                        rows[2 * n].append(packed_keys(keys[a:z]))
                        rows[2 * n + 1].append(packed(counts[a:z].astype("<i8")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(parts, chunk)), pa.array(np.arange(parts, dtype=np.int32)), *[pa.array(x, pa.binary()) for x in rows]], ["chunk", "part", "keys1", "counts1", "keys2", "counts2"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")  # the owner of an n-gram is its first chunk
        answers, stats = [], []
        for order in (1, 2):
            keys = [unpacked_keys(x) for x in t[f"keys{order}"].to_pylist()]
            sizes = [len(x) for x in keys]
            keys = np.concatenate(keys)
            counts = np.concatenate([unpacked(x, "<i8")[0] for x in t[f"counts{order}"].to_pylist()])
            sort = np.argsort(keys, kind="stable")
            head = np.ones(len(keys), bool)
            head[1:] = keys[sort][1:] != keys[sort][:-1]
            heads = np.flatnonzero(head)
            totals = np.add.reduceat(counts[sort], heads) if len(heads) else counts
            whole, owned = np.empty(len(keys), np.int64), np.zeros(len(keys), np.int64)
            whole[sort] = totals[np.cumsum(head) - 1]
            owned[sort[heads]] = 1
            answers.append([packed(x.astype("<i8")) for x in np.split(whole * 2 + owned, np.cumsum(sizes)[:-1])])
            seen = totals[totals > 0]
            stats.append([*np.bincount(np.minimum(seen, RELIABLE + 2), minlength=RELIABLE + 3)[1 : RELIABLE + 2].tolist(), int(seen.sum()), len(seen)])
        n = t.num_rows
        return pa.table([t["chunk"], t["part"], pa.array(answers[0], pa.binary()), pa.array(answers[1], pa.binary()), pa.array([stats[0] + stats[1], *[None] * (n - 1)], pa.list_(pa.int64()))], ["chunk", "part", "ones", "twos", "stats"])

    sent = chunks.mapInArrow(tidy(send), "chunk long, part int, keys1 binary, counts1 binary, keys2 binary, counts2 binary")
    return table(sent.groupBy("part").applyInArrow(add, ANSWER), "katz-counts")


def model_of(counts: DataFrame) -> Model:
    """The numbers that all tasks share, added up over the parts."""
    width = RELIABLE + 3
    sums = counts.filter("stats is not null").select(*[F.col("stats")[i].alias(f"s{i}") for i in range(2 * width)]).agg(*[F.sum(f"s{i}") for i in range(2 * width)]).first()
    n = [int(x or 0) for x in sums]
    return Model(n[: RELIABLE + 1], n[width : width + RELIABLE + 1], n[width - 2], n[width - 1])


def _score_chunk(model: Model, parts: int, sizes: bytes, text: bytes, ones: np.ndarray, twos: np.ndarray):
    """(the documents' figures, rows for the parts of the contexts) of one chunk with its answers."""
    tokens = Tokens(zstandard.decompress(text), unpacked(sizes, "<i8")[0])
    n_docs = len(tokens.sizes)
    _, at1 = np.unique(tokens.token, return_inverse=True)
    c = (ones >> 1)[at1]
    del at1
    _, place, at2 = np.unique(tokens.bigrams(), return_index=True, return_inverse=True)
    r = (twos >> 1)[at2]
    # A context's count is that of its token; the start mark stands once before each document, as the end after it.
    before = np.roll(c, 1)
    before[tokens.first] = c[tokens.first + tokens.sizes - 1]
    single = model.unigram(c)
    known = before > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log10(np.where(r > 0, model.two.kept(r) / np.maximum(before, 1), single))
    docs = [tokens.sizes, np.bincount(tokens.doc, c > 0, n_docs).astype(np.int64)]
    docs += [np.bincount(tokens.doc, np.log10((c + 1) / (model.total + model.distinct + 1)), n_docs), np.bincount(tokens.doc, logs, n_docs)]

    # What the owned bigrams add to their contexts.
    counted = r[place]
    mine = place[(twos & 1 == 1) & (counted > 0)]
    v, group = np.unique(tokens.context[mine], return_inverse=True)
    left, mass = np.bincount(group, model.two.left(r[mine]), len(v)), np.bincount(group, single[mine], len(v))
    # Tokens that back off after a known context, and all tokens after contexts that keep no mass as far as seen here.
    contexts, which = np.unique(tokens.context, return_inverse=True)
    seen_left = np.bincount(which, np.where(r > 0, model.two.left(r), 0), len(contexts))
    ask = known & ((r == 0) | (seen_left[which] == 0))
    q, q_doc, q_off, q_count = tokens.context[ask], tokens.doc[ask], (r == 0)[ask], before[ask]
    pair = np.lexsort((q_doc, q))
    q, q_doc, q_off, q_count = q[pair], q_doc[pair], q_off[pair], q_count[pair]
    head = np.ones(len(q), bool)
    head[1:] = (q[1:] != q[:-1]) | (q_doc[1:] != q_doc[:-1])
    heads = np.flatnonzero(head)
    if len(heads):
        off, on = np.add.reduceat(q_off.astype(np.int64), heads), np.add.reduceat((~q_off).astype(np.int64), heads)
    else:
        off = on = np.zeros(0, np.int64)
    q, q_doc, q_count = q[heads], q_doc[heads], q_count[heads]
    rows = []
    cuts, asked = cuts_of(v, parts).tolist(), cuts_of(q, parts).tolist()
    for p in range(parts):
        (a, z), (y, x) = cuts[p : p + 2], asked[p : p + 2]
        if z > a or x > y:
            rows.append((p, packed_keys(v[a:z]), packed(left[a:z], mass[a:z]), packed_keys(q[y:x]), packed(q_doc[y:x].astype("<i4"), q_count[y:x].astype("<i8"), off[y:x].astype("<i8"), on[y:x].astype("<i8"))))
    return docs, rows


def scores(docs: DataFrame, training: Column | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    The model learns from the rows where `training` is true. base_score is the sum of
    log10((c + 1) / (N + V + 1)) over the tokens, score the model's log10 probability of the text.
    """
    spark = docs.sparkSession
    training = F.expr(training) if isinstance(training, str) else training
    chunks = write_chunks(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(training, F.lit(False)).alias("training")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    counts = count(chunks.select("chunk", "sizes", "flags", "text"), parts)
    model = model_of(counts)
    id_type = docs.schema[id_col].dataType
    line = LINE.format(id_type.simpleString())
    places = pa.schema([("chunk", pa.int64()), ("pos", pa.int32()), ("id", to_arrow_type(id_type)), ("training", pa.bool_())])
    out = pa.schema([*places, *_FIGURES])
    lines = pa.schema([("part", pa.int32()), *out, *_SENT])
    added = [pa.field("part", pa.int32()), pa.field("plus", pa.binary())]
    weighed = pa.schema([*out, *added])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        ones, twos = (np.concatenate([unpacked(x, "<i8")[0] for x in right[name].to_pylist()]) for name in ("ones", "twos"))
        chunk, sizes, flags, text = (left[c][0].as_py() for c in ("chunk", "sizes", "flags", "text"))
        figures, rows = _score_chunk(model, parts, sizes, text, ones, twos)
        n, m, sent = len(figures[0]), len(rows), list(zip(*rows, strict=True)) or [[]] * 5
        pos = np.arange(n, dtype=np.int32)
        # Documents travel beside the contexts, dealt by their place.
        docs = [pa.array(((pos + np.int64(chunk)) % parts).astype(np.int32)), pa.array(np.full(n, chunk)), pa.array(pos), left["ids"].combine_chunks().flatten(), pa.array(unpacked(flags, "u1")[0] == 1)]
        docs += [pa.array(x, f.type) for x, f in zip(figures, _FIGURES, strict=True)] + [pa.nulls(n, f.type) for f in _SENT]
        asks = [pa.array(sent[0], pa.int32()), pa.array(np.full(m, chunk))] + [pa.nulls(m, f.type) for f in [*places][1:] + _FIGURES] + [pa.array(x, pa.binary()) for x in sent[1:]]
        return pa.concat_tables([pa.Table.from_arrays(docs, schema=lines), pa.Table.from_arrays(asks, schema=lines)])

    def weigh(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """Scored documents as they are, and a row for each chunk that asks: what backing off adds to its documents."""
        t = t.drop_columns(["part"])
        found, t = [t.filter(pc.is_valid(t["pos"])).select(out.names)], t.filter(pc.is_null(t["pos"]))
        found[0] = pa.table([*found[0].columns, *[pa.nulls(found[0].num_rows, f.type) for f in added]], schema=weighed)
        for chunk, doc, add in _backed_off(model, t.sort_by("chunk")):
            columns = {"chunk": chunk, "part": key[0].as_py(), "plus": packed(doc.astype("<i4"), add.astype("<f8"))}
            found.append(pa.table([pa.array([columns.get(f.name)], f.type) for f in weighed], schema=weighed))
        return pa.concat_tables(found)

    def add_up(t: pa.Table) -> pa.Table:
        """The documents of a chunk with all that backing off adds to them, part by part."""
        docs, t = t.filter(pc.is_valid(t["pos"])).select(out.names).sort_by("pos"), t.filter(pc.is_null(t["pos"])).sort_by("part")
        score = docs["score"].to_numpy().copy()
        for plus in t["plus"].to_pylist():
            doc, add = unpacked(plus, "<i4", "<f8")
            score[doc] += add  # a chunk's documents are numbered from 0, and are distinct here
        return docs.set_column(docs.schema.get_field_index("score"), "score", pa.array(score))

    counts = counts.select("chunk", "part", "ones", "twos")
    met = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(meet, f"part int, {line}, contexts binary, adds binary, asked binary, asks binary")
    # A row for each document, and one for each chunk and part, whatever the number of parts that a document's contexts lie in.
    scored = met.groupBy("part").applyInArrow(weigh, f"{line}, part int, plus binary")
    summed = scored.groupBy("chunk").applyInArrow(add_up, line)
    return summed.select("id", "training", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


_FIGURES = [pa.field("n_tokens", pa.int64()), pa.field("n_known", pa.int64()), pa.field("base_score", pa.float64()), pa.field("score", pa.float64())]
#: What goes to the part of a context: hashes and what they are given, hashes asked for and by which documents.
_SENT = [pa.field(c, pa.binary()) for c in ("contexts", "adds", "asked", "asks")]


def _backed_off(model: Model, t: pa.Table):
    """(chunk, documents, what backing off adds to their scores) for each chunk that asks for contexts of one part."""
    if not t.num_rows:
        return
    v = np.concatenate([unpacked_keys(x) for x in t["contexts"].to_pylist()])
    left, mass = (np.concatenate(x) for x in zip(*[unpacked(x, "<f8", "<f8") for x in t["adds"].to_pylist()], strict=True))
    v, group = np.unique(v, return_inverse=True)
    left, mass = np.bincount(group, left, len(v)), np.bincount(group, mass, len(v))
    for chunk, asked, asks in zip(*[t[c].to_pylist() for c in ("chunk", "asked", "asks")], strict=True):
        q = unpacked_keys(asked)
        if len(q):
            doc, c, off, on = unpacked(asks, "<i4", "<i8", "<i8", "<i8")
            at = np.searchsorted(v, q)
            none = left[at] <= 0
            alpha = np.where(none, 1.0, left[at]) / (c + none) / np.maximum(1 - mass[at], model.unigram(np.zeros(1, int))[0])
            add = off * np.log10(alpha) + np.where(none, on * np.log10(c / (c + 1)), 0.0)
            doc, which = np.unique(doc, return_inverse=True)
            yield chunk, doc, np.bincount(which, add, len(doc))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir, "doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    found = scores(docs, ~held_out)
    return found.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
