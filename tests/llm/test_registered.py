"""The registered queries over small tables, held against the libraries or brute force on every row."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tramline.llm import ann, packing, piece_codec, quality_classifier, quality_rules, simhash, substring_dedup, token_files, toxicity

TEXTS = [None, "", "It's a small world, 123 times.", "  spaced\tout \n lines\n\nhere ", "Écoles été naïve — „zitiert“ «dit»", "<|endoftext|> x<|ENDOFTEXT|>", "a" * 3000, "ﬁ ½ ² ª     é", "\x00\x1f\x7f", "word " * 400]


def tables(spark, path, rows, labels=None):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    if labels:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture
def texts(spark, tmp_path):
    return tables(spark, tmp_path, [(10 * i, t, "en", "web") for i, t in enumerate(TEXTS)])


def test_op4(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    start, want = 0, []
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((10 * i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.op4_token_files(spark, texts).collect()) == want


def test_op4_other_tokenizers_encode_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    table, library = token_files.ChunkIds(path), Tokenizer.from_file(path)
    assert not table.apart
    assert list(table.encode_all(TEXTS, 2)) == [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in TEXTS]


def test_op6(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = []
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((10 * i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in piece_codec.op6_piece_codec(spark, texts).collect()) == want


def test_op2_long_documents(spark, tmp_path):
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 40, 4000, 4097, 4099, 4100, 9000, 9001, 20_000]) for _ in range(60)]
    path = tables(spark, tmp_path, [(i, "w " * n, "en", "web") for i, n in enumerate(sizes)])
    found = {r.doc_id: r for r in packing.op2_packing(spark, path).collect()}
    bounds = sorted(set(r.bucket_length for r in found.values()))
    assert all(found[i].n_tokens == n and found[i].bucket_length == min(b for b in bounds if b >= n) for i, n in enumerate(sizes))
    # Ten lengths in eight buckets: the best choice leaves two pairs of neighbours together.
    count, lengths = Counter(sizes), sorted(set(sizes))
    cost = lambda chosen: sum(c * (min(b for b in chosen if b >= n) - n) for n, c in count.items())
    import itertools

    assert cost(bounds) == min(cost([*c, lengths[-1]]) for r in range(8) for c in itertools.combinations(lengths[:-1], r))
    groups = defaultdict(list)
    for r in found.values():
        groups[r.bucket].append((r.doc_id, r.batch, r.slot, r.bucket_length))
    for rows in groups.values():
        room = max(1, packing.BUDGET // max(rows[0][3], 1))
        assert [(b, s) for _, b, s, _ in sorted(rows)] == [(i // room, i % room) for i in range(len(rows))]


def test_op5_recall_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 64)) * rng.lognormal(0, 0.4, (3000, 1))
    ids = list(range(2990)) + [20, 20, 40, 40, 1, 1, 1, 3, 3, 3]
    vectors[2992] = vectors[40]  # 40 three times, twice with one vector; 20 three times with different ones
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)] + [(60, None), (80, [0.0] * 64), (100, [float("nan")] * 64), (120, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = ann.op5_ann(spark, str(tmp_path)).collect()
    asked = Counter(i for i in ids if i % 20 == 0)
    per = Counter(r.query_id for r in found)
    # Each row is a query of its own, but for equal rows, which are one.
    assert per == {i: 20 * (2 if i == 40 else n) for i, n in asked.items()}
    ids, hit, of = np.array(ids), 0, 0
    got = defaultdict(set)
    for r in found:
        assert r.vec_id != r.query_id
        got[r.query_id].add(r.vec_id)
    for i in [x for x, n in asked.items() if n == 1]:
        scores = vectors @ vectors[ids.tolist().index(i)]
        scores[ids == i] = -np.inf
        best = set(ids[np.argsort(-scores)[:20]].tolist())
        hit, of = hit + len(best & got[i]), of + len(best)
    assert hit / of >= 0.9


def test_op8(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    rows = [None, "", "one two", "one two"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        rows += [" ".join(base), " ".join(base).upper(), " ".join([*base, "end"])]
    path = tables(spark, tmp_path, [(i, t, "en", "web") for i, t in enumerate(rows)])
    found = {r.doc_id: r for r in simhash.op8_simhash(spark, path).collect()}
    import xxhash

    def plain(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [plain(t) for t in rows]
    component = list(range(len(rows)))
    for _ in rows:
        for i, p in enumerate(prints):
            component[i] = min(component[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2)
    assert [(found[i].fingerprint, found[i].component_id) for i in range(len(rows))] == [(f"{p:016x}", c) for p, c in zip(prints, component, strict=True)]


def test_op9_thresholds_of_a_source(spark, tmp_path):
    """Symbols are rare in one source and usual in the other; only the odd document of the first goes."""
    rng = random.Random(9)
    text = lambda n: " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(100)), *["#"] * n])
    rows = [(i, text(1), "en", "plain") for i in range(60)] + [(100 + i, text(70), "en", "code") for i in range(60)] + [(500, text(70), "en", "plain")]
    found = {r.doc_id: r.kept for r in quality_rules.op9_quality_rules(spark, tables(spark, tmp_path, rows)).collect()}
    assert [i for i, kept in found.items() if not kept] == [500]


def test_op9_names_of_other_columns(spark):
    docs = spark.createDataFrame([(i, "w " * 3 + " ".join(map(str, range(60))), "en", "web", 7, 8) for i in range(40)], "doc_id long, text string, lang string, source string, _lang int, symbols_low int")
    found = quality_rules.filter_documents(docs)
    assert found.columns == docs.columns and {(r["_lang"], r["symbols_low"]) for r in found.collect()} == {(7, 8)}


def test_op10_against_a_plain_vote(spark, tmp_path):
    rng = random.Random(10)
    words = ["good clear prose", "bad bad bad spam", "neutral text", "click here now", "the model of a garden"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), "en", "web") for i in range(120)] + [(500, None, "en", "web"), (501, "", "en", "web")]
    labels = [(i, i % 2, 0) for i in range(90)]
    path = tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    voters = quality_classifier.fit(docs, spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality"))
    found = {r.doc_id: r for r in quality_classifier.op10_quality_classifier(spark, path).collect()}
    for i, text, *_ in rows:
        counts = quality_classifier.term_counts(text)
        want = voters.base
        if counts.any():
            x = np.log1p(counts) * voters.idf
            x = (x / np.linalg.norm(x) - voters.centre) @ voters.basis
            x = x / np.linalg.norm(x)
            cosines = [round(float(x @ v), 9) for v in voters.vectors]
            near = sorted(range(len(cosines)), key=lambda j: (-cosines[j], j))[: quality_classifier.K]
            weight = [max(cosines[j], 0) ** quality_classifier.SHARPNESS for j in near]
            want = sum(w * voters.labels[j] for w, j in zip(weight, near, strict=True)) / sum(weight)
        row = found[i]
        assert abs(row.score - want) < 1e-6 and row.predicted == (row.score >= 0.3) and row.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quotations():
    text = 'He said "one two" and "never closed\n\nnew «dit\nlonger» end'
    spans = [text[a:z] for a, z in toxicity.quoted_spans(text)]
    assert spans == ['"one two', "«dit\nlonger"]


def test_op7_columns_with_names_of_its_own(spark):
    taken = ["own", "crc", "other", "mark", "starts", "_own", "_id"]
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, *range(7)), (2, f"before {passage} after", *range(7))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in taken))
    found = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert found[1].text == passage and found[2].text == "before after" and [found[2][c] for c in taken] == list(range(7))


def test_near_duplicates_of_rows_sharing_an_id(spark):
    rng = random.Random(3)
    p, r = (" ".join(f"x{rng.randrange(10**6)}" for _ in range(80)) for _ in range(2))
    docs = spark.createDataFrame([(1, r), (2, p), (2, r + " zz"), (3, "other words than these")], "doc_id long, text string")
    found = {x.id: x.group_id for x in simhash.similar_groups(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
