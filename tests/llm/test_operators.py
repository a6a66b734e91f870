"""Each numbered operator on small tables: defined results for odd rows, and brute force where SQL can't express it."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import ann, line_dedup, packing, piece_codec, quality_classifier, quality_rules, simhash, simple8b, substring_dedup, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(seed, n=200, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "a" * 50_000, "x y " * 20_000, "é 日本 \x0b z", "same text here", "same text here"]


# --- 1 toxicity


def test_trie_finds_misspelled_terms():
    trie = toxicity.Trie({"scoundrel": 3.0, "fool": 2.0, "ape": 1.0})
    assert trie.near("fool") == ("fool", 0)
    assert trie.near("foool") == ("fool", 1) and trie.near("fol") == ("fool", 1) and trie.near("fopl") == ("fool", 1)
    assert trie.near("scoumdrl") == ("scoundrel", 2)
    assert trie.near("apes") is None  # three letters: exact only
    assert trie.near("harmless") is None


def test_trie_equals_all_distances():
    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 12)))
    terms = {word(): rng.random() for _ in range(30)}
    trie = toxicity.Trie(terms)
    for _ in range(400):
        w = word()
        best = min(((d, -terms[t], t) for t in terms if (d := far(w, t)) <= toxicity.errors_allowed(len(t))), default=None)
        assert trie.near(w) == (best and (best[2], best[0])), w


def test_context_separates_quotation():
    m = toxicity.Matcher({"scoundrel": 3.0})
    plain, quoted, told = (m.features(t) for t in ("what a scoundrel", 'the sign "scoundrel" hangs there', "they said scoundrel once"))
    assert plain[0] > 0 and plain[2] == 0
    assert quoted[0] == 0 and quoted[2] > 0 and told[2] > 0
    assert quoted[4] < plain[4]
    assert m.features(None) == m.features("") == [0.0] * 5


def test_toxicity_scores(spark):
    texts = [prose(i, 60) + (" vile rotten brute" if i % 4 == 0 else "") for i in range(200)]
    d = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d.select("doc_id", "text"), labels)
    found = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert len(found) == len(texts) + len(ODD)
    assert all((found[i] >= 0.7) == (i % 4 == 0) for i in range(200))
    assert found[200] == found[201] < 0.5
    assert toxicity.score(d.limit(0), model).count() == 0
    none = toxicity.fit(d.select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.5}


# --- 2 packing


def test_best_bounds_are_optimal():
    rng = random.Random(3)
    for _ in range(30):
        lengths = sorted(rng.randrange(1, 30) for _ in range(rng.randrange(1, 12)))
        hist = sorted(Counter(lengths).items())
        sizes, counts = np.array([n for n, _ in hist]), np.array([c for _, c in hist])
        k = rng.randrange(1, 5)
        bounds = packing.best_bounds(sizes, counts, sizes * counts, k)
        cost = lambda b: sum(min(x for x in b if x >= n) - n for n in lengths)
        from itertools import combinations

        best = min(cost((*c, sizes[-1])) for r in range(min(k, len(sizes))) for c in combinations(sizes[:-1].tolist(), r))
        assert cost(bounds) == best and len(bounds) <= k


def test_packing_odd_rows(spark):
    d = docs(spark, ODD, [None, 1, 2, 3, 4, 5, 6, 7, 7])
    rows = packing.pack(d.withColumn("bucket", F.lit("clash")), buckets=3, budget=64).collect()
    assert len(rows) == len(ODD)
    assert {r.id: r.n_tokens for r in rows} == {None: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 40_000, 6: 3, 7: 3}
    for key, group in _grouped(rows, lambda r: (r.bucket, r.batch)).items():
        assert len(group) * group[0].bucket_length <= 64 or len(group) == 1, key
        assert sorted(r.slot for r in group) == list(range(len(group)))
    assert packing.pack(d.limit(0)).count() == 0


def _grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


# --- 3 line dedup


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "", "  LINE number 1 of the pool\t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12))) for _ in range(60)] + [None, "a" * 100_000 + "\n" + pool[0]]
    ids = list(range(len(texts)))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    owner = {}
    for i, t in zip(ids, texts, strict=True):
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), i)
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts, ids).withColumn("n_lines", F.lit("clash")), batches=batches, fanout=fanout).collect()}
        for i, t in zip(ids, texts, strict=True):
            lines = (t or "").split("\n")
            kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
            assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(docs(spark, texts, ids).limit(0)).count() == 0


def test_line_dedup_null_and_equal_ids(spark):
    d = docs(spark, ["a line of text", "a line of text", "a line of text\nother words here", "a line of text"], [None, 5, 7, 7])
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in line_dedup.dedup_lines(d, batches=2).collect())
    assert got == [(-1, "a line of text"), (5, ""), (7, ""), (7, "other words here")]


# --- 4 token files


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 2), (1, 2), (240, 1), (5000, 2), (9000, 50_000), (9000, 1 << 31), (5000, 1 << 63)):
        values = rng.integers(0, top, n, dtype=np.uint64)
        values[n // 3 : n // 2] = 0
        words, offsets = simple8b.encode(values)
        assert (simple8b.decode(words, offsets, n) == values).all()


def test_token_files_round_trip(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, "It's 'QUOTED'\x1c x", "<|endoftext|> a", *[prose(i, 50) for i in range(40)]]
    ids = [None, *range(3, 3 + len(texts) - 1)]
    files = token_files.write(docs(spark, texts, ids), f"file://{tmp_path}/tokens", path)
    got = sorted(token_files.read(spark, f"file://{tmp_path}/tokens", files).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == ids
    plain, start = Tokenizer.from_file(path), 0
    for r, t in zip(got, texts, strict=True):
        expected = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(expected), zlib.crc32(expected.tobytes()))
        start += len(expected)
    none = token_files.write(docs(spark, texts, ids).limit(0), f"file://{tmp_path}/none", path)
    assert token_files.read(spark, f"file://{tmp_path}/none", none).count() == 0


# --- 5 nearest neighbours


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)) * rng.random((1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2005, [None] * 16), (2006, [1.0] * 3), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    v = ann.usable(table)
    found = _grouped(ann.nearest(v, v.filter("id % 50 = 0"), shard_rows=400, query_rows=16).collect(), lambda r: r.query_id)
    assert sorted(found) == list(range(0, 1500, 50))
    hits = 0
    for q, rows in found.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21)) and all(abs(r.score - float(x[r.vec_id] @ x[q])) < 1e-12 for r in rows)
        assert q not in {r.vec_id for r in rows}
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(set(np.argsort(-exact)[:20].tolist()) & {r.vec_id for r in rows})
    assert hits >= 0.9 * 20 * len(found)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(few, few.filter("id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["equal", "lognormal", "one long"])
def test_ann_recall_of_a_whole_shard(spark, kind):
    rng, n = np.random.default_rng(12), ann.SHARD_ROWS
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= {"equal": np.ones(n), "lognormal": rng.lognormal(0, 0.5, n), "one long": np.where(np.arange(n) == 5, 3.0, 1.0)}[kind][:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    found = _grouped(ann.nearest(v, v.filter("id % 410 = 0")).collect(), lambda r: r.query_id)
    assert sorted(found) == list(range(0, n, 410))
    hits = 0
    for q, rows in found.items():
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(set(np.argsort(-exact)[:20].tolist()) & {r.vec_id for r in rows})
    assert hits >= 0.95 * 20 * len(found)


def test_ann_lengths_beyond_squares(spark):
    x = np.random.default_rng(13).standard_normal((600, 8)) * np.repeat([1e-200, 1.0], 300)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    assert ann.nearest(v, v.filter("id % 300 = 1")).count() == 40


# --- 6 sentence pieces


def test_piece_codec_equals_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, "a ", " a", "a  b", "▁ a▁", "<s> </s>", "\x00\n \n", *[prose(i, 60) for i in range(20)]]
    d = docs(spark, texts)
    got = {r.id: r for r in piece_codec.digests(d, path).collect()}
    whole = {r.doc_id: r for r in piece_codec.decode(piece_codec.encode(d.withColumn("ids", F.lit("clash")), path), path).collect()}
    for i, t in enumerate(texts):
        ids = [plain.bos_id(), *plain.encode(t or ""), plain.eos_id()]
        back = plain.decode(ids)
        assert whole[i].ids == ids and whole[i].decoded == back
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert piece_codec.encode(d.limit(0), path).count() == 0


# --- 7 substring dedup


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(9)
    passages = [prose(100 + i, 40, 10_000) for i in range(4)]
    texts = [prose(i, rng.randrange(0, 60), 10_000) + " " + rng.choice(passages) + "\n" + prose(50 + i, 20, 10_000) for i in range(40)] + ODD + ["x y " * 300]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    owner = {}
    words = {i: (t or "").encode().split() for i, t in zip(ids, texts, strict=True)}
    for i in sorted(ids):
        for k in range(len(words[i]) - 12):
            owner.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.removed(docs(spark, texts, ids).repartition(3).withColumn("n_words", F.lit("clash"))).collect()}
    for i in ids:
        gone = set()
        for k in range(len(words[i]) - 12):
            if owner[tuple(words[i][k : k + 13])] != i:
                gone.update(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(words[i]) if k not in gone).decode()
        assert (got[i].kept_text, got[i].n_words, got[i].n_removed) == (kept, len(words[i]), len(gone)), i
    assert substring_dedup.removed(docs(spark, texts, ids).limit(0)).count() == 0


def test_substring_dedup_null_and_equal_ids(spark):
    p = prose(1, 30, 10_000)
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.removed(docs(spark, [p, p, p, p + " tail"], [None, 4, 9, 9])).collect())
    assert got == {(None, 0): 1, (4, 30): 1, (9, 30): 2}


def test_sketch_never_underestimates():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 1 << 16, 30_000)
    sketch = substring_dedup.Sketch(16)
    for part in np.array_split(cells, 7):
        sketch.add(0, part)
    count = np.bincount(cells, minlength=1 << 16)
    bits = np.unpackbits(sketch.more[0], bitorder="little")
    assert ((count >= 2) == (bits == 1)).all()
    packed = substring_dedup.pack_cells(sketch.more[0])
    assert (substring_dedup.unpack_cells(packed, len(sketch.more[0])) == sketch.more[0]).all()


# --- 8 simhash


def test_fingerprint_by_definition():
    import xxhash

    for text in ("One two THREE four five", "one two", "", None, prose(3, 70)):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        expected = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
        assert simhash.fingerprint(text) % 2**64 == expected


@pytest.mark.parametrize("small", [8, 0])
def test_components_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    rng = random.Random(4)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    centre = rng.getrandbits(64)
    prints += [centre ^ 1 << i ^ 1 << j for i in range(14) for j in range(i)] + [0, 0, 2**64 - 1]
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    found = {r.fp: r.component_id for r in simhash.components(spark.createDataFrame(list(enumerate(signed)), "id long, fp long")).collect()}
    assert all(found[signed[i]] == root(i) for i in range(len(prints)))


def test_near_duplicates_odd_rows(spark):
    got = {r.id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs(spark, ODD).withColumn("fp", F.lit("clash"))).collect()}
    assert got[0] == got[1] == got[2] == (0, 0)
    assert got[8][1] == 7
    assert simhash.near_duplicates(docs(spark, ODD).limit(0)).count() == 0


def _copies():
    texts = []
    for g in range(8):
        base = prose(g, 120, 5000).split()
        for k in range(6):
            changed = list(base)
            for n in range(k):
                changed[(17 * n + 5 * k) % 120] = f"z{g}{k}{n}"
            texts.append(" ".join(changed))
    return texts


def test_similar_groups_against_all_pairs(spark):
    texts = _copies() + ODD
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    found = {r.id: r.group_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert found == {i: root(i) for i in range(len(texts))}
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i}


# --- 9 quality rules


def test_quality_measures():
    assert quality_rules.measure_text(None) == (0, 0, 0, 0, 0, 0)
    assert quality_rules.measure_text("a b c a b c d") == (7, 7, 0, 0, 6, 1)
    assert quality_rules.measure_text("é# 日\n\né# 日\n  ") == (4, 6, 2, 1, 0, 2)
    assert quality_rules.measure_text("a " * 100)[4] == 100


def test_quality_rules_judge_outliers(spark):
    texts = [prose(i, 150) for i in range(300)] + [" ".join(f"w{k}###" for k in range(150)), "tiny", "one two three " * 60] + ODD
    d = docs(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang")))
    measured = quality_rules.measure(d)
    rows = {r.doc_id: r for r in quality_rules.judge(measured, quality_rules.thresholds(measured)).collect()}
    assert all(rows[i].kept for i in range(300))
    assert not rows[300].kept and not rows[300].base_failed
    assert rows[301].base_failed and rows[302].base_failed and all(rows[i].base_failed for i in range(303, len(texts)))
    kept = quality_rules.filter_documents(d)
    assert kept.columns == d.columns and kept.count() == 300
    assert quality_rules.filter_documents(d.limit(0)).count() == 0


# --- 10 quality classifier


def test_quality_classifier_votes(spark):
    texts = [prose(i, 80) if i % 5 else " | ".join(f"q{k * i % 97}!!" for k in range(80)) for i in range(300)]
    d = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    voters = quality_classifier.fit(d.select("doc_id", "text"), labels)
    rows = quality_classifier.score(d, voters).select("*", quality_classifier.held_out(F.col("doc_id"), 5, 0).alias("out")).collect()
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= 0.3) == (r.doc_id % 5 != 0) for r in rows if r.doc_id < 300)
    assert {r.doc_id for r in rows if r.out} == {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert rows[300].score == rows[301].score == voters.base
    assert quality_classifier.score(d.limit(0), voters).count() == 0
    assert quality_classifier.fit(d.select("doc_id", "text"), labels.limit(0)) is None
