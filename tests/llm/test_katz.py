"""Katz backoff: whole scores against plain code over strings, exact normalisation, odd inputs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tramline.llm import katz

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in WHITE:
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    return out


class Plain:
    """The same model with dictionaries of words."""

    def __init__(self, texts):
        self.one, self.two, self.total = Counter(), defaultdict(Counter), 0
        for text in texts:
            tokens = [*words(text), None]
            self.total += len(tokens)
            self.one.update(tokens)
            for v, w in zip([0, *tokens], tokens):
                self.two[v][w] += 1
        count = lambda values: [sum(x == r for x in values) for r in range(1, 7)]
        self.d1 = self.discounts(count([*self.one.values()]))
        self.d2 = self.discounts(count([x for c in self.two.values() for x in c.values()]))
        left = sum(c * (1 - self.d1(c)) for c in self.one.values())
        self.rest, self.base = (left, self.total) if left > 0 else (1, self.total + 1)

    @staticmethod
    def discounts(n):
        for k in range(5, 1, -1):
            if min(n[: k + 1]) > 0:
                b = (k + 1) * n[k] / n[0]
                d = [(((r + 1) * n[r] / n[r - 1]) / r - b) / (1 - b) if b != 1 else 0 for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return lambda c: d[c - 1] if c <= k else 1.0
        return lambda c: 0.5 if c == 1 else 1.0

    def p1(self, w):
        c = self.one[w]
        return c * self.d1(c) / self.base if c else self.rest / self.base

    def p(self, v, w):
        after = self.two.get(v)
        if not after:
            return self.p1(w)
        c, left = sum(after.values()), sum(x * (1 - self.d2(x)) for x in after.values())
        if left <= 0:
            c, left = c + 1, 1
        if after[w]:
            return after[w] * self.d2(after[w]) / c
        return left / c / (1 - sum(self.p1(x) for x in after if after[x])) * self.p1(w)

    def score(self, text):
        tokens = [*words(text), None]
        known = len(self.one)
        return (len(tokens), sum(self.one[t] > 0 for t in tokens), sum(math.log10((self.one[t] + 1) / (self.total + known + 1)) for t in tokens), sum(math.log10(self.p(v, w)) for v, w in zip([0, *tokens], tokens)))


def rows_of(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["École", "ñ", " x", "A", "a"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", "\t\x0b ", "  "]).join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))
        rows.append((i, text + (f" rare{i}" if i % 5 == 0 else "")))
    # A context whose bigrams are all frequent keeps no mass; repeated rows and ids; long, empty and null texts.
    rows += [(n + i, "only ever " * 12) for i in range(4)] + [(n + 4, None), (n + 5, ""), (n + 5, ""), (n + 6, "x" * 5000), (n + 7, " \n "), (n + 8, "W1 w2 " * 3000), (None, "w1 w2"), (n + 9, "only never")]
    return rows


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("n", [0, 7, 150])
def test_op11_against_plain_code(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(katz, "CHUNK", 2000)
    monkeypatch.setattr(katz, "BLOCK", 700)
    rows = rows_of(n) if n else []
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = Plain([t for i, t in rows if not held_out(i)])
    key = lambda r: (-1 if r[0] is None else r[0], r[2])
    want = sorted([(i, held_out(i), *model.score(t)[:2], model.total, *model.score(t)[2:]) for i, t in rows], key=key)
    found = sorted(map(tuple, katz.op11_lm_scoring(spark, str(tmp_path)).collect()), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want], rtol=1e-9)


def test_probabilities_of_every_context_add_up_to_one():
    rows = rows_of(150)
    model = Plain([t for _, t in rows])
    for v in [0, None, "w1", "only", "ever", "rare5", "unheard"]:
        assert math.isclose(sum(model.p(v, w) for w in model.one) + model.p(v, "unheard"), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None)], "key string, body string")
    found = sorted(map(tuple, katz.scores(docs, "false", "key", "body").collect()))
    assert found == [("a", False, 3, 0, 0, 0.0, 0.0), ("b", False, 1, 0, 0, 0.0, 0.0)]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = np.frombuffer(" ".join(w for _, t in rows_of(80) for w in words(t)).encode(), np.uint8)
    whole = katz.word_hashes(text)
    monkeypatch.setattr(katz, "BLOCK", 64)
    parts = katz.word_hashes(text)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert len(set(whole[0].tolist())) == len(set(bytes(text).split()))


def test_discounts_follow_good_turing():
    d = katz.discounts([100, 40, 20, 12, 8, 5])
    b = 6 * 5 / 100
    assert np.allclose(d[1:], [((r + 1) * x / (r * y) - b) / (1 - b) for r, y, x in [(1, 100, 40), (2, 40, 20), (3, 20, 12), (4, 12, 8), (5, 8, 5)]])
    assert katz.discounts([3, 0, 0, 0, 0, 0]).tolist() == [1.0, 0.5]


def test_rows_sent_do_not_grow_with_documents_times_parts(spark):
    """A document's contexts lie in many parts; what they add comes back in one row of its chunk and part."""
    docs = spark.range(400).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 60), i -> concat('w', cast(id * i % 997 AS string))), ' ') AS text").coalesce(1)
    store, before = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.shuffle.partitions")
    jvm = spark.sparkContext._jvm

    def sent():
        none = jvm.java.util.ArrayList
        stages = store.stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        earlier = sent()
        assert len(katz.scores(docs, "doc_id % 3 > 0").collect()) == 400
        assert sent() - earlier < 400 * 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
