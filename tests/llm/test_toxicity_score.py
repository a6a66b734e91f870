"""The toxicity score of whole texts against plain code: every word against every term, every hit weighed by its context."""

import math
import random
import re

import numpy as np

from tramline.llm import toxicity

TERMS = {"idiot": 4.0, "stupid": 3.0, "worthless": 5.0, "bad": 2.5, "scumbag": 4.5}
CLEAN = frozenset({"idiom"})
WEIGHTS = np.array([-4.0, 1.5, 0.7, 0.2, 1.1, 0.4])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def plain(text):
    low = (text or "").lower()
    tokens = [(m.group(), m.start()) for m in re.finditer(r"[^\W_]+", low)]
    allowed = lambda t: 0 if len(t) < 4 else 1 if len(t) < 9 else 2
    hits = []
    for i, (word, _) in enumerate(tokens):
        near = [(d, -w, t) for t, w in TERMS.items() if (d := distance(word, t)) <= allowed(t)] if word not in CLEAN else []
        if near:
            hits.append((i, min(near)[0], TERMS[min(near)[2]] * 0.5 ** min(near)[0]))
    if not hits:
        return 1 / (1 + math.exp(-WEIGHTS[0]))
    inside = re.compile('"[^"]*"').finditer(low)
    spans = [m.span() for m in inside if "\n\n" not in m.group()]
    sums, largest = [0.0, 0.0, 0.0], 0.0
    for n, (i, errors, weight) in enumerate(hits):
        around = {w for w, _ in tokens[max(0, i - 8) : i + 9]}
        told = any(a <= tokens[i][1] < z for a, z in spans) or bool(around & toxicity.REPORTING)
        close = any(k != n and abs(h[0] - i) <= 8 for k, h in enumerate(hits))
        if close or {w for w, _ in tokens[max(0, i - 3) : i + 4]} & toxicity.ADDRESS:
            weight *= 1.25
        sums[2 if told else 1 if errors else 0] += weight
        largest = max(largest, weight * (0.25 if told else 1))
    x = [*np.log1p(sums), min(100 * len(hits) / len(tokens), 20) / 10, largest]
    return 1 / (1 + math.exp(-(WEIGHTS[0] + float(np.dot(x, WEIGHTS[1:])))))


def test_score_of_whole_texts(spark):
    rng = random.Random(1)
    words = ["idiot", "idoit", "idiots", "idiom", "stupid", "stupyd", "worthles", "wurthles", "scumbag", "bad", "bed", "you", "said", "the", "garden", "word", "house", "river", "and", "walks"]
    texts = [None, "", "...", "You IDIOT!", 'He called me "an idiot".', 'so "a very long quotation ' + "over many words " * 60 + 'with stupid inside" there']
    for _ in range(120):
        text = " ".join(rng.choice(words[:12] if rng.random() < 0.15 else words[10:]) for _ in range(rng.randrange(1, 80)))
        if rng.random() < 0.4:
            cut = sorted(rng.randrange(len(text) + 1) for _ in range(2))
            text = text[: cut[0]] + '"' + text[cut[0] : cut[1]] + '"' + text[cut[1] :]
        texts.append(text)
    model = toxicity.Model(TERMS, CLEAN, WEIGHTS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(abs(found[i] - plain(t)) < 1e-9 for i, t in enumerate(texts))
    assert len({round(x, 6) for x in found.values()}) > 40


def test_labels_that_are_not_one_or_zero(spark):
    docs = spark.createDataFrame([(i, "you idiot scum" if i % 2 else "a garden by the river") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 3 if i % 2 else 0) for i in range(40)] + [(41, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "idiot" in model.terms and toxicity.score(docs, model).count() == 40
