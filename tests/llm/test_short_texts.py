"""Near-duplicates among texts of a few shingles, against all pairs."""

import random

from tests.llm.test_operators import docs, prose
from tramline.llm import simhash


def expected(texts):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
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
    return {i: root(i) for i in range(len(texts))}


def test_short_texts_and_one_more_word(spark):
    texts = []
    for n in range(5, 73):
        base = prose(n, n, 5000)
        texts += [base, base + " more", base + " more and more"]
    random.Random(3).shuffle(texts)
    found = {r.id: r.group_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert found == expected(texts)


def test_chains_past_the_smallest(spark):
    """Texts that slide along one long text, each similar to its neighbours only."""
    words = prose(77, 600, 100_000).split()
    texts = [" ".join(words[k : k + n]) for n in (12, 30, 68) for k in range(0, 300, max(1, (n - 4) // 10))]
    random.Random(4).shuffle(texts)
    found = {r.id: r.group_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert found == expected(texts)
