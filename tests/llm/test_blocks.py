"""Candidate groups larger than the pairs that are formed: links are found in blocks, none is lost."""

import random

import numpy as np
import pytest

from tramline.llm import simhash
from tramline.llm.substring_dedup import WordHashes


@pytest.mark.parametrize("group", [4, 64])
def test_large_groups_of_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(group)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 10])):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    known = WordHashes()
    sets = [set(simhash.shingle_set(t, known, 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    near = [[j for j, y in enumerate(sets) if 10 * len(x & y) >= 8 * len(x | y)] for x in sets]
    for _ in rows:
        label = [min(label[j] for j in n) for n in near]
    found = {r.id: r.group_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(rows))] == label
    assert 5 < len(np.unique(label)) < 140
