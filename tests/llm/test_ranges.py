"""Substring dedup where the windows outgrow one sketch."""

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, docs, prose
from tramline.llm import substring_dedup


def test_sketch_grows_by_ranges(spark):
    big = spark.range(1).select(F.col("id"), F.lit("a" * 3_000_000).alias("text"))
    assert substring_dedup.cell_bits(big, 29) == (20, 0)
    assert substring_dedup.cell_bits(big, 17) == (17, 3)


def test_ranges_share_out_all_windows(spark):
    """Each window of each text stands in the files of one range, with its text's id, however many a task holds."""
    texts = [prose(i, 400 + i, 10_000) for i in range(12)]
    d = docs(spark, texts, [None if i == 7 else 100 - i for i in range(12)]).select(F.col("doc_id").alias("id"), "text")
    whole = set()
    for i, text in enumerate(texts):
        h1, h2, _, start = substring_dedup.windows([text], substring_dedup.WordHashes(), 13)
        own = substring_dedup.NULL_ID if i == 7 else 100 - i
        whole |= set(zip(h1.tolist(), h2.tolist(), start.tolist(), [own] * len(h1), strict=True))
    for held in (100, 1 << 21):
        files, found = substring_dedup.dealt_windows(d, 13, 3, 4, held), []
        for at in range(8):
            rows = files.filter(F.col("range") == at).drop("range").toArrow().to_batches()
            for h1, h2, owner, start, named in substring_dedup.dealt_blocks(rows):
                own = named()[0][owner]
                found += zip([x >> 3 | at << 61 for x in h1.tolist()], [x for x in h2.tolist()], start.tolist(), own.tolist(), strict=True)
        # The three bits of the range make room for three that were shifted in.
        assert len(found) == len(whole) and {(a >> 3, *x) for a, *x in found} == {(a >> 3, *x) for a, *x in whole}


def test_texts_are_hashed_once_however_many_ranges(spark, tmp_path, monkeypatch):
    """Every pass over the texts leaves a file for each task: with ranges there is one pass, without them two."""
    d = docs(spark, [prose(i, 300, 10_000) for i in range(8)]).repartition(2)
    plain = substring_dedup.text_blocks

    def counted(it, width):
        import tempfile

        tempfile.NamedTemporaryFile(dir=tmp_path, delete=False).close()
        yield from plain(it, width)

    monkeypatch.setattr(substring_dedup, "text_blocks", counted)
    passes = []
    for bits in (29, 14, 12):
        before = len(list(tmp_path.iterdir()))
        found = substring_dedup.repeated_windows(d.select(F.col("doc_id").alias("id"), "text"), max_bits=bits)
        assert found.count() == 0
        passes.append(len(list(tmp_path.iterdir())) - before)
    assert passes[0] == 2 * passes[1] and passes[1] == passes[2] > 0


def test_ranges_equal_one_sketch(spark, monkeypatch):
    rng = random.Random(9)
    passages = [prose(100 + i, 40, 10_000) for i in range(4)]
    texts = [prose(i, rng.randrange(0, 60), 10_000) + " " + rng.choice(passages) + "\n" + prose(50 + i, 20, 10_000) for i in range(40)] + ODD
    d = docs(spark, texts)
    one, four = ({r.doc_id: (r.kept_text, r.n_words, r.n_removed) for r in substring_dedup.removed(d, max_bits=m).collect()} for m in (29, 14))
    monkeypatch.setattr(substring_dedup, "PIECE", 50)
    small = {r.doc_id: (r.kept_text, r.n_words, r.n_removed) for r in substring_dedup.removed(d, max_bits=13).collect()}
    assert one == four == small and sum(x[2] for x in one.values()) > 0
