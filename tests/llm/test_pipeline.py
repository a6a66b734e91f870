"""The pipeline on a small corpus against a plain version of every stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    line, passage, base = "A footer that many pages share", text(60), text(150).split()
    texts = [text(120) + ("\n" + line if i % 3 == 0 else "") for i in range(60)]
    texts += [text(60) + " " + passage for _ in range(3)]
    texts += [" ".join(base), " ".join(base[:70] + ["changed"] + base[71:]), " ".join(base)]
    texts += ["too short", None, " ".join(f"{w}###" for w in text(100).split())]
    return list(enumerate(texts))


def plain_stages(rows):
    kept = [(i, t) for i, t in rows if t and quality_rules.measure_text(t)[0] >= 50 and "###" not in t]
    yield {i for i, _ in kept}
    owner, out = {}, []
    for i, t in kept:
        lines = []
        for x in t.split("\n"):
            if len(x.strip().lower()) < 10 or owner.setdefault(x.strip().lower(), i) == i:
                lines.append(x)
        out.append((i, "\n".join(lines)))
    yield dict(out)
    sets, groups = {}, []
    for i, t in out:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        near = [g for g in groups if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in g)]
        groups = [g for g in groups if g not in near] + [[j for g in near for j in g] + [i]]
    first = {min(g) for g in groups}
    out = [(i, t) for i, t in out if i in first]
    yield first
    owner, done = {}, {}
    for i, t in out:
        w, gone = t.split(), set()
        for k in range(len(w) - 12):
            if owner.setdefault(tuple(w[k : k + 13]), i) != i:
                gone.update(range(k, k + 13))
        done[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    yield done
    yield {i: len(t.split()) for i, t in done.items()}


def test_stages_against_plain_versions(spark, tmp_path):
    rows = corpus()
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(path)
    docs, expected = spark.read.parquet(path), plain_stages(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "substring_dedup", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, str(tmp_path))
        after.write.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        docs, want = spark.read.parquet(f"file://{tmp_path}/{k}"), next(expected)
        got = docs.collect()
        if isinstance(want, set):
            assert {r.doc_id for r in got} == want
        elif k < 4:
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
        else:
            assert {r.doc_id: r.n_tokens for r in got} == want
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == len(want)
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_columns_of_documents_stay_whatever_their_names(spark, tmp_path):
    """Columns called like those that the stages make inside pass through all stages but the last unchanged."""
    names = [*quality_rules.METRICS, "base_failed", "kept", "n_lines", "n_dropped", "n_removed", "kept_text", "Kept", "gone", "starts", "mark"]
    own = {(c if c != "Kept" else "kept_"): i for i, c in enumerate(names)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus()]
    docs = spark.createDataFrame(rows, COLUMNS)
    for c, i in own.items():
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}{i}:"), F.col("doc_id")))
    plain = spark.createDataFrame(rows, COLUMNS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after, base = stage(spark, docs, ""), stage(spark, plain, "")
        if k == 4:
            assert after.columns == base.columns and sorted(after.collect()) == sorted(base.collect())
            break
        after.write.parquet(f"file://{tmp_path}/own{k}")
        base.write.parquet(f"file://{tmp_path}/plain{k}")
        before, docs, plain = docs.columns, spark.read.parquet(f"file://{tmp_path}/own{k}"), spark.read.parquet(f"file://{tmp_path}/plain{k}")
        assert docs.columns == before
        assert {r.doc_id: r.text for r in docs.collect()} == {r.doc_id: r.text for r in plain.collect()}
        assert all(r[c] == f"{c}{i}:{r.doc_id}" for r in docs.collect() for c, i in own.items())
