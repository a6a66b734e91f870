"""Line dedup: rows that share an id, very frequent lines, and columns with names of its own."""

from collections import Counter

from tramline.llm import line_dedup


def plain(rows):
    """(n_lines, n_dropped, kept) of each row, by the definition; ids aren't null."""
    white = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(white))
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), i), i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_rows_of_one_id_lose_only_their_own_lines(spark):
    rows = [(1, "shared line aaaa"), (2, "shared line aaaa\nkeep"), (2, "unique line bbbb\nother unique cc"), (2, None), (3, "")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == plain(rows)


def test_very_frequent_lines(spark):
    rows = [(i, "\n".join([f"A very common line{' ' * (i % 3)}", f"own line number {i}", f"line of a few {i // 4} É", "short"] * (1 + i % 2))) for i in range(300)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=3)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == plain(rows)


def test_names_of_other_columns(spark):
    taken = ["gone", "lines", "kept", "own_id", "own_mark", "other_id", "other_mark", "mark", "pos", "batch", "h1", "n", "_gone", "_id"]
    rows = [(1, "shared line aaaa\nx", *range(len(taken))), (2, "shared line aaaa\ny", *range(len(taken)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in taken))
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert found[2].text == "y" and found[1].text == "shared line aaaa\nx"
    assert [found[2][c] for c in taken] == list(range(len(taken)))


def test_registered_query(spark, tmp_path):
    rows = [(1, "shared line aaaa\nx"), (2, "shared line aaaa"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()}
    import hashlib

    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == {1: (2, 0, digest("shared line aaaa\nx")), 2: (1, 1, digest("")), 3: (1, 0, digest(""))}
