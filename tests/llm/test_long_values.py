"""Quality rules where the usual value lies beyond the exact bins of the sketch."""

from pyspark.sql import functions as F

from tramline.llm import quality_rules


def test_bins_have_no_end(spark):
    values = [0, 1, 4095, 4096, 4159, 4160, 8191, 8192, 8320, (1 << 40) + 5]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bin_of("v").alias("low"))
    rows = rows.withColumn("top", quality_rules.top_of("low")).collect()
    assert all(r.low <= r.v <= r.top for r in rows)
    assert all(r.low == r.v == r.top for r in rows if r.v < quality_rules.BINS)
    assert all((r.top - r.low + 1) * 64 <= r.low for r in rows if r.v >= quality_rules.BINS)


def test_clean_sources_of_long_words_and_many_symbols_stay(spark):
    # Words of about 500 code points (5,000 tenths), and 6 symbols a word.
    rows = [(i, "ja", "plain", 60, 60 * 500 + 60 * (i % 5), 0, 0, 0, 5) for i in range(300)]
    rows += [(1000 + i, "en", "tables", 100, 500, 600 + i % 7, 0, 0, 5) for i in range(300)]
    rows += [(2000, "ja", "plain", 60, 60 * 5000, 0, 0, 0, 5), (2001, "en", "tables", 100, 500, 5000, 0, 0, 5)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{m} long" for m in quality_rules.METRICS))
    kept = {r.doc_id: r.kept for r in quality_rules.judge(measured, quality_rules.thresholds(measured)).select("doc_id", F.col("kept")).collect()}
    assert all(v for k, v in kept.items() if k < 2000)
    assert not kept[2000] and not kept[2001]
