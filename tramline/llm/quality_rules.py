"""Operator 9, quality rules: base rules plus thresholds adapted per language and source.

The thresholds come from quantile sketches that merge exactly: a sketch is a
histogram over fixed bins (`BINS` bins of one unit, beyond them 64 bins a doubling,
without end), one per (lang, source, metric). A quartile beyond `BINS` counts as the
edge of its bin that rejects less, so a sketch is exact up to `BINS` and off by 1/64 of
the value at most beyond, whatever was merged. Partial counts add up on the map side, a
language's sketch is the sum of its sources' sketches, the global one the sum of
all. A group with fewer than `min_rows` documents uses its language's sketch, and
a language with fewer uses the global one: with n documents the rank of a quartile is
off by sqrt(3 / 16 / n) as a standard error, 8 % at 30, which fences three spreads
away forgive. Verdicts are then joined back by
(lang, source), broadcasting the thresholds only after their rows were counted.

Defined results: a null text has no words and one empty line; null lang and
source are groups of their own; repeated rows are judged one by one; an empty
table gives an empty table; other columns pass through. `measure` replaces columns with
one of the names in METRICS and `judge` those called base_failed and kept; `filter_documents` gives back
every column of its input unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import WHITE, fresh, join_small, read_documents, set_aside, slices, table, tidy

SYMBOLS = "#*$%&|<>"
MIN_ROWS = 30
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_used"]
BINS = 4096

#: name: (value as a whole number, least slack over the fence, whether low values are rejected as well)
RATIOS = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 100, False),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines_used, 1)", 300, False),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 200, False),
    "word_length": ("word_chars * 10 div greatest(n_words, 1)", 20, True),
}


def measure_text(text: str | None) -> tuple[int, ...]:
    """The METRICS of one whole text."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six white characters
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that stand in the text twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    codes = dict.fromkeys(words)
    for i, w in enumerate(codes):
        codes[w] = i
    ids, size = np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), len(codes)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:n] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    covered = np.zeros(len(words), bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the METRICS columns added."""
    kept = docs.drop(*METRICS)
    schema = T.StructType(kept.schema.fields + [T.StructField(m, T.LongType()) for m in METRICS])

    def batches(it):
        for b in slices(it):
            found = [measure_text(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            cols = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(METRICS))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *METRICS])

    return kept.mapInArrow(tidy(batches), schema)


def bin_of(value: str) -> Column:
    """The lower edge of a value's bin: the value itself below BINS, its seven leading binary digits from there on."""
    return F.expr(f"if(({value}) < {BINS}, ({value}), shiftleft(shiftright(({value}), length(bin({value})) - 7), length(bin({value})) - 7))")


def top_of(edge: str) -> Column:
    """The largest value of the bin with that lower edge."""
    return F.expr(f"if({edge} < {BINS}, {edge}, {edge} + shiftleft(1L, length(bin({edge})) - 7) - 1)")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def thresholds(measured: DataFrame, min_rows: int = MIN_ROWS, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) with low and high limits of every ratio, from documents that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bin_of(e).alias("bin")) for k, (e, _, _) in RATIOS.items()]))
    cells = (
        measured.filter(~base_failed())
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("v"))
        .groupBy("lang", "source", "v.metric", "v.bin")
        .agg(F.count("*").alias("n"))
    )
    cells = table(cells, "quality-sketches")
    per_lang = cells.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    overall = cells.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    groups = cells.select("lang", "source").distinct()
    own = _fences(cells, ["lang", "source"], min_rows)
    mid = _fences(per_lang, ["lang"], min_rows)
    top = _fences(overall, [], 0)
    names = [f"{k}_{side}" for k in RATIOS for side in ("low", "high")]
    g, o, m = groups.alias("g"), own.alias("o"), mid.alias("m")
    found = g.join(o, F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left").join(m, F.col("g.lang").eqNullSafe(F.col("m.lang")), "left")
    found = found.crossJoin(F.broadcast(top.select(*[F.col(x).alias(f"top_{x}") for x in names])))  # one row
    return found.select("g.lang", "g.source", *[F.coalesce(F.col(f"o.{x}"), F.col(f"m.{x}"), F.col(f"top_{x}")).alias(x) for x in names])


def _fences(cells: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """Quartiles of each sketch, then the fences: three spreads beyond them, and the slack at least."""
    by = Window.partitionBy(*keys, "metric")
    seen = cells.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin")))
    quartiles = seen.filter(F.col("total") >= min_rows).groupBy(*keys, "metric").agg(at(1).alias("q1"), at(3).alias("q3")).withColumn("q3", top_of("q3"))
    columns = []
    for k, (_, slack, both) in RATIOS.items():
        here = F.when(F.col("metric") == k, F.col("q1") - 3 * (F.col("q3") - F.col("q1")) - slack if both else F.lit(-1))
        columns.append(F.max(here).alias(f"{k}_low"))
        columns.append(F.max(F.when(F.col("metric") == k, F.col("q3") + 3 * (F.col("q3") - F.col("q1")) + slack)).alias(f"{k}_high"))
    return quartiles.groupBy(*keys).agg(*columns)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with base_failed and kept; the limits are joined by (lang, source)."""
    limits = table(limits, "quality-limits")
    names = dict(zip(limits.columns, fresh([*measured.columns, "base_failed", "kept"], *limits.columns), strict=True))
    limits = limits.select(*[F.col(c).alias(names[c]) for c in limits.columns])
    joined = join_small(measured, limits, F.col("lang").eqNullSafe(F.col(names["lang"])) & F.col("source").eqNullSafe(F.col(names["source"])))
    inside = F.lit(True)
    for k, (e, _, _) in RATIOS.items():
        inside &= F.coalesce(F.expr(e).between(F.col(names[f"{k}_low"]), F.col(names[f"{k}_high"])), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop(*limits.columns)


def filter_documents(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The documents that the rules keep, with the columns of docs, whatever their names.

    The measured documents are written once, so that texts are measured once
    although the thresholds need all of them first.
    """
    docs, back = set_aside(docs, *METRICS, "base_failed", "kept")
    measured = table(measure(docs), "quality-measured")
    return back(judge(measured, thresholds(measured, min_rows)).filter("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = table(measure(read_documents(spark, sf_dir, "doc_id", "lang", "source", "text")).drop("text"), "quality-measured")
    return judge(measured, thresholds(measured)).select("doc_id", *METRICS[:5], "base_failed", "kept")


def _sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    values = {k: e.replace(" div ", " // ") for k, (e, _, _) in RATIOS.items()}
    cells = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, CASE WHEN {e} < {BINS} THEN {e} ELSE ({e} >> (length(bin({e})) - 7)) << (length(bin({e})) - 7) END AS bin FROM m WHERE NOT base_failed" for k, e in values.items())

    def fences(name: str, keys: str, least: int) -> str:
        k = f"{keys}, " if keys else ""
        return (
            f"{name}_c AS (SELECT {k}metric, bin, sum(n) AS n FROM cells GROUP BY {k}metric, bin), "
            f"{name}_s AS (SELECT *, sum(n) OVER (PARTITION BY {k}metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {k}metric) AS total FROM {name}_c), "
            f"{name} AS (SELECT {k}metric, min(CASE WHEN upto * 4 >= total THEN bin END) AS q1, CASE WHEN min(CASE WHEN upto * 4 >= total * 3 THEN bin END) < {BINS} THEN min(CASE WHEN upto * 4 >= total * 3 THEN bin END) ELSE min(CASE WHEN upto * 4 >= total * 3 THEN bin END) + (CAST(1 AS BIGINT) << (length(bin(min(CASE WHEN upto * 4 >= total * 3 THEN bin END))) - 7)) - 1 END AS q3 FROM {name}_s WHERE total >= {least} GROUP BY {k}metric)"
        )

    tests = []
    for k, (_, slack, both) in RATIOS.items():
        low = f"f.q1 - 3 * (f.q3 - f.q1) - {slack}" if both else "-1"
        tests.append(f"(f.metric = '{k}' AND NOT ({values[k]}) BETWEEN {low} AND f.q3 + 3 * (f.q3 - f.q1) + {slack})")
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{word}')),
lc AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM lines GROUP BY doc_id),
m0 AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lc.d, 0) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lc.n, 0) AS BIGINT) AS n_lines_used
 FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lc USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
cells AS (SELECT lang, source, metric, bin, count(*) AS n FROM ({cells}) GROUP BY ALL),
{fences("f1", "lang, source", MIN_ROWS)}, {fences("f2", "lang", MIN_ROWS)}, {fences("f3", "", 0)},
g AS (SELECT DISTINCT lang, source FROM m),
f AS (SELECT g.lang, g.source, f3.metric, coalesce(f1.q1, f2.q1, f3.q1) AS q1, coalesce(f1.q3, f2.q3, f3.q3) AS q3 FROM g CROSS JOIN f3
 LEFT JOIN f2 ON f2.lang IS NOT DISTINCT FROM g.lang AND f2.metric = f3.metric
 LEFT JOIN f1 ON f1.lang IS NOT DISTINCT FROM g.lang AND f1.source IS NOT DISTINCT FROM g.source AND f1.metric = f3.metric),
bad AS (SELECT DISTINCT m.doc_id FROM m JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source WHERE {" OR ".join(tests)})
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM m LEFT JOIN bad USING (doc_id)"""


SQL = _sql()
