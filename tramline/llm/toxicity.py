"""Operator 1, toxicity: a lexicon trie meets Levenshtein automata, and context windows weigh each hit.

The lexicon is learned: terms whose document frequency among rows labelled 1
exceeds that among rows labelled 0 by `MIN_ODDS` (log odds) and that `MIN_ROWS` of
the former hold, all of them, from at most `SAMPLE` labelled rows with the smallest
hash of their id. That sample bounds the lexicon; one of more than `LEXICON_MOST`
terms is an error, as it would not fit a broadcast.
It is a trie. For each distinct word of a task a Levenshtein automaton (bit masks
of the places reached with 0, 1, ... errors) walks down the trie, so misspelled
terms are found too: one error from 4 letters on, two from 9. Misspelled forms
that clean labelled rows use are dropped. Every hit is then weighed by its
context: inside quotation marks, however far apart in a paragraph, or beside a word of reporting it counts less,
beside another hit or an address in the second person more. A logistic model over
the document's sums gives the score. No label, language, source or id enters it.

Defined results: a null or empty text has no hits and gets the score of such
texts; without labelled rows of both classes every score is 0.5 (or the only
class's share); a null id is held in; repeated rows are scored one by one; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import read_documents, slices, table, tidy
from tramline.llm.quality_classifier import held_out

SAMPLE = 20_000
LEXICON_MOST = 200_000
MIN_ROWS = 4
MIN_ODDS = 2.5
WORDS_KEPT = 600_000
WINDOW = 8
CUT = 0.7
# Words of reporting and of address, in the four languages of the corpus.
REPORTING = frozenset("said says wrote writes quoted quote called calls reported word term sagte schrieb nannte zitierte wort dit écrit appelé cité mot dijo escribió llamó citó palabra".split())
ADDRESS = frozenset("you your you're du dein dich ihr euch tu ton vous votre toi te ti usted tus".split())
_TOKEN = re.compile(r"[^\W_]+")
#: Marks that open a quotation, with those that close it; a blank line ends what is still open.
QUOTES = {'"': '"', "“": '”"', "„": '“”"', "«": "»", "‘": "’"}
_MARK = re.compile('["“”„«»‘’]|\n[ \t\r]*\n')


def quoted_spans(text: str) -> np.ndarray:
    """(begin, end) of the quotations of a text, in order and apart; marks that nothing closes in their paragraph quote nothing."""
    spans, at, closers = [], -1, ""
    for m in _MARK.finditer(text):
        mark = m.group()
        if mark[0] == "\n":
            at = -1
        elif at >= 0 and mark in closers:
            spans.append((at, m.start()))
            at = -1
        elif at < 0 and mark in QUOTES:
            at, closers = m.start(), QUOTES[mark]
    return np.array(spans, np.int64).reshape(-1, 2)


def errors_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 9 else 2


class Node:
    __slots__ = ("below", "errors", "next", "term")

    def __init__(self):
        self.below, self.errors, self.next, self.term = 0, 0, {}, None


class Trie:
    """The lexicon. Sets of terms are bits of a number: bit i for the i-th term."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.root = terms, Node()
        for i, term in enumerate(terms):
            node, k = self.root, errors_allowed(len(term))
            for c in [*term, None]:
                node.errors, node.below = max(node.errors, k), node.below | 1 << i  # what the terms from here on allow
                node = node.next.setdefault(c, Node()) if c else node
            node.term = term
        # A word within k errors of a term holds one of the term's k + 1 parts unchanged. It is moved by the letters
        # added or left out before it, and the word's length also tells those after it; both are k at most.
        self.parts, plan = {}, {}
        for i, term in enumerate(terms):
            k, n = errors_allowed(len(term)), len(term)
            cuts = [j * n // (k + 1) for j in range(k + 2)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                for before in range(-k, k + 1) if a else [0]:
                    room = k - abs(before)
                    for after in range(-room, room + 1) if z < n else [0]:
                        key = (term[a:z], a + before, n + before + after)
                        self.parts[key] = self.parts.get(key, 0) | 1 << i
                        plan.setdefault(key[2], set()).add((a + before, z + before))
        self.plan = {n: sorted(x) for n, x in plan.items()}

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its number of errors; among equals the one with the larger weight, then the first."""
        if word in self.terms:
            return word, 0
        n, get, likely = len(word), self.parts.get, 0
        for a, z in self.plan.get(n, ()):
            likely |= get((word[a:z], a, n), 0)
        if not likely:
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        goal, found, none = 1 << n, [], 0
        whole, get = goal * 2 - 1, masks.get
        # r0, r1, r2: the places of the word that are reached with 0, 1 and 2 errors, as bits.
        todo = [(self.root, 1, 3, 7)]
        while todo:
            node, r0, r1, r2 = todo.pop()
            if node.term is not None:
                errors = 0 if r0 & goal else 1 if r1 & goal else 2 if r2 & goal else 3
                if errors <= errors_allowed(len(node.term)):
                    found.append((errors, -self.terms[node.term], node.term))
            for c, child in node.next.items():
                if not child.below & likely:  # only where a term shares a part with the word
                    continue
                mask, most = get(c, none), child.errors
                # Beside the letter itself: one more in the term, another one, one more in the word.
                a = (r0 & mask) << 1 & whole
                b = ((r1 & mask) << 1 | r0 | r0 << 1 | a << 1) & whole if most else 0
                d = ((r2 & mask) << 1 | r1 | r1 << 1 | b << 1) & whole if most > 1 else 0
                if a or b or d:
                    todo.append((child, a, b, d))
        return (min(found)[2], min(found)[0]) if found else None


class Matcher(dict):
    """word -> number of its entry, 0 for none. Kept by a Python worker, bounded."""

    def __init__(self, terms: dict[str, float], clean_forms: frozenset[str] = frozenset()):
        self.trie, self.clean_forms = Trie(terms), clean_forms
        self.entries: list[tuple[str, str, int, float]] = [("", "", 0, 0.0)]

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        near = None if word in self.clean_forms else self.trie.near(word)
        if near is None:
            found = 0
        else:
            found = len(self.entries)
            self.entries.append((word, near[0], near[1], self.trie.terms[near[0]] * 0.5 ** near[1]))
        self[word] = found
        return found

    def hits(self, text: str | None) -> tuple[list[str], np.ndarray]:
        words = _TOKEN.findall((text or "").lower())
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return words, found

    def features(self, text: str | None) -> list[float]:
        """Sums of exact, misspelled and quoted hits, each weighed by its context, density and largest weight."""
        words, found = self.hits(text)
        at = np.flatnonzero(found)
        if not len(at):
            return [0.0] * 5
        quoted = np.zeros(len(words), bool)
        if any(q in text for q in QUOTES):
            low = text.lower()
            spans = quoted_spans(low)
            if len(spans):
                starts = np.fromiter((m.start() for m in _TOKEN.finditer(low)), np.int64, len(words))
                last = np.searchsorted(spans[:, 0], starts, side="right") - 1
                quoted = (last >= 0) & (starts < spans[np.maximum(last, 0), 1])
        sums, largest = [0.0, 0.0, 0.0], 0.0
        for n, i in enumerate(at.tolist()):
            _, _, errors, weight = self.entries[found[i]]
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            told = quoted[i] or not REPORTING.isdisjoint(around)
            close = n and i - at[n - 1] <= WINDOW or n + 1 < len(at) and at[n + 1] - i <= WINDOW
            if close or not ADDRESS.isdisjoint(words[max(0, i - 3) : i + 4]):
                weight *= 1.25
            sums[2 if told else 1 if errors else 0] += weight
            largest = max(largest, weight * (0.25 if told else 1))
        return [float(x) for x in (*np.log1p(sums), min(100 * len(at) / len(words), 20) / 10, largest)]


class Model:
    """Terms, dropped forms and the logistic weights: what a task needs, bounded by the constants above."""

    def __init__(self, terms, clean_forms=frozenset(), weights=None, base=0.5):
        self.terms, self.clean_forms, self.weights, self.base, self.kept = terms, clean_forms, weights, base, None

    def matcher(self) -> Matcher:
        """The matcher of a Python worker; as part of a broadcast it serves all of the worker's tasks."""
        if self.kept is None:
            self.kept = Matcher(self.terms, self.clean_forms)
        return self.kept

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.base)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (the first one constant) by Newton's steps with a ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def bounded(entries: DataFrame) -> DataFrame:
    """entries of a lexicon, written and counted; too many raise."""
    kept = table(entries, "toxicity-lexicon")
    if kept.count() > LEXICON_MOST:
        raise ValueError(f"the labelled rows give a lexicon of more than {LEXICON_MOST} entries")
    return kept


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, part: int = 1, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out. docs: (doc_id, text)."""
    labelled = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    chosen = labelled.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(sample).select("doc_id", "label")
    # At most `sample` ids: small by the bound, so they may be broadcast.
    # Of rows that share an id one counts, so that their number is bounded as well.
    texts = table(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, base=float(next(iter(sizes), 0.5)))

    def counts(rows, of):
        seen = {0: Counter(), 1: Counter()}
        for b in rows:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[1 if y else 0].update(of(text))
        words = list(seen[1].keys() | seen[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([seen[y][w] for w in words], pa.int64()) for y in (1, 0)]], ["word", "bad", "good"])

    def by_class(of):
        return texts.mapInArrow(lambda it: counts(it, of), "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1))
    words = by_class(lambda text: set(_TOKEN.findall((text or "").lower()))).withColumn("odds", odds)
    terms = {r["word"]: float(r["odds"]) for r in bounded(words.filter((F.col("bad") >= MIN_ROWS) & (F.col("odds") >= MIN_ODDS))).orderBy(F.desc("bad"), "word").collect()}

    spark = docs.sparkSession
    draft = spark.sparkContext.broadcast(Model(terms))

    def misspelled(text):
        matcher = draft.value.matcher()
        _, found = matcher.hits(text)
        return {matcher.entries[i][0] for i in set(found[found > 0].tolist()) if matcher.entries[i][2]}

    forms = by_class(misspelled).withColumn("odds", odds)
    clean = frozenset(r["word"] for r in bounded(forms.filter((F.col("good") > 0) & (F.col("odds") < MIN_ODDS))).collect())
    model = Model(terms, clean)
    second = spark.sparkContext.broadcast(model)

    def features(it):
        matcher = second.value.matcher()
        for b in it:
            found = [matcher.features(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    rows = sorted(texts.mapInArrow(features, "label int, x array<double>").collect())
    model.weights = logistic(np.array([r["x"] for r in rows]), np.array([1.0 if r["label"] else 0.0 for r in rows]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        matcher = kept.value.matcher()
        for b in slices(it):
            found = np.array([matcher.features(x) for x in b.column(1).to_pylist()]).reshape(b.num_rows, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept.value.scores(found))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
