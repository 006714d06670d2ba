"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width
forms to Latin ones, digits and signs that stand for letters to those letters,
and every other ASCII sign to a space. The lexicon is learned from labelled
texts: folded words and word beginnings that mark the toxic class, weighted by
their log odds, beside a short list of English insults. Phrases in which such a
word is harmless cancel the hits inside them. A text's score is a logistic
function of the summed weights and of that sum a hundred words.

Cases. Null and empty texts have no hits and get the score of a clean text.
Whole texts are matched, however long; work grows with a text's length. Of hits
that begin at one place the heaviest counts, ties alike. Repeated rows get the
same score, and repeated texts are learned from once. Without usable labels, or
without documents, the listed words serve with fixed coefficients; an empty table
gives an empty table. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm.batches import bounded
from linemill.llm.training import held_out, training_texts

# Letters that look like Latin ones, and signs that stand for letters.
# "l" and "i" become one letter, as "1" and "|" stand for both.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "i",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "i", "ᴏ": "o", "ⅰ": "i", "ⅼ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown"]
EXCEPTIONS = ["trash can", "trash cans", "trash bag", "trash bags", "trash bin", "take out the trash", "class clown", "clown fish", "circus clown", "idiot proof", "sore loser", "pond scum"]

_TABLE: dict[int, str] = {c: " " for c in range(128) if not chr(c).isalnum()}
_TABLE |= {ord(k): v for k, v in (LOOK_ALIKES | DIGITS).items()}
_TABLE |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: DIGITS.get(str(i), str(i)) for i in range(10)}
_TABLE |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_TABLE[ord("l")] = "i"
_TABLE[0xFF41 + 11] = "i"
_IN_WORD = re.compile(r"(?<=\w)[@$!|]+(?=[^\W_])|(?<!\S)[@$]+(?=[^\W_])")


def fold(text: str) -> str:
    """Folded words, one space apart, with a space at either end."""
    text = text.lower()
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = _IN_WORD.sub(lambda m: "".join(map(SIGNS.get, m[0])), text)
    return f" {' '.join(text.translate(_TABLE).split())} "


class Lexicon:
    """Patterns with weights; exceptions; the coefficients of the score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients: list[float]):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients
        self._automaton = None

    def dump(self) -> str:
        return json.dumps([self.weights, self.exceptions, self.coefficients], ensure_ascii=False)

    @classmethod
    def load(cls, dumped: str) -> Lexicon:
        return cls(*json.loads(dumped))

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self._automaton.add_word(p, (len(p), w))
            for p in self.exceptions:  # a weight of None cancels
                self._automaton.add_word(p, (len(p), None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def matched(self, folded: str) -> float:
        """Sum of the weights of hits outside exceptions; of hits in one word the heaviest counts."""
        a = self.automaton()
        if not len(a):
            return 0.0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in a.iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            else:
                hits[start] = max(w, hits.get(start, 0.0))
        if not spared:
            return sum(hits.values())
        # One pass over both in the order of their beginnings.
        spared.sort()
        total, reach, k = 0.0, -1, 0
        for start in sorted(hits):
            while k < len(spared) and spared[k][0] <= start:
                reach, k = max(reach, spared[k][1]), k + 1
            if start >= reach:
                total += hits[start]
        return total

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = self.matched(folded)
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1)) if total else 0.0

    def score(self, text: str) -> float:
        x, y = self.features(text)
        b0, b1, b2 = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + b1 * x + b2 * y))))


def _terms(folded: str) -> set[str]:
    """Whole words " word ", and beginnings " wor" of 4 to 6 letters."""
    found = {w for w in set(folded.split()) if len(w) > 2}
    return {f" {w} " for w in found} | {f" {w[:n]}" for w in found for n in (4, 5, 6) if len(w) >= n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, y in zip(b.column(0), b.column(1), strict=True):
            counts[y.as_py()].update(_terms(fold(text.as_py())))
            if len(counts[0]) + len(counts[1]) > 100_000:
                yield _counted(counts)
                counts = (Counter(), Counter())
    yield _counted(counts)


def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([counts[y][t] for t in terms], pa.int64()) for y in (0, 1))], ["term", "clean", "toxic"])


def _needed(picked: list[tuple[str, float, int]]) -> list[tuple[str, float]]:
    """Whole words, and the beginnings that no single word accounts for: half of a beginning's texts or more is the word's own."""
    most: dict[str, int] = {}
    for term, _, toxic in picked:
        if term.endswith(" "):
            for n in (5, 6, 7):
                most[term[:n]] = max(toxic, most.get(term[:n], 0))
    return [(term, rate) for term, rate, toxic in picked if term.endswith(" ") or 2 * most.get(term, 0) < toxic]


#: Where there are no labels to fit: any hit of weight 4 tips the score.
_UNFITTED = [-4.0, 4.0, 1.0]


def _coefficients(rows: list) -> list[float]:
    """Ridge logistic regression of y on the two features; none of them may speak for a clean text."""
    if len({y for *_, y in rows}) < 2:
        return _UNFITTED
    x = np.array([[1.0, a, b] for a, b, _ in rows])
    y = np.array([r[2] for r in rows], float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * beta * [0, 1, 1]
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([1e-9, 1e-3, 1e-3])
        step = np.linalg.solve(hess, grad)
        beta -= step
        if abs(step).max() < 1e-9:
            break
    if min(beta[1:]) < 0 or max(beta[1:]) <= 0:
        return _UNFITTED
    return [float(v) for v in beta]


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 6000, odds: float = 20.0, support: float = 0.01, terms: int = 5000) -> Lexicon:
    """Learn from at most ``per_class`` labelled texts of each class.

    A term enters when it is ``odds`` times as frequent in toxic texts and in at
    least ``support`` of them (4 at least); the ``terms`` most frequent ones. A
    beginning enters only if several words share it.
    """
    bounded(docs.sparkSession)
    rows = training_texts(docs, labels, "toxic", per_class).persist()
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    weights = {f" {fold(w).strip()} ": 4.0 for w in INSULTS}
    exceptions = [fold(e) for e in EXCEPTIONS]
    if n1 and n0:
        least = max(4, math.ceil(support * n1))
        rate = F.expr(f"((toxic + 0.5) / {n1 + 1}.0) / ((clean + 0.5) / {n0 + 1}.0)")
        counts = rows.mapInArrow(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        picked = counts.filter(F.col("toxic") >= least).filter(rate >= odds).select("term", rate.alias("rate"), "toxic").orderBy(F.desc("toxic"), "term").limit(terms)
        for term, rate in _needed([tuple(r) for r in picked.collect()]):
            weights[term] = max(weights.get(term, 0.0), math.log(rate))
    lexicon = Lexicon(weights, exceptions, _UNFITTED)
    dumped = lexicon.dump()
    features = rows.mapInArrow(_features(dumped), "x double, z double, y int").collect()  # at most 2 * per_class rows
    rows.unpersist()
    return Lexicon(weights, exceptions, _coefficients([tuple(r) for r in features]))


_loaded: dict[str, Lexicon] = {}


def _lexicon(dumped: str) -> Lexicon:
    """One automaton a worker."""
    if dumped not in _loaded:
        _loaded.clear()
        _loaded[dumped] = Lexicon.load(dumped)
    return _loaded[dumped]


def _features(dumped: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(dumped)
        for b in batches:
            found = [lexicon.features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), b.column(1)], ["x", "z", "y"])

    return run


def scorer(lexicon: Lexicon):
    """A Column function: text to score."""
    dumped = lexicon.dump()

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        lexicon = _lexicon(dumped)
        return pa.array([lexicon.score(t.as_py() or "") for t in texts], pa.float64())

    return score


def rows_left(docs: DataFrame, labels: DataFrame, fit_on: DataFrame) -> DataFrame:
    """``docs`` without the texts that score as toxic (0.5 or more)."""
    return docs.filter(scorer(fit(fit_on, labels))("text") < 0.5)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(lexicon)("text").alias("score"))
    return scored.withColumn("predicted", F.expr("cast(score >= 0.5 as int)"))
