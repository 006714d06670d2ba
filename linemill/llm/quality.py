"""Quality classifier: a sparse ensemble of rules over text statistics.

1. One pass of numpy over whole texts gives each its statistics (``STATS``).
2. Shallow trees are boosted on the statistics of a bounded sample of labelled
   texts; every path from a root becomes a conjunctive rule.
3. A logistic model with an L1 penalty over the rules keeps few of them.
4. The rules left are compiled into one Spark column expression.

Cases. Null and empty texts have statistics of zero and are scored like any
other. Whole texts are read, however long. Repeated rows get the same score, and
repeated texts are learned from once; ties of equal gain go to the first
statistic and the least cut. Without labels of both classes every score is
1. An empty table gives an empty table. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm import shingles as S
from linemill.llm.batches import bounded
from linemill.llm.training import held_out, training_texts

STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "sign", "stop_mark", "bar", "bang", "non_ascii",
    "line_words", "distinct", "top_word", "again", "second_again", "sign_ends", "one_byte_words", "longest_word", "repeated_lines",
)

_CLASS = np.zeros((7, 256), np.float32)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-|"]] = 1
_CLASS[3, [ord(c) for c in ".?,;:"]] = 1
_CLASS[4, ord("|")] = 1
_CLASS[5, ord("!")] = 1
_CLASS[6, 128:] = 1


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the ranges between consecutive places in ``at``."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return np.diff(total[at])


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    data, offsets = S.raw(texts)
    out = np.zeros((len(offsets) - 1, len(STATS)))
    for first, last in S.chunks(offsets):
        own = offsets[first : last + 1]
        out[first:last] = _chunk(data[own[0] : own[-1]], own - own[0])
    return out


def _chunk(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at).astype(float)
    hashes, word_at = S.words(data, at)
    m = np.diff(word_at).astype(float)
    some, words = np.maximum(n, 1), np.maximum(m, 1)
    share = [_sums(_CLASS[i][data], at) / some for i in range(7)]
    starts, ends = _word_places(data, at)
    size = ends - starts
    last_sign = _CLASS[2][data[ends - 1]] + _CLASS[5][data[ends - 1]] if len(ends) else np.zeros(0)
    newline = data == 10
    lines = _sums(newline, at) + 1
    doc = np.repeat(np.arange(len(n)), np.diff(word_at))
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    same2 = np.zeros(len(hashes))
    same2[2:] = (hashes[2:] == hashes[:-2]) & (doc[2:] == doc[:-2])
    distinct, top, longest, lines_again = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    line_hash, line_at = _line_hashes(data, at, newline)
    for i in range(len(n)):
        own = np.sort(hashes[word_at[i] : word_at[i + 1]])
        if len(own):
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            distinct[i], top[i] = len(edges) - 1, np.diff(edges).max()
            longest[i] = size[word_at[i] : word_at[i + 1]].max()
        k = line_at[i + 1] - line_at[i]
        if k > 1:
            lines_again[i] = 1 - len(np.unique(line_hash[line_at[i] : line_at[i + 1]])) / k
    return np.column_stack(
        [np.log1p(n), np.log1p(m), _sums(size, word_at) / words, *share, m / lines, distinct / words, top / words, _sums(same, word_at) / words,
         _sums(same2, word_at) / words, _sums(last_sign, word_at) / words, _sums(size == 1, word_at) / words, longest, lines_again]
    )


def _word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~S._SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([True], ~inside[:-1])) | edge[:-1]
    after = np.concatenate((~inside[1:], [True])) | edge[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def _line_hashes(data: np.ndarray, at: np.ndarray, newline: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each line and where each text's lines start among them."""
    cut = np.flatnonzero(newline)
    starts = np.sort(np.concatenate((at[:-1], cut + 1)), kind="stable")
    # A text's own start comes before the starts behind its newlines; an empty text has its start too.
    ends = np.concatenate((starts[1:], at[-1:]))
    power, inverse = S._power_arrays(len(data) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(newline, np.uint64(0), S._BYTE[data] * power[: len(data)]), dtype=np.uint64)))
    per = _sums(newline, at).astype(np.int64) + 1
    return (prefix[ends] - prefix[starts]) * inverse[np.minimum(starts, len(inverse) - 1)], np.concatenate(([0], np.cumsum(per)))


# ---- learning


def _tree_paths(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float) -> tuple[list, np.ndarray]:
    """A regression tree on gradients, by histograms; its paths, and its value for each row."""
    paths, value = [], np.zeros(len(x))
    todo = [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        if path:
            paths.append(path)
        g, h = grad[rows].sum(), hess[rows].sum()
        value[rows] = -g / (h + 1.0)
        if len(path) == depth:
            continue
        best = (1e-6, None, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = x[rows, f]
            gs, hs = (np.cumsum(np.bincount(b, v[rows], len(c) + 1))[:-1] for v in (grad, hess))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
            gain[(hs < least) | (h - hs < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is not None:
            left = x[rows, best[1]] <= best[2]
            todo += [((*path, (best[1], best[2], True)), rows[left]), ((*path, (best[1], best[2], False)), rows[~left])]
    return paths, value


def _fires(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, k, below in rule:
        out &= (x[:, f] <= k) == below
    return out


def fit_rules(stats: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, bins: int = 48, penalty: float = 1e-3) -> tuple[float, list[tuple[float, tuple]]]:
    """Intercept and weighted rules; a rule is a tuple of (statistic, cut, at most the cut?)."""
    cuts = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(stats.shape[1])]
    cuts = [c[c < stats[:, f].max()] for f, c in enumerate(cuts)]
    x = np.column_stack([np.searchsorted(c, stats[:, f], "left") for f, c in enumerate(cuts)])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    margin, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, value = _tree_paths(x, cuts, weight * (p - y), weight * p * (1 - p), depth, 2.0)
        margin += 0.3 * value
        rules |= dict.fromkeys(tuple(sorted(r)) for r in paths)
    kept, columns = [], []
    seen = set()
    for r in rules:
        fires = _fires(x, r)
        if (mark := fires.tobytes()) not in seen and 0 < fires.sum() < len(y):
            seen.add(mark)
            kept.append(r)
            columns.append(fires)
    a = np.column_stack(columns).astype(float) if columns else np.zeros((len(y), 0))
    w = weight / len(y)
    # FISTA: the gradient's Lipschitz constant by power iteration.
    v = np.ones(a.shape[1] + 1)
    full = np.column_stack([np.ones(len(y)), a])
    for _ in range(20):
        v = full.T @ (w * (full @ v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1 / (0.25 * (v @ (full.T @ (w * (full @ v)))) * 1.05 + 1e-12)
    beta = z = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(full @ z)))
        new = z - rate * (full.T @ (w * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - beta)
        beta, t = new, t2
    chosen = [(float(b), tuple((f, float(cuts[f][k]), below) for f, k, below in r)) for b, r in zip(beta[1:], kept, strict=True) if abs(b) > 1e-6]
    return float(beta[0]), chosen


def compile_rules(intercept: float, rules: list[tuple[float, tuple]], stats: Column) -> Column:
    """The model as a column: stats is an array column in the order of STATS."""
    total = F.lit(intercept)
    for weight, rule in rules:
        fires = None
        for f, cut, below in rule:
            one = stats[f] <= cut if below else stats[f] > cut
            fires = one if fires is None else fires & one
        total = total + F.when(fires, weight).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def stats_of(text: str | Column) -> Column:
    """A column of the statistics of a text column, in the order of STATS."""

    @F.arrow_udf("array<double>")
    def found(texts: pa.Array) -> pa.Array:
        rows = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(STATS), dtype=np.int32)), pa.array(rows.ravel()))

    return found(text)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 6000, **options) -> tuple[float, list]:
    """Intercept and rules from at most ``per_class`` labelled texts of each class."""
    bounded(docs.sparkSession)
    rows = training_texts(docs, labels, "quality", per_class).select(stats_of("text").alias("s"), "y").collect()
    y = np.array([r.y for r in rows], float)
    if len(set(y)) < 2:
        return 30.0, []
    return fit_rules(np.array([r.s for r in rows]), y, **options)


def score(docs: DataFrame, model: tuple[float, list]) -> DataFrame:
    """(doc_id, score) of each row of ``docs``."""
    return docs.select("doc_id", stats_of("text").alias("s")).select("doc_id", compile_rules(*model, F.col("s")).alias("score"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.expr("cast(score >= 0.3 as int)").alias("predicted"))
