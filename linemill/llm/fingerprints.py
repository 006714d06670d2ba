"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for two bases modulo 2**31 - 1, the polynomial hash of
every prefix of a text's code points. Any two spans are compared in constant
time, and longest common extensions are found by binary search. A fingerprint
is the text's length, the hash of the whole span, and the ``KEEP`` smallest of
the hashes of all spans of ``WIDTH`` code points; short texts (under ``SHORT``)
also have those of ``NARROW`` code points, by which two short texts are compared,
as an edit would touch most of their wider spans. The likeness of two
fingerprints is an estimate of the share of distinct spans that their texts have
in common (2 common / both): exact where both have at most ``KEEP`` spans, else
with a standard error of 0.07 at most (from ``KEEP`` values of the union).

Cases. Null counts as empty. A text of fewer code points than a span's width has
one span, itself; an empty one has none, and is like another empty text only.
Whole texts are hashed, however long. Rows are ordered by id, null ids first,
then text; repeated rows follow one another, and ties of both are alike. An empty
table gives an empty table; a single row is its own next. Columns other than the
id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm.batches import bounded

PRIME = np.uint64(2**31 - 1)
_BASES = (1_103_515_245, 1_812_433_253 % (2**31 - 1))
WIDTH, KEEP = 20, 64
NARROW, SHORT = 4, 160

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers and inverse powers of each base, n at least; doubled as texts need them."""
    global _tables
    if not _tables or len(_tables[0][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _tables = [tuple(_power(b, size) for b in (base, pow(base, -1, int(PRIME)))) for base in _BASES]
    return _tables


def _power(base: int, size: int) -> np.ndarray:
    p = np.ones(1, np.uint64)
    while len(p) < size:
        p = np.concatenate((p, p * np.uint64(pow(base, len(p), int(PRIME))) % PRIME))
    return p


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    def __init__(self, text: str):
        c = code_points(text).astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.prefix = []
        for power, _ in _powers(self.n + 1):
            s = np.empty(self.n + 1, np.uint64)
            s[0] = 0
            np.cumsum(c * power[: self.n] % PRIME, out=s[1:])
            s %= PRIME
            self.prefix.append(s)

    def span(self, start: int, end: int) -> int:
        """Hash of the code points from ``start`` up to ``end``; equal for equal spans anywhere, in any text."""
        out = 0
        for s, (_, inverse) in zip(self.prefix, _powers(self.n + 1), strict=True):
            out = out << 31 | (int(s[end]) - int(s[start])) % int(PRIME) * int(inverse[start]) % int(PRIME)
        return out

    def spans(self, width: int) -> np.ndarray:
        """``span(i, i + width)`` for every i."""
        out = np.zeros(max(0, self.n - width + 1), np.uint64)
        for s, (_, inverse) in zip(self.prefix, _powers(self.n + 1), strict=True):
            own = (s[width:] + PRIME - s[: len(out)]) * inverse[: len(out)] % PRIME
            out = out << np.uint64(31) | own
        return out

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension from i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _smallest(p: PrefixHash, width: int) -> str:
    """The KEEP smallest distinct span hashes, 12 hexadecimal digits each."""
    h = _mixed(p.spans(min(width, p.n))) >> np.uint64(16)
    k = 2 * KEEP
    few = np.unique(h if len(h) <= 8 * KEEP else np.partition(h, k)[:k])
    while len(few) < KEEP and k < len(h):  # repeated spans may fill the smallest ones
        k *= 4
        few = np.unique(np.partition(h, k)[:k] if k < len(h) else h)
    return "".join(f"{x:012x}" for x in few[:KEEP].tolist())


def fingerprint(p: PrefixHash) -> str:
    """length.hash.spans, and .spans of NARROW code points of a short text; lower-case hexadecimal."""
    if not p.n:
        return "0.0.."
    return f"{p.n:x}.{p.span(0, p.n):x}.{_smallest(p, WIDTH)}.{_smallest(p, NARROW) if p.n < SHORT else ''}"


def likeness(a: str, b: str) -> float:
    """Share of spans that two texts have in common (2 common / both), estimated from their fingerprints; 1 for equal texts."""
    if a == b:
        return 1.0
    a, b = a.split("."), b.split(".")
    at = 3 if a[3] and b[3] else 2
    x, y = ({h[i : i + 12] for i in range(0, len(h), 12)} for h in (a[at], b[at]))
    if not x or not y:
        return 0.0
    # The smallest of the union are a sample of it; what both have of them estimates the Jaccard likeness.
    both = x | y
    if len(x) >= KEEP or len(y) >= KEEP:
        most = min(max(s) for s in (x, y) if len(s) >= KEEP)
        both = {h for h in both if h <= most}
    jaccard = len(both & x & y) / len(both)
    return 2 * jaccard / (1 + jaccard)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def _row(doc_id, text: str, own: tuple, next_text: str, next_own: tuple) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + next_text[: n // 2]
    e = PrefixHash(edited)
    mark = fingerprint(e)
    return (
        doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), own[1], mark, likeness(own[1], mark), likeness(own[1], next_own[1]),
        own[0].common(0, e, 0), own[0].common(0, next_own[0], 0),
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in COLUMNS.split(", ")]
    held = None
    for b in batches:
        out = []
        for ahead, doc_id, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
            ahead, doc_id, text = ahead.as_py(), doc_id.as_py(), text.as_py()
            if ahead and held is None:
                continue  # a second row of the id ahead
            p = PrefixHash(text)
            own = (p, fingerprint(p))
            if held is not None:
                out.append(_row(*held, text, own))
            held = None if ahead else (doc_id, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _existing(docs: DataFrame, cuts: list[int], least: int) -> list[int]:
    """Quantiles pass through doubles, which large ids don't survive: the least ids from each cut on."""
    found = docs.agg(*(F.min(F.when(F.col("doc_id") >= c, F.col("doc_id"))) for c in cuts)).first()
    return sorted({c for c in found if c is not None and c > least})


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``COLUMNS`` of each row: of the text, of the text edited with the next row's, and of the next.

    Rows are dealt by ranges of ids, once; the first row of a range also goes to
    the range before it, and the first row of all to the last.
    """
    spark = docs.sparkSession
    bounded(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least, nulls = docs.agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).first()
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if least is not None and n > 1 else []
    cuts = sorted({int(c) for c in cuts if c is not None and int(c) > least})
    if cuts and max(abs(cuts[0]), abs(cuts[-1])) >= 2**53:
        cuts = _existing(docs, cuts, least)
    places = F.array(*(F.lit(c).cast("long") for c in cuts))
    # How many cuts are at most the id, by binary search: steps of falling powers of two.
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    low = F.lit(0) if not cuts else F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(places, at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at))
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    rows = docs.withColumn("part", low)
    goes = F.array_compact(
        F.array(
            F.struct(F.col("part"), F.lit(False).alias("ahead")),
            F.when((low > 0) & (F.get(places, low - 1) == F.col("doc_id")), F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("ahead"))) if cuts else F.lit(None),
            F.when(is_first, F.struct(F.lit(len(cuts)).alias("part"), F.lit(True).alias("ahead"))) if least is not None or nulls else F.lit(None),
        )
    )
    dealt = rows.select(F.explode(goes).alias("g"), "doc_id", "text").select("g.part", "g.ahead", "doc_id", "text")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), "text")
    return dealt.select("ahead", "doc_id", "text").mapInArrow(_run, COLUMNS)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
