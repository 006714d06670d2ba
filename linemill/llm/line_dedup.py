"""Line dedup: documents that share rare line hashes are aligned, and aligned common blocks go from the later one.

1. Keys. A line (text between newlines) stands for itself by its hash, without
   white space (0x20, 0x09-0x0D) at its end. A line of ``min_words`` words is a
   key; a shorter one is rare only together with its neighbours: the key is the
   hash of the shortest run of ``min_words`` words that starts there, and of the
   one that ends there. Words are runs of characters other than white space; in
   scripts that are written without spaces (Han, kana, Thai, Lao, Burmese, Khmer)
   each character counts as one.
2. Pairs. How many documents hold a key tells how rare it is. One that a single
   document holds pairs nothing; any other pairs each later holder with the
   first. Rows grow with lines, never with pairs of holders; rows of a frequent
   key are dealt to many tasks.
3. Alignment. A document is aligned with each earlier one that it is paired with,
   by patience diff over the keys that pair them, those with the rarest keys
   first. Lines under aligned keys form the common blocks, which go from the
   later document. What stands in another order or more often than in the earlier
   one is left over by an alignment and is aligned again, until nothing is left.

So a line goes if and only if it lies in a stretch of consecutive lines of
``min_words`` words or more that any earlier document holds too: every line of
such a stretch lies under a key inside it, and every key has a first holder.
Shorter stretches stay (stock lines of a few words are no copied passage);
``min_words=1`` takes every line with a word that an earlier document has.

Cases. "Later" is by (id, text hash); null ids are least. Repeated rows (equal
ids and texts) are one document and are treated alike, so none of them loses
lines to the other; different texts under one id are two documents. Ties of
rarity go by the number of keys and change no result. Null and empty texts have
no words and stay as they are (null becomes empty). Blank lines have no words;
they go with the block that they stand in or next to in both documents. What one
document repeats within itself stays unless an earlier one holds it; then each
place goes. Very long texts: work grows with lines times the logarithm of lines.
An empty table gives an empty table. Other columns of any name stay inside
``row``.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.llm import shingles as S
from linemill.llm.batches import bounded
from linemill.llm.bloom import BloomFilter
from linemill.llm.scratch import Scratch
from linemill.llm.skew import frequent, spread_join

#: Alignments of one pair before what is left is aligned stretch by stretch.
PASSES = 8
_NEWLINE = "\n"
_WHITE = " \t\n\x0b\x0c\r"
_ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_WORD = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]+"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b): equal ends, then lines that occur once on both sides, in order, and so on between them.

    Where no line is such, the k-th of a line on one side stands for the k-th on the other.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        chain = _rising(_once(a, i, i2, b, j, j2)) or _rising(_in_turn(a, i, i2, b, j, j2))
        x0, y0 = i, j
        for x, y in chain:
            out.append((x, y))
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
        if chain:
            todo.append((x0, i2, y0, j2))
    return sorted(out)


def _once(a: list[int], i: int, i2: int, b: list[int], j: int, j2: int) -> list[tuple[int, int]]:
    """Positions of the lines that occur once in a[i:i2] and once in b[j:j2]."""
    once: dict[int, int] = {}
    for y in range(j, j2):
        once[b[y]] = -1 if b[y] in once else y
    seen: dict[int, int] = {}
    for x in range(i, i2):
        seen[a[x]] = -1 if a[x] in seen else x
    return [(x, once[v]) for v, x in seen.items() if x >= 0 and once.get(v, -1) >= 0]


def _in_turn(a: list[int], i: int, i2: int, b: list[int], j: int, j2: int) -> list[tuple[int, int]]:
    """Positions of each line's first in a[i:i2] and in b[j:j2], its second in both, and so on."""
    places: dict[int, list[int]] = {}
    for y in range(j2 - 1, j - 1, -1):
        places.setdefault(b[y], []).append(y)
    return [(x, places[a[x]].pop()) for x in range(i, i2) if places.get(a[x])]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        d = bisect_left(tops, y)
        back[k] = at[d - 1] if d else -1
        tops[d : d + 1] = [y]
        at[d : d + 1] = [k]
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def keys(hashes: list[int], words: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line after the last, hash) of the shortest runs of ``min_words`` words that start or end at each line, in the order of the text."""
    n = len(hashes)
    upto = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    ends = np.searchsorted(upto, upto[:-1] + min_words, "left")
    starts = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    from_line, to_line = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    first, end = np.concatenate((from_line, starts[to_line])), np.concatenate((ends[from_line], to_line + 1))
    place = np.unique(first * (n + 1) + end)
    first, end = place // (n + 1), place % (n + 1)
    power, inverse = S._power_arrays(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(S.mix(np.array(hashes, np.int64).view(np.uint64)) * power[:n], out=prefix[1:])
    return first, end, S.mix((prefix[end] - prefix[first]) * inverse[first] + (end - first).astype(np.uint64)).view(np.int64)


def aligned(earlier: list[int], later: list[int]) -> list[list[int]]:
    """Places in ``later`` of the keys that alignments with ``earlier`` take, one list an alignment, until none is left.

    earlier: distinct keys in their order; later: the same keys, repeated and in
    any order. After ``PASSES`` alignments of all that is left, each stretch of it
    that rises in ``earlier`` is one.
    """
    out = []
    left = list(range(len(later)))
    for _ in range(PASSES):
        if not left:
            return out
        taken = [y for _, y in patience(earlier, [later[i] for i in left])]
        out.append([left[y] for y in taken])
        gone = set(taken)
        left = [i for y, i in enumerate(left) if y not in gone]
    place = {h: x for x, h in enumerate(earlier)}
    stretch: list[int] = []
    for i in left:
        if stretch and place[later[i]] <= place[later[stretch[-1]]]:
            out.append(stretch)
            stretch = []
        stretch.append(i)
    return out + [stretch] * bool(stretch)


def kept_lines(hashes: list[int], words: list[int], met: list[tuple], min_words: int) -> np.ndarray:
    """For each line whether it stays. met: (earlier document, how many hold the key, its place there, key)."""
    first, end, h = keys(hashes, words, min_words)
    order = np.argsort(h, kind="stable")
    # Of each earlier document its keys; documents with the rarest keys come first.
    by: dict = {}
    for doc, often, at, key in met:
        by.setdefault(doc, []).append((at, key, often))
    depth = np.zeros(len(hashes) + 1, np.int64)
    for found in sorted(by.values(), key=lambda f: (min(x[2] for x in f), -len(f))):
        found.sort()
        earlier = [key for _, key, _ in found]
        wanted = np.sort(np.array(earlier, np.int64))
        low, high = np.searchsorted(h[order], wanted, "left"), np.searchsorted(h[order], wanted, "right")
        own = np.sort(order[np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low) + np.arange((high - low).sum())])
        for block in aligned(earlier, h[own].tolist()):
            at = own[block]
            np.add.at(depth, first[at], 1)
            np.add.at(depth, end[at], -1)
    return np.cumsum(depth)[: len(hashes)] == 0


def _keys(min_words: int):
    @F.arrow_udf("array<struct<h: bigint, at: int>>")
    def found(hashes: pa.Array, words: pa.Array) -> pa.Array:
        h_all, at_all, size = [], [], [0]
        for h, w in zip(hashes.to_pylist(), words.to_pylist(), strict=True):
            h, at = np.unique(keys(h, w, min_words)[2], return_index=True)
            h_all.append(h)
            at_all.append(at.astype(np.int32))
            size.append(size[-1] + len(h))
        both = pa.StructArray.from_arrays([pa.array(np.concatenate(h_all or [np.zeros(0, np.int64)])), pa.array(np.concatenate(at_all or [np.zeros(0, np.int32)]))], ["h", "at"])
        return pa.ListArray.from_arrays(pa.array(size, pa.int32()), both)

    return found


def _kept(min_words: int):
    @F.arrow_udf("array<boolean>")
    def kept(hashes: pa.Array, words: pa.Array, met: pa.Array) -> pa.Array:
        cols = zip(hashes.to_pylist(), words.to_pylist(), met.to_pylist(), strict=True)
        return pa.array([kept_lines(h, w, [((m["fk"], m["fth"]), m["often"], m["at"], m["h"]) for m in x], min_words) for h, w, x in cols], pa.list_(pa.bool_()))

    return kept


def removals(docs: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """(k, th, kept): for each line whether it stays, of documents that lose some. k: the id, a null as the least; th: the text's hash."""
    own = F.split("text", _NEWLINE, -1)
    lines = docs.select(
        "k",
        "th",
        F.transform(own, lambda x: F.xxhash64(F.rtrim(x, F.lit(_WHITE)))).alias("hashes"),
        F.transform(own, lambda x: F.regexp_count(x, F.lit(_WORD))).alias("words"),
    )
    lines = scratch.keep(lines, "lines")  # rows that repeat an id and a text are dropped once little is left of them
    each = scratch.keep(lines.select("k", "th", F.explode(_keys(min_words)("hashes", "words")).alias("x")).select("k", "th", "x.h", "x.at"), "keys")
    holders = each.groupBy("h").agg(F.min(F.struct("k", "th", "at")).alias("f"), F.max(F.struct("k", "th")).alias("l"), F.count(F.lit(1)).alias("often"))
    often = frequent(holders, ["h"], scratch.rows(each), "often")
    holders = holders.filter("f.k != l.k or f.th != l.th").select("h", F.col("f.k").alias("fk"), F.col("f.th").alias("fth"), F.col("f.at").alias("at"), "often")
    pairs = spread_join(each.drop("at"), holders, ["h"], "th", often).filter("k != fk or th != fth")
    met = pairs.groupBy("k", "th").agg(F.collect_set(F.struct("fk", "fth", "often", "at", "h")).alias("met"))  # a document's own keys at most
    found = lines.join(met, ["k", "th"]).select("k", "th", _kept(min_words)("hashes", "words", "met").alias("kept"))
    found = scratch.keep(found.dropDuplicates(["k", "th"]), "kept")
    scratch.drop(lines, each)
    return found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))


def line_dedup(docs: DataFrame, *, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: row (the input as a struct), text without the deleted lines, n_lines, n_removed.

    min_words: words that a common block needs to be deleted, one at least.
    """
    bounded(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "line_dedup")
    keyed = _keyed(docs, id_col, text_col)
    found = removals(keyed.select("k", "th", "text"), scratch, min_words)
    # Texts that lose nothing needn't move: a filter of bounded size tells most of them apart.
    own = F.xxhash64("k", "th")
    bloom = BloomFilter(found.select(own.alias("key")), "key")
    may = bloom.may_contain(own, bloom.bits())
    left = F.expr("array_join(array_compact(zip_with(split(text, '\\n', -1), kept, (x, stays) -> if(stays, x, null))), '\\n')")
    cut = keyed.filter(may).join(found.hint("merge"), ["k", "th"], "left")
    every = keyed.filter(~may).withColumn("kept", F.lit(None).cast("array<boolean>")).unionByName(cut)
    return every.select(
        "row",
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.expr("size(split(text, '\\n', -1))").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size(F.filter("kept", lambda stays: ~stays))).alias("n_removed"),
    )


def rows_left(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with shortened texts, in its own columns (n_chars follows the text); a document that lost every line goes."""
    out = line_dedup(docs, **options)
    text, cut = F.col("text"), F.col("n_removed") > 0
    made = {options.get("text_col", "text"): F.when(cut, text).otherwise(F.col(f"row.{options.get('text_col', 'text')}"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.filter("not (n_removed > 0 and n_removed = n_lines)").select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")
