"""N-gram Jaccard join: rare-first prefix filtering, each candidate pair verified once.

1. ``classes``: one pass hashes every whole text into its set of word shingles.
   Documents with the same set form a class (their Jaccard is 1); copies are
   never expanded into pairs. The same pass counts shingles in a table of a
   fixed number of counters, which gives all documents one order of shingles,
   rare ones first. A counter shared by several shingles makes that order less
   sharp, never wrong: any order that all documents share is right.
2. ``postings``: a second pass emits the first ``n - ceil(t n) + 1`` shingles of
   each set in that order; two sets with Jaccard ``t`` share one of them. A
   frequent shingle's rows are salted over several tasks. Only shingles that two
   classes hold are kept.
3. Within a shingle, classes are first compared with one pivot, which joins a
   large group of near copies by one pair a member. Pairs inside one component
   need no further check; pairs across components are then all looked for. Under
   shingles of few classes that means all their pairs. In larger groups a shared
   shingle says little: there the members' deviations from a common centre are
   joined instead (``deviations``), whose keys are rare inside the group too. So
   no link between different texts that would join two components is lost, and
   dense groups never become all their pairs.
4. Length, positional and suffix filters come before the sets are fetched; a
   pair that is left is verified once on the whole sets.

64-bit hashes stand for shingles and for sets: two of 10**9 sets share a hash
with a chance of about 3 %; (hash, size) is compared throughout.

Cases. Nulls and empty texts, or texts without words, have an empty set and no
link. Rows with equal ids each get a row; a null id takes part but is never a
component's smallest id unless it has no other. Repeated rows are copies of one
class. Ties of rarity go by hash, ties of pivots too; they change no result. Very
long texts are hashed whole. An empty table gives an empty table. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.llm import deviations as D
from linemill.llm import shingles as S
from linemill.llm.batches import bounded
from linemill.llm.components import components
from linemill.llm.scratch import Scratch
from linemill.llm.skew import counted, frequent, spread_join

#: Bins of the suffix filter: how many shingles of a set fall into each range of hashes.
BINS = 16
#: Classes under a key of deviations up to which all pairs are compared, as a multiple of ``narrow``: most are told apart without their sets.
KEYS = 32
#: Times that large groups are made narrower before all pairs under their keys are formed.
LEVELS = 8
_SIGNED = np.uint64(1 << 63)


def _set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(S.mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
        return int(S.mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _count_pass(k: int, bits: int, id_col: str):
    chunk = 1 << min(bits, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        counts = np.zeros(1 << bits, np.int64)
        held, size, seen = [], 0, False
        for b in batches:
            ids, n, keys, sig = b.column(0), [], [], []
            for _, s in S.shingle_sets(b.column(1), k):
                n.append(len(s))
                keys.append(_set_key(s))
                at = np.searchsorted(s, np.arange(1, BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
                sig.append(np.diff(np.concatenate(([0], at, [len(s)]))).astype(np.int32).tolist())
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    _tally(counts, held, bits)
                    held, size = [], 0
            seen = True
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.int64()), pa.array(sig, pa.list_(pa.int32())),
                 pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                ["doc_id", "n", "node", "sig", "part", "counts"],
            )
        if seen:
            _tally(counts, held, bits)
            rows = [(i, zlib.compress(part.astype(np.uint32).tobytes(), 1)) for i, part in enumerate(counts.reshape(-1, chunk)) if part.any()]
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())),
                 pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                ["doc_id", "n", "node", "sig", "part", "counts"],
            )

    return run


def _tally(counts: np.ndarray, held: list[np.ndarray], bits: int) -> None:
    if held:
        slots = np.concatenate(held) >> np.uint64(64 - bits)
        counts += np.bincount(slots.astype(np.int64), minlength=len(counts))


def _add_counts(bits: int):
    chunk = 1 << min(bits, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(blob), np.uint32)
                at = sums.setdefault(part, np.zeros(chunk, np.uint64))
                at += got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes(), 1) for v in sums.values()], pa.binary())],
            ["part", "counts"],
        )

    return run


def _sketch(pass_one: DataFrame, bits: int) -> np.ndarray:
    """Sums the tasks' counters. What reaches the driver is at most 4 * 2**bits bytes."""
    import zlib

    rows = pass_one.filter("part is not null").select("part", "counts")
    rows = rows.repartition("part", F.expr("spark_partition_id() % 32")).mapInArrow(_add_counts(bits), "part int, counts binary").repartition("part")
    chunk = 1 << min(bits, 16)
    out = np.zeros(1 << bits, np.uint32)
    for part, blob in rows.mapInArrow(_add_counts(bits), "part int, counts binary").collect():
        out[part * chunk : (part + 1) * chunk] = np.frombuffer(zlib.decompress(blob), np.uint32)
    return out


def _prefix_pass(k: int, percent: int, bits: int, sketch, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for b in batches:
            seen: set[int] = set()
            out: list[tuple] = []
            size = 0
            for _, s in S.shingle_sets(b.column(0), k):
                n = len(s)
                if not n or (node := _set_key(s)) in seen:
                    continue  # a copy inside this batch: its class is there already
                seen.add(node)
                often = np.minimum(counts[(s >> np.uint64(64 - bits)).astype(np.int64)], 2**24 - 1).astype(np.uint64)
                keys = often << np.uint64(40) | s >> np.uint64(24)
                p = n - -(-percent * n // 100) + 1
                order = np.argsort(keys, kind="stable")[:p]
                out.append((s[order], node, n, often[order], int(keys[order[-1]] >> np.uint64(33))))
                size += p
                if size > 200_000:
                    yield _postings(out, hot)
                    out, size = [], 0
            if out:
                yield _postings(out, hot)

    return run


def _postings(rows: list, hot: int) -> pa.RecordBatch:
    lens = np.array([len(r[0]) for r in rows])
    node = np.repeat(np.array([r[1] for r in rows], np.int64), lens)
    parts = np.concatenate([r[3] for r in rows]) // np.uint64(hot) + np.uint64(1)
    salt = np.where(parts > 1, node.view(np.uint64) % parts, 0).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)),
            pa.array(np.where(parts > 1, salt, -1).astype(np.int32)),
            pa.array(node),
            pa.array(np.repeat(np.array([r[2] for r in rows], np.int32), lens)),
            pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lens])),
            pa.array(np.repeat(np.array([r[4] for r in rows], np.int32), lens)),
        ],
        ["shingle", "salt", "node", "n", "pos", "end"],
    )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shingle and node: each class once, where a shingle has two classes or is salted."""
    carry: pa.RecordBatch | None = None  # the last row so far, and whether it has gone out
    carry_out = False
    for b in batches:
        if not len(b):
            continue
        if carry is not None:
            b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
        sh, node, salt = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 1))
        same = np.zeros(len(b), bool)
        same[1:] = (sh[1:] == sh[:-1]) & (node[1:] == node[:-1])
        keep = np.flatnonzero(~same)
        k_sh, k_salt = sh[keep], salt[keep]
        near = np.zeros(len(keep), bool)
        near[1:] |= k_sh[1:] == k_sh[:-1]
        near[:-1] |= k_sh[1:] == k_sh[:-1]
        near |= k_salt >= 0
        before_gone, start = carry_out, carry is not None
        carry_out = bool(near[-1]) or (before_gone and len(keep) == 1 and start)
        carry = b.slice(int(keep[-1]), 1)
        if start and before_gone:
            near[0] = False
        take = keep[near]
        if len(take):
            yield b.take(pa.array(take)).select(["shingle", "node", "n", "pos", "end"])


def _needed(percent: int) -> str:
    """Least intersection of sets of sizes n and pn."""
    return f"(({percent}L * (n + pn) + {99 + percent}L) div {100 + percent}L)"


def _prefix(percent: int, n: str) -> str:
    return f"({n} - ({percent}L * {n} + 99L) div 100L + 1)"


def _most(percent: int, common: str) -> str:
    """Greatest intersection, if ``common`` shingles at most are in both prefixes.

    What the prefix that ends earlier has and the other lacks is nowhere in the
    other set. ``end`` is a coarse place: equal ends leave either possible.
    """
    x, y = (f"{n} - {_prefix(percent, n)}" for n in ("n", "pn"))
    return f"({common} + case when end < pend then {x} when pend < end then {y} else greatest({x}, {y}) end)"


def _verify(percent: int):
    @F.arrow_udf("boolean")
    def check(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return check


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int, bits: int, hot: int, narrow: int, id_col: str, text_col: str):
        self.spark, self.k, self.percent, self.bits, self.hot, self.narrow = docs.sparkSession, k, percent, bits, hot, narrow
        bounded(self.spark)
        self.scratch = Scratch(self.spark, "ngram_join")
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        one = self.docs.mapInArrow(_count_pass(k, bits, "doc_id"), "doc_id long, n int, node long, sig array<int>, part int, counts binary")
        self.one = self.scratch.keep(one, "sets")
        self.rows = self.one.filter("part is null").select("doc_id", "n", "node")
        self.classes = self.scratch.keep(
            self.one.filter("part is null and n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes"
        )

    def postings(self) -> DataFrame:
        """shingle, node, n, pos, end, and held: how many of the node's prefix shingles others hold."""
        self.sketch = self.spark.sparkContext.broadcast(_sketch(self.one, self.bits))
        rows = self.docs.select("text").mapInArrow(
            _prefix_pass(self.k, self.percent, self.bits, self.sketch, self.hot), "shingle long, salt int, node long, n int, pos int, end int"
        )
        rows = rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "node")
        rows = self.scratch.keep(rows.mapInArrow(_shared, "shingle long, node long, n int, pos int, end int"), "postings")
        held = rows.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("held"))
        both = self.scratch.keep(rows.join(held, "node"), "postings")
        self.scratch.drop(rows)
        return both

    def _allowed(self) -> str:
        """What one shared shingle allows, of rows and p-rows."""
        length = f"100L * least(n, pn) >= {self.percent}L * greatest(n, pn)"
        place = f"1 + least(pos, ppos) + least(n - 1 - pos, pn - 1 - ppos) >= {_needed(self.percent)}"
        prefix = f"{_most(self.percent, 'least(held, pheld)')} >= {_needed(self.percent)}"
        return f"comp != pcomp and {length} and {place} and {prefix}"

    def _candidates(self, pairs: DataFrame) -> DataFrame:
        """One row a pair that the filters pass. The p-side may hold very many pairs of one class."""
        need = _needed(self.percent)
        each = (
            pairs.groupBy("node", "n", "end", "pnode", "pn", "pend")
            .agg(F.count(F.lit(1)).alias("c"), F.max("pos").alias("last"), F.max("ppos").alias("plast"))
            .filter(f"c + least(n - 1 - last, pn - 1 - plast) >= {need} and {_most(self.percent, 'c')} >= {need}")
        )
        each = self.scratch.keep(each.select("node", "n", "pnode", "pn"), "met")
        self.often = self.scratch.keep(frequent(counted(each, ["pnode", "pn"]), ["pnode", "pn"], self.scratch.rows(each)).coalesce(1), "often")
        sig = self.classes.select("node", "n", "sig")
        apart = F.expr("aggregate(zip_with(sig, psig, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)")
        both = spread_join(each.join(sig, ["node", "n"]), sig.toDF("pnode", "pn", "psig"), ["pnode", "pn"], "node", self.often)
        left = self.scratch.keep(both.filter(apart <= F.expr(f"n + pn - 2 * {need}")).select("node", "n", "pnode", "pn"), "candidates")
        self.scratch.drop(each)
        return left

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, n, members) of the classes in ``nodes`` (node, n; repetitions are allowed), read from one document of each."""
        wanted = nodes.distinct().join(self.classes.select("node", "n", "rep"), ["node", "n"])
        # A filter of fixed size spares most texts; the join behind it is exact.
        bits, k = 22, self.k
        slots = wanted.select(F.expr(f"pmod(xxhash64(rep), {1 << bits})").alias("s"))
        words = slots.groupBy(F.expr("s div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("m"))
        table = np.zeros(1 << (bits - 5), np.int64)
        for w, m in words.collect():  # at most 2**(bits - 5) rows
            table[w] = m
        seen = self.spark.sparkContext.broadcast(table)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slot = b.column(0).to_numpy()
                b = b.filter(pa.array((seen.value[slot >> 5] >> (slot & 31) & 1).astype(bool)))
                got = [(_set_key(s), len(s), s.tobytes()) for _, s in S.shingle_sets(b.column(1), k) if len(s)]
                for i in range(0, len(got), 2000):
                    part = got[i : i + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in part], pa.int64()), pa.array([g[1] for g in part], pa.int32()), pa.array([g[2] for g in part], pa.binary())], ["node", "n", "members"])

        own = self.docs.select(F.expr(f"pmod(xxhash64(doc_id), {1 << bits})").alias("slot"), "text")
        # Of a class, the document that stands for it is read; where ids repeat, a row of them.
        read = own.mapInArrow(found, "node long, n int, members binary").repartition("node", "n")
        read = read.join(wanted.select("node", "n").hint("shuffle_hash"), ["node", "n"], "left_semi").groupBy("node", "n").agg(F.max("members").alias("members"))
        return self.scratch.keep(read, "members")

    def verified(self, pairs: DataFrame, sets: DataFrame, often: DataFrame | None = None) -> DataFrame:
        """(a, b) of the pairs whose whole sets are alike enough. often: classes that very many pairs have on the p-side."""
        own, other = pairs.join(sets, ["node", "n"]), sets.toDF("pnode", "pn", "pmembers")
        both = own.join(other, ["pnode", "pn"]) if often is None else spread_join(own, other, ["pnode", "pn"], "node", often)
        return self.scratch.keep(both.filter(_verify(self.percent)("members", "pmembers")).select(F.col("node").alias("a"), F.col("pnode").alias("b")), "links")

    def _linked(self, *found: DataFrame) -> None:
        """Take more links, and unite what they connect."""
        for x in found:
            self.links = x if self.links is None else self.links.unionByName(x)
        if any(self.scratch.rows(x) for x in found):
            self.roots = self.scratch.keep(components(self.links, self.scratch), "roots")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the components as they are known by now."""
        if self.roots is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.drop("comp").join(self.roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    def _open(self, posts: DataFrame, turn: int = 0) -> DataFrame:
        """Postings of shingles that lie in two components, beside m, the postings of the shingle, and its pivot.

        The pivot is the class of which others hold most: of edited copies the one
        least edited (of a later turn, another one, by a hash). It comes first in one
        order of all classes, so that a pair is met in one direction.
        """
        now = self._placed(posts).withColumn("w", F.expr("0D" if turn else f"-held / {_prefix(self.percent, 'n')}"))
        names = ("node", "n", "pos", "end", "held", "comp")
        stats = now.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("w", F.xxhash64("node", F.lit(turn)).alias("h"), *names)).alias("p")
        )
        stats = stats.filter("lo != hi").select("shingle", "m", *(F.col(f"p.{x}").alias(f"p{x}") for x in names))
        return self.scratch.keep(spread_join(now, stats, ["shingle"], "node", frequent(stats, ["shingle"], self.scratch.rows(posts))), "open")

    def run(self, stars: int) -> DataFrame:
        self.links = self.roots = None
        posts = self.postings()
        rows = self._open(posts)
        for turn in range(1, stars + 1):
            if not self.scratch.rows(rows):
                break
            pairs = self._candidates(rows.filter(self._allowed()))
            sets = self.sets(_sides(pairs))
            self._linked(self.verified(pairs, sets, self.often))
            self.scratch.drop(pairs, sets, rows)
            rows = self._open(posts, turn if turn < stars else 0)
        if self.scratch.rows(rows):
            self._rest(rows)
        # Nodes to the smallest id of their component.
        if self.roots is None:
            least = self.classes.select("node", "n", F.col("rep").alias("component_id"))
        else:
            placed = self.classes.join(self.roots, "node", "left").select("node", "n", "rep", F.coalesce("root", "node").alias("root"))
            least = placed.join(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "n", "component_id")
        return self.rows.join(least, ["node", "n"], "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id").alias("component_id"), F.col("node").alias("class_key")
        )

    def _rest(self, rows: DataFrame) -> None:
        """Every pair across components: under shingles of up to ``narrow`` classes at once, under others by deviations."""
        few, many = rows.filter(F.col("m") <= self.narrow), rows.filter(F.col("m") > self.narrow)
        names = ("node", "n", "pos", "end")
        own = few.select("shingle", *names, "held", "comp")
        other = own.toDF("shingle", *(f"p{x}" for x in (*names, "held", "comp")))
        pairs = self._candidates(own.join(other, "shingle").filter(f"node < pnode and {self._allowed()}"))
        groups = self.scratch.keep(many.select(F.col("pnode").alias("g"), "node", "n", "comp").distinct(), "groups")
        sets = self.sets(_sides(pairs).unionByName(groups.select("node", "n")))
        found = [self.verified(pairs, sets)]
        for level in range(1, LEVELS + 1):
            if not self.scratch.rows(groups):
                break
            more, groups = self._narrower(groups, sets, last=level == LEVELS)
            self._linked(*found, *more)
            found = []
            if self.scratch.rows(groups):
                groups = self.scratch.keep(self._placed(groups), "groups")
        if found:
            self._linked(*found)

    def _narrower(self, groups: DataFrame, sets: DataFrame, last: bool) -> tuple[list[DataFrame], DataFrame]:
        """Links of what lies in ``groups`` (g, node, n, comp), and the larger groups under keys, whose pairs are not among them."""
        sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("g", "m")
        rows = spread_join(groups, sizes, ["g"], "node", frequent(sizes, ["g"], self.scratch.rows(groups)))
        own = self.scratch.keep(D.deviations(rows, sets, self.percent, self.bits, self.sketch), "deviations")
        near = self.scratch.keep(D.linked_by_centre(own), "links")
        keys = self.scratch.keep(D.keys(own), "keys")
        rows = self.scratch.keep(D.open_keys(keys, self.scratch.rows(keys)), "keys")
        pairs = D.pairs(rows if last else rows.filter(F.col("m") <= KEYS * self.narrow), self.percent).distinct()
        links = self.verified(self.scratch.keep(pairs, "candidates"), sets)
        left = self.scratch.keep(rows.filter("false" if last else f"m > {KEYS * self.narrow}").select(F.col("key").alias("g"), "node", "n").distinct(), "groups")
        self.scratch.drop(own, keys, rows, groups)
        return [near, links], left


def _sides(pairs: DataFrame) -> DataFrame:
    return pairs.select("node", "n").unionByName(pairs.select(F.col("pnode").alias("node"), F.col("pn").alias("n")))


def ngram_components(
    docs: DataFrame, *, k: int = 5, percent: int = 80, sketch_bits: int = 20, hot: int = 1 << 16, stars: int = 1, narrow: int = 32, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, class_key (equal for equal sets).

    k, percent: words a shingle, and the least Jaccard in hundredths. sketch_bits:
    2**sketch_bits counters of 4 bytes order the shingles. hot: rows of a
    shingle from which they are dealt to several tasks. stars: rounds of pivots
    at most. narrow: classes under a shingle or key up to which all their pairs are
    formed; larger groups are split by their members' deviations first.
    """
    return _Join(docs, k, percent, sketch_bits, hot, narrow, id_col, text_col).run(stars)
