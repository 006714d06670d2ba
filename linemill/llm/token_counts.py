"""Token counts as delta-maintained rollups.

A change is a signed insert, delete or revised count of one document under one
tokenizer version. A batch of changes is aggregated by source, language and
tokenizer before the shuffle, and written under its batch name; a batch that is
there already is not written again, so a commit may be repeated after a failure
without counting twice. Totals are the sums over all batches. ``compact`` folds
the committed batches into one table, with their names beside it; the names
count as committed from then on, and the last finished fold is the one that is
read, so a fold that a failure cut off changes nothing. One writer folds at a time.

Counts are a column of the caller's: a column that holds them, ``bpe.counter``
for a tokenizer's vocabulary, or the built-in expressions below.

Cases. Null sources and languages are groups of their own. Null texts count as
empty: one document without tokens. Whole texts are counted, however long.
Repeated rows are counted as often as they occur. Sums know no ties. A batch
without rows is committed and changes nothing; without batches the totals are
empty. Other columns of any name are not read. Batch names are any text, the
empty one included; one of more than 200 characters as it is encoded is refused.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm.scratch import Scratch, _path, exists, shared_dir

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
# The pieces that two versions of a rule-based tokenizer count.
# 1: letters and digits together, each other sign by itself. 2: letters, digits and runs of other signs apart.
PIECES_1 = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
PIECES_2 = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+"


def pieces(text: Column, rule: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rule)), F.lit(0)).cast("long")


def inserted(docs: DataFrame, tokenizer: str, count: Column) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), count.alias("n_tokens"))


def deleted(docs: DataFrame, tokenizer: str, count: Column) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(-1).cast("long").alias("n_docs"), (-count).alias("n_tokens"))


def revised(docs: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), (after - before).alias("n_tokens"))


def _folder(batch: str) -> str:
    """The folder of a batch: its name with every sign that paths treat in their own way encoded."""
    name = quote(batch, safe="").replace("~", "%7E")
    if len(name) > 200:
        raise ValueError(f"batch name too long: {batch[:80]}...")
    return f"batch={name}"


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self, batch: str) -> bool:
        if exists(self.spark, f"{self.root}/{_folder(batch)}/_SUCCESS"):
            return True
        return self._fold() > 0 and not self._names().filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it is there already. What an earlier try left unfinished is replaced."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/{_folder(batch)}")
        return True

    def _finished(self, prefix: str) -> list[str]:
        """What follows ``prefix`` in the names of tables that were written to their end."""
        path, fs = _path(self.spark, self.root)
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return [n.removeprefix(prefix) for n in names if n.startswith(prefix) and exists(self.spark, f"{self.root}/{n}/_SUCCESS")]

    def _fold(self) -> int:
        return max(map(int, self._finished("fold=")), default=0)

    def _names(self) -> DataFrame:
        """Names of the batches that the last fold holds."""
        n = self._fold()
        return self.spark.read.schema("batch string").parquet(f"{self.root}/names={n}") if n else self.spark.createDataFrame([], "batch string")

    def batches(self) -> list[str]:
        """Committed batches that no fold holds: those since the last fold."""
        found = [unquote(n) for n in self._finished("batch=")]
        if not found or not self._fold():
            return found
        here = self.spark.createDataFrame([(b,) for b in found], "batch string")
        return sorted(r.batch for r in here.join(self._names(), "batch", "left_anti").collect())

    def _sums(self, names: list[str]) -> DataFrame | None:
        n = self._fold()
        found = [f"{self.root}/fold={n}"] * bool(n) + [f"{self.root}/{_folder(b)}" for b in names]
        if not found:
            return None
        every = self.spark.read.schema(_DELTA).parquet(*found)
        return every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens; a group whose documents are all gone has no row."""
        sums = self._sums(self.batches())
        return self.spark.createDataFrame([], _DELTA) if sums is None else sums

    def compact(self) -> int:
        """Fold the committed batches; how many were folded. Their own tables, and the fold before, go when the new one is finished."""
        new = self.batches()
        if new:
            before = self._fold()
            names = self._names().unionByName(self.spark.createDataFrame([(b,) for b in new], "batch string"))
            names.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/names={before + 1}")
            self._sums(new).write.mode("overwrite").parquet(f"{self.root}/fold={before + 1}")
        now, since = self._fold(), set(self.batches())
        old = [f"batch={b}" for b in self._finished("batch=") if unquote(b) not in since] + [f"{kind}{n}" for kind in ("fold=", "names=") for n in self._finished(kind) if int(n) < now]
        for name in old:
            path, fs = _path(self.spark, f"{self.root}/{name}")
            fs.delete(path, True)
        return len(new)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under two tokenizers; one is replaced by its next version, document by document; empty texts are deleted; one language is deleted and comes in again; batches are repeated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    counts = docs.select("source", "lang", pieces(text, PIECES_1).alias("first"), pieces(text, PIECES_2).alias("second"), F.octet_length(text).cast("long").alias("by_byte"))
    counts = Scratch(spark, "token_counts").keep(counts)  # texts are read once; the batches below are of counts
    first, second, by_byte = F.col("first"), F.col("second"), F.col("by_byte")
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    path, fs = _path(spark, rollup.root)
    fs.deleteOnExit(path)
    rollup.commit("1", inserted(counts, "pieces", first))
    rollup.commit("2", inserted(counts, "bytes", by_byte))
    changed = revised(counts, "pieces", first, second)
    rollup.commit("3", changed)
    rollup.commit("3", changed)
    none = counts.filter(by_byte == 0)
    rollup.commit("4", deleted(none, "pieces", second).unionByName(deleted(none, "bytes", by_byte)))
    one = counts.filter(F.col("lang") == counts.agg(F.min("lang")).first()[0]).filter(by_byte > 0)
    rollup.commit("5", deleted(one, "pieces", second).unionByName(deleted(one, "bytes", by_byte)))
    rollup.commit("6", inserted(one, "pieces", second).unionByName(inserted(one, "bytes", by_byte)))
    rollup.commit("1", inserted(counts, "pieces", first))
    return rollup.totals()


OP8_SQL = rf"""
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM (
  SELECT source, lang, 'pieces' AS tokenizer, len(regexp_extract_all(text, '{PIECES_2}')) AS n FROM documents WHERE text <> ''
  UNION ALL
  SELECT source, lang, 'bytes', strlen(text) FROM documents WHERE text <> ''
) GROUP BY source, lang, tokenizer
"""
