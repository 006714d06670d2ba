"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed keys are canonical URLs without scheme, ``host/path``: a key fits its host
and all subdomains where the url's path starts with the key's. Every url yields
the keys that could fit it (its host's suffixes with its path's prefixes, of the
lengths that occur in the list); the filter, a bounded array of 64-bit words,
passes those that may be listed. A url of which it passes none is answered where
it stands. For the others the hash join removes what was passed wrongly: once
for each distinct set of passed keys, however many urls have it. Only built-in
expressions run.

Rules meet the url as it is written: host after the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z lower-cased; path then up to ``?``, ``#`` or the end.
Listings meet its canonical form: the host without user part, port and final
dot, and ``/`` for an empty path.

A list of any length works: the filter never has more than ``max_blocks``
blocks. Past their capacity it passes more, and the join still decides.

Cases. A null url, an empty one, or one without ``://`` has empty host and path
and is allowed unless a rule has neither. Very long urls: work grows with the
url's length times the lengths in the list. Of fitting rules the longest wins,
of equally long ones that with the longer host; of a key listed twice, a rule
counts before a listing, ``allow`` before ``block``. Each row of the input gives
one row; repeated rows and rows with the same url get the same verdict. An empty
table gives an empty one; with an empty list everything is allowed. Other
columns of any name are not read. A url that no rule fits is blocked if a listed
key fits it, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm.bloom import BloomFilter
from linemill.llm.scratch import Scratch
from linemill.llm.skew import counted, frequent, spread_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules (key, verdict), and the hosts listed as unwanted.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
LISTED = [f"{name}.example.{top}/" for name in ("casino-win", "free-bets", "cheap-pills", "adult-x", "spam-farm", "ads-track") for top in ("com", "net", "org")]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(h: Column) -> Column:
    """Without user part, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def candidates(h: Column, p: Column, depths: Column, lengths: Column) -> Column:
    """Keys that could fit: host suffixes of so many labels, with path prefixes of so many characters."""
    labels = F.split(h, r"\.", -1)
    count = F.size(labels)
    hosts = F.transform(F.filter(depths, lambda n: n <= count), lambda n: F.array_join(F.slice(labels, count - n + 1, n), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length(p)), lambda n: F.substring(p, F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda x: F.transform(paths, lambda y: F.concat(x, y))))


def _shape(keys: DataFrame, kind: str) -> DataFrame:
    """The numbers of host labels and the path lengths that occur: one row of as many numbers as there are."""
    at = F.instr("key", "/")
    labels = F.size(F.split(F.expr("substring(key, 1, instr(key, '/') - 1)"), r"\.", -1))
    return keys.agg(F.array_sort(F.collect_set(labels)).alias(f"{kind}_depths"), F.array_sort(F.collect_set(F.length("key") - at + 1)).alias(f"{kind}_lengths"))


def judge(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", max_blocks: int = 1 << 16) -> DataFrame:
    """One row a row of ``pages``: its id, host, path, rule, verdict, listed (the longest listed key that fits, else null).

    listed: (key, verdict, is_rule). A key begins with its host and holds ``/``.
    """
    scratch = Scratch(pages.sparkSession, "url_filter")
    listed = listed.groupBy("key").agg(F.min_by("verdict", F.struct(~F.col("is_rule"), "verdict")).alias("verdict"), F.max("is_rule").alias("is_rule"))
    bloom = BloomFilter(listed, "key", max_blocks)
    shapes = {f"{kind}_{x}": _shape(listed.filter(F.col("is_rule") == is_rule), kind).select(f"{kind}_{x}").scalar() for kind, is_rule in (("rule", True), ("list", False)) for x in ("depths", "lengths")}
    own = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    each = own.withColumns(shapes | {"bits": bloom.bits()})
    h, p = F.col("host"), F.col("path")
    could = F.array_union(
        candidates(h, p, F.col("rule_depths"), F.col("rule_lengths")),
        F.transform(candidates(canonical_host(h), F.when(p == "", "/").otherwise(p), F.col("list_depths"), F.col("list_lengths")), lambda k: F.concat(F.lit("="), k)),
    )
    # A listing is marked by "=", so that it isn't met by a url as it is written, nor a rule by a canonical one.
    passed = F.filter(could, lambda k: bloom.may_contain(F.regexp_replace(k, "^=", ""), F.col("bits")))
    each = each.select("page_id", "host", "path", F.array_sort(passed).alias("passed"))
    quiet = each.filter(F.size("passed") == 0).select("page_id", "host", "path", *(F.lit(x).cast("string").alias(y) for x, y in ((None, "rule"), ("allow", "verdict"), (None, "listed"))))
    loud = scratch.keep(each.filter(F.size("passed") > 0), "passed")
    keys = listed.select(F.when(F.col("is_rule"), F.col("key")).otherwise(F.concat(F.lit("="), "key")).alias("mark"), "key", "verdict", "is_rule")
    sets = loud.select("passed").distinct()
    length = F.struct(F.length("key"), F.instr("key", "/"))
    best = (
        sets.select("passed", F.explode("passed").alias("mark"))
        .join(keys, "mark", "left")
        .groupBy("passed")
        .agg(
            F.max_by(F.when(F.col("is_rule"), F.struct("key", "verdict")), F.when(F.col("is_rule"), length)).alias("r"),
            F.max_by(F.when(~F.col("is_rule"), F.struct("key", "verdict")), F.when(~F.col("is_rule"), length)).alias("l"),
        )
    )
    best = scratch.keep(best.select("passed", F.col("r.key").alias("rule"), F.coalesce("r.verdict", "l.verdict", F.lit("allow")).alias("verdict"), F.col("l.key").alias("listed")), "best")
    found = spread_join(loud, best, ["passed"], "page_id", frequent(counted(loud, ["passed"]), ["passed"], scratch.rows(loud)))
    return quiet.unionByName(found.select(*quiet.columns))


def listing(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    rows = [(k, v, True) for k, v in rules] + [(k, "block", False) for k in listed]
    values = ", ".join(f"('{k}', '{v}', {str(r).lower()})" for k, v, r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(key, verdict, is_rule)")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listing(spark))


OP3_SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(instr(url, '://'), 0) AS p, url FROM pages
), v AS (
  SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS tail FROM u
), w AS (
  SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM v
), c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\\.$', '') AS list_host,
         CASE WHEN path = '' THEN '/' ELSE path END AS list_path FROM w
), listed(key, verdict, is_rule) AS (
  VALUES {', '.join([f"('{k}', '{v}', true)" for k, v in RULES] + [f"('{k}', 'block', false)" for k in LISTED])}
), met AS (
  SELECT page_id, true AS is_rule, host, path FROM c UNION ALL SELECT page_id, false, list_host, list_path FROM c
), fits AS (
  SELECT m.page_id, l.*, row_number() OVER (PARTITION BY m.page_id, l.is_rule ORDER BY length(l.key) DESC, instr(l.key, '/') DESC) AS n
  FROM met m JOIN listed l ON m.is_rule = l.is_rule AND starts_with(m.path, substr(l.key, instr(l.key, '/')))
   AND (m.host = substr(l.key, 1, instr(l.key, '/') - 1) OR ends_with(m.host, '.' || substr(l.key, 1, instr(l.key, '/') - 1)))
)
SELECT w.page_id, w.host, w.path, r.key AS rule, coalesce(r.verdict, l.verdict, 'allow') AS verdict, l.key AS listed
FROM w LEFT JOIN fits r ON r.page_id = w.page_id AND r.is_rule AND r.n = 1
       LEFT JOIN fits l ON l.page_id = w.page_id AND NOT l.is_rule AND l.n = 1
"""
