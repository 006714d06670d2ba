"""The engine's queries over the driver's tables, and their SQL.

Tables with text stand for trees: a row is a file, its path made of its keys.
Tokens of the languages are put in place of common words, alike on both sides.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linemill.functions import names
from linemill.functions.lexer import Spec, lex
from linemill.operators import pruning
from linemill.operators.detect import detect
from linemill.operators.stats import METRICS, file_stats, language_stats, ranked, totals
from linemill.plans.report import CSV_HEADER
from linemill.sources.registry import Registry
from linemill.sources.tree import read_tree

REGISTRY = Registry()
_PUT = [(" of ", " /* "), (" and ", " */ "), (" that ", " // "), (" in ", " # "), (" to ", " -- "), (", ", ' " '), (" it ", ' """ '), (" on ", " ` "), (" as ", ' \\" '), (" or ", " ' "), (" de ", " <!-- "), (" la ", " --> "), (". ", "\n\n")]
_EXTENSIONS = ["py", "c", "sql", "md", "txt", "go", "css"]
_NAMES = ["main.cpp", "CMakeLists.txt", "Makefile", "makefile", "notes.bin", ".py", "x.", "README.MD", "SCRIPT.PY", "none", "a.b.rs"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _put_sql(column: str) -> str:
    for a, b in _PUT:
        column = f"replace({column}, {_q(a)}, {_q(b) if chr(10) not in b else 'chr(10) || chr(10)'})"
    return column


def _put(column):
    for a, b in _PUT:
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def _pick(column: str, values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


def _pick_sql(column: str, values: list[str]) -> str:
    return f"([{', '.join(map(_q, values))}])[{column} % {len(values)} + 1]"


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan whose files have fewer row groups than there are cores is dealt out by its keys; a larger one stays as it is read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan._jdf.rdd().getNumPartitions() < cores else scan


def corpus(spark, sf: str) -> DataFrame:
    """path, content of documents, pages and conversations as one tree."""
    columns = {"documents": ("doc_id", "source", "text"), "pages": ("page_id", "html"), "conversations": ("conv_id", "turn", "text")}
    read = lambda t: spread(spark.read.parquet(f"{sf}/{t}.parquet").select(*columns[t]), *columns[t][:2 if t == "conversations" else 1])
    docs = read("documents").select(F.concat_ws("/", "source", F.concat("doc_id", F.lit("."), _pick("doc_id", _EXTENSIONS))).alias("path"), _put(F.col("text")).alias("text"))
    pages = read("pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("text"))
    talks = read("conversations").select(F.concat("conv_id", F.lit("/"), "turn", F.lit(".md")).alias("path"), "text")
    return docs.unionByName(pages).unionByName(talks).select("path", F.encode("text", "UTF-8").alias("content"))


_CORPUS = f"""
SELECT source || '/' || doc_id || '.' || {_pick_sql('doc_id', _EXTENSIONS)} AS path, {_put_sql('text')} AS text FROM documents
UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages
UNION ALL SELECT conv_id || '/' || turn || '.md', text FROM conversations"""
_BY_EXTENSION = [("py", "Python"), ("c", "C"), ("sql", "Sql"), ("md", "Markdown"), ("txt", "Text"), ("go", "Go"), ("css", "Css"), ("html", "Html")]


def _re(token: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in token)


def _tokens(spec: Spec) -> list[tuple[str, str]]:
    """(kind, expression) in the order in which they are tried."""
    longest = lambda pairs: sorted(pairs, key=lambda p: -len(p[0]))
    out = [("line", f"{_re(t)}[^\\n]*") for t, _ in longest([(t, "") for t in spec.line])]
    out += [("block", f"{_re(s)}(?s:.)*?(?:{_re(e)}|\\z)") for s, e in longest(spec.block)]
    for s, e, many in sorted([(*q, False) for q in spec.quotes] + [(*q, True) for q in spec.multiline], key=lambda p: -len(p[0])):
        if many:
            out.append(("code", f"{_re(s)}(?s:\\\\\\n*[^\\n]|[^\\\\])*?(?:{_re(e)}|\\\\\\n*\\z|\\z)"))
        else:
            out.append(("code", f"{_re(s)}(?:[^{_re(e)}\\\\\\n]|\\\\[^\\n])*\\\\?{_re(e)}?"))
    return out


def lexer_sql(source: str, spec: Spec) -> str:
    """(path, total_lines, code_lines, comment_lines, blank_lines) of a query's (path, text): tokens, cut at newlines into pieces of lines."""
    kinds = _tokens(spec)
    every = "|".join([p for _, p in kinds] + ["\\n", "(?s:.)"])
    case = " ".join(["WHEN false THEN ''"] + [f"WHEN regexp_full_match(t, {_q(p)}) THEN '{k}'" for k, p in kinds])
    plain = "CASE WHEN t IN (' ', chr(9), chr(13), chr(10)) THEN 'space' ELSE 'code' END"
    return f"""
SELECT path, count(*) FILTER (n < 0 OR filled) AS total_lines, count(*) FILTER (code) AS code_lines,
       count(*) FILTER (filled AND NOT code) AS comment_lines, count(*) FILTER (NOT filled AND n < 0) AS blank_lines
FROM (
  SELECT path, line, coalesce(bool_or(kind = 'code' AND piece <> ''), false) AS code,
         coalesce(bool_or(kind <> 'space' AND piece <> ''), false) AS filled,
         CASE WHEN line < max(last) THEN -1 ELSE 0 END AS n
  FROM (
    SELECT path, kind, last, start + k - 1 AS line, pieces[k] AS piece
    FROM (
      SELECT path, kind, string_split(t, chr(10)) AS pieces, last, (sum(newlines) OVER (PARTITION BY path ORDER BY i)) - newlines AS start
      FROM (
        SELECT path, i, t, length(t) - length(replace(t, chr(10), '')) AS newlines, last, CASE {case} ELSE {plain} END AS kind
        FROM (SELECT path, last, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT path, regexp_extract_all(text, {_q(every)}) AS l, length(text) - length(replace(text, chr(10), '')) AS last FROM ({source})))
      )
    ), unnest(range(1, len(pieces) + 1)) AS u(k)
  ) GROUP BY path, line
) GROUP BY path"""


def nested_lexer_sql(source: str, spec: Spec) -> str:
    """As ``lexer_sql`` for nested comments: a fold over pieces (single signs of the tokens, and runs between them), with the state beside the counts.

    m: 0 outside, 1 in a line comment, 100 + i in a block, 200 + i in a string. d: depth. k: pieces of a token still to be passed over. e: behind a backslash.
    """
    line, block = sorted(spec.line, key=len, reverse=True), sorted(spec.block, key=lambda p: -len(p[0]))
    strings = sorted([(*q, False) for q in spec.quotes] + [(*q, True) for q in spec.multiline], key=lambda p: -len(p[0]))
    tokens = [*line, *(t for p in block for t in p), *(t for a, b, _ in strings for t in (a, b))]
    signs = "".join("\\" + c if not c.isalnum() else c for c in sorted(set("".join(tokens)))) + "\\\\\\n"
    at = lambda t: f"starts_with(x.u, {_q(t)})"
    size, events = {}, ["WHEN a.k > 0 THEN 0", "WHEN x.t = chr(10) THEN 1", "WHEN a.m = 1 THEN 2"]
    for code, found in ((10, line), (20, [p[0] for p in block]), (30, [x[0] for x in strings])):
        events += [f"WHEN a.m = 0 AND {at(t)} THEN {code + i}" for i, t in enumerate(found)]
        size |= {code + i: len(t) for i, t in enumerate(found)}
    events += ["WHEN a.m = 0 AND trim(x.t, ' ' || chr(9) || chr(13)) = '' THEN 2", "WHEN a.m = 0 THEN 3"]
    for i, (_, end) in enumerate(block):
        events += [f"WHEN a.m = {100 + i} AND {at(t)} THEN {40 + j}" for j, (t, _) in enumerate(block)] + [f"WHEN a.m = {100 + i} AND {at(end)} THEN {50 + i}"]
        size |= {40 + i: len(block[i][0]), 50 + i: len(end)}
    events += ["WHEN a.m BETWEEN 100 AND 199 THEN 60", "WHEN a.e THEN 70", "WHEN x.t = chr(92) THEN 71"]
    for i, (_, end, _) in enumerate(strings):
        events.append(f"WHEN a.m = {200 + i} AND {at(end)} THEN {80 + i}")
        size[80 + i] = len(end)
    short = " OR ".join(["a.m = 1", *(f"a.m = {200 + i}" for i, x in enumerate(strings) if not x[2])])
    of = lambda pairs, other: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"
    mode = of([("v = 1", f"CASE WHEN {short} THEN 0 ELSE a.m END"), ("v BETWEEN 10 AND 19", "1"), ("v BETWEEN 20 AND 29", "v + 80"), ("v BETWEEN 30 AND 39", "v + 170"), ("v BETWEEN 50 AND 59 AND a.d = 1", "0"), ("v BETWEEN 80 AND 89", "0")], "a.m")
    state = {
        "m": mode, "d": of([("v BETWEEN 20 AND 29", "1"), ("v BETWEEN 40 AND 49", "a.d + 1"), ("v BETWEEN 50 AND 59", "a.d - 1")], "a.d"),
        "k": of([("v = 0", "a.k - 1"), *((f"v = {c}", n - 1) for c, n in size.items())], "0"), "e": of([("v = 71", "true"), ("v = 0", "a.e"), ("v = 1", f"a.e AND NOT ({short})")], "false"),
        "has": of([("v = 1", "false"), ("v = 3 OR v BETWEEN 30 AND 39 OR v >= 70", "true")], "a.has"), "filled": of([("v = 1", "false"), ("v IN (0, 2)", "a.filled")], "true"),
        "code": "a.code + CAST(v = 1 AND a.has AS BIGINT)", "comment": "a.comment + CAST(v = 1 AND a.filled AND NOT a.has AS BIGINT)", "blank": "a.blank + CAST(v = 1 AND NOT a.filled AS BIGINT)",
    }
    fold = f"list_transform([CASE {' '.join(events)} ELSE 73 END], lambda v: {{{', '.join(f'{n!r}: {x}' for n, x in state.items())}}})[1]"
    begin = "{'m': 0, 'd': 0, 'k': 0, 'e': false, 'has': false, 'filled': false, 'code': 0::BIGINT, 'comment': 0::BIGINT, 'blank': 0::BIGINT}"
    longest = max(map(len, tokens)) - 1
    return f"""
SELECT path, code + comment + blank AS total_lines, code AS code_lines, comment AS comment_lines, blank AS blank_lines FROM (
  SELECT path, a.code + CAST(a.has AS BIGINT) AS code, a.comment + CAST(a.filled AND NOT a.has AS BIGINT) AS comment, a.blank AS blank FROM (
    SELECT path, list_reduce(pieces, lambda a, x: {fold}, {begin}) AS a FROM (
      SELECT path, list_transform(l, lambda t, i: {{'t': t, 'u': array_to_string(l[i:i + {longest}], '')}}) AS pieces
      FROM (SELECT path, regexp_extract_all(text, {_q(f'[ \\t\\r]+|[{signs}]|[^ \\t\\r{signs}]+')}) AS l FROM ({source}))
    )
  )
)"""


_FILE_STATS = " UNION ALL ".join(
    f"SELECT f.path, '{key}' AS language, CAST(strlen(f.text) AS BIGINT) AS file_size, {', '.join(f'coalesce(s.{c}, 0) AS {c}' for c in ('total_lines', 'code_lines', 'comment_lines', 'blank_lines'))} "
    f"FROM (SELECT * FROM ({_CORPUS}) WHERE path LIKE '%.{ext}') f LEFT JOIN ({lexer_sql(f'SELECT * FROM ({_CORPUS}) WHERE path LIKE {_q("%." + ext)}', REGISTRY.specs[key])}) s USING (path)"
    for ext, key in _BY_EXTENSION
)
_ORDINALS = "(VALUES " + ", ".join(f"({i}, '{x.key}', {_q(x.name)})" for i, x in enumerate(REGISTRY.languages, 1)) + ") AS o(ordinal, language, name)"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {m}" for c, m in (("total_lines", "lines"), ("code_lines", "code"), ("comment_lines", "comments"), ("blank_lines", "blanks"), ("file_size", "bytes")))
_LANGUAGE_STATS = f"SELECT language, name, ordinal, count(*) AS files, {_SUMS} FROM ({_FILE_STATS}) JOIN {_ORDINALS} USING (language) GROUP BY language, name, ordinal"
_SHOWN = ["language", "name", *METRICS]


def language_totals(spark, sf: str) -> DataFrame:
    return language_stats(file_stats(corpus(spark, sf), REGISTRY), REGISTRY)


def _ranked(spark, sf: str, sort: str, top: int = 0) -> DataFrame:
    out = ranked(language_totals(spark, sf), sort, top)
    place = F.row_number().over(Window.orderBy(F.desc(sort), "ordinal"))  # a row a language of the registry at most
    return out.withColumn("place", place.cast("long")).select(*_SHOWN, "place")


def _ranked_sql(sort: str, top: int = 0) -> str:
    return f"SELECT {', '.join(_SHOWN)}, row_number() OVER (ORDER BY {sort} DESC, ordinal) AS place FROM ({_LANGUAGE_STATS}) ORDER BY place" + (f" LIMIT {top}" if top else "")


def _lexed(spark, sf: str, key: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    docs = docs.select(F.col("doc_id").cast("string").alias("path"), F.encode(_put(F.col("text")), "UTF-8").alias("content"))
    out = docs.select("path", lex(F.col("content"), F.lit(key), REGISTRY.specs).alias("l"))
    return out.select("path", F.col("l.total").alias("total_lines"), F.col("l.code").alias("code_lines"), F.col("l.comments").alias("comment_lines"), F.col("l.blanks").alias("blank_lines"))


def _lexed_sql(key: str) -> str:
    docs = f"SELECT CAST(doc_id AS VARCHAR) AS path, {_put_sql('text')} AS text FROM documents"
    spec = REGISTRY.specs[key]
    if spec.nested:
        return nested_lexer_sql(docs, spec)
    return f"SELECT d.path, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('total_lines', 'code_lines', 'comment_lines', 'blank_lines'))} FROM ({docs}) d LEFT JOIN ({lexer_sql(docs, spec)}) s USING (path)"


def detected(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat_ws("/", "source", _pick("doc_id", _NAMES)).alias("path"))
    return detect(docs, REGISTRY, keep_unknown=True).select("doc_id", "path", F.coalesce("language", F.lit("Unknown")).alias("language"))


_DETECTED = ["Cpp", "CMake", "Makefile", "Makefile", "Unknown", "Python", "Unknown", "Markdown", "Python", "Unknown", "Rust"]


def name_parts(spark, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    base = names.basename(F.col("url"))
    return pages.select("page_id", base.alias("base"), names.extension(base).alias("ext"), names.ascii_lower(base).alias("lowered"))


_NAME_PARTS = """
SELECT page_id, base, CASE WHEN contains(base, '.') AND NOT ends_with(base, '.') THEN regexp_extract(base, '\\.([^.]*)$', 1) END AS ext,
       translate(base, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages)"""


def every_extension(spark, sf: str) -> DataFrame:
    """Every extension and file name of the registry in other letters, in turn behind the documents' numbers."""
    given = sorted(REGISTRY.by_extension) + sorted(REGISTRY.by_filename) + ["", "unknown"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    word = _pick("doc_id", given)
    path = F.when(F.pmod("doc_id", F.lit(len(given))) < len(REGISTRY.by_extension), F.concat(F.lit("a.b/"), "doc_id", F.lit("."), F.initcap(word))).otherwise(F.concat(F.lit("d/"), F.upper(word)))
    return detect(docs.select("doc_id", path.alias("path")), REGISTRY, keep_unknown=True).select("doc_id", "path", F.coalesce("language", F.lit("Unknown")).alias("language"))


def _every_extension_sql() -> str:
    given = [(f"a.b/%d.{e.capitalize()}", k) for e, k in sorted(REGISTRY.by_extension.items())]
    given += [(f"d/{e.upper()}", k) for e, k in sorted(REGISTRY.by_filename.items())] + [("d/", "Unknown"), ("d/UNKNOWN", "Unknown")]
    rows = ", ".join(f"({i}, {_q(path)}, {_q(k)})" for i, (path, k) in enumerate(given))
    return f"SELECT doc_id, replace(shown, '%d', CAST(doc_id AS VARCHAR)) AS path, language FROM documents JOIN (VALUES {rows}) AS v(i, shown, language) ON doc_id % {len(given)} = i"


def path_parts(spark, sf: str) -> DataFrame:
    """A path from its parent and name, and back to what is below the parent."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    parent = F.when(F.col("page_id") % 7 == 0, "/").otherwise(F.concat("url", F.when(F.col("page_id") % 3 == 0, F.lit("/")).otherwise(F.lit(""))))
    child = names.child_path(parent, F.col("page_id").cast("string"))
    bare = F.when(parent == "/", "").otherwise(F.regexp_replace(parent, "/+$", ""))
    return pages.select("page_id", child.alias("child"), names.relative_path(child, bare).alias("below"))


_PATH_PARTS = """
SELECT page_id, child, CASE WHEN page_id % 7 = 0 THEN child ELSE CAST(page_id AS VARCHAR) END AS below
FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '/' || page_id ELSE regexp_replace(url, '/+$', '') || '/' || page_id END AS child FROM pages)"""


# A tree of documents on disk: a hidden directory, ignored files and directories, unknown extensions, a root that is a file, and a root given twice.
_TREE_RULES = {"": "*1.py\n!*21.py\nsrc3/\n", "en": "!*31.py\n/src4/*.c\n"}
_TREE_EXTENSIONS = ["py", "c", "zzz", "md"]


def _written(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(content)
        yield b.select([0])


def _tree_on_disk(spark, sf: str) -> str:
    """Documents as files, in the folder that the session shares; its path."""
    named = (spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")).removeprefix("file://")
    if not named and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = f"{named or tempfile.gettempdir()}/linemill-tree-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{root}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text")
    lang = F.when(F.col("lang") == "fr", ".fr").otherwise(F.col("lang"))
    path = F.concat_ws("/", F.lit(root), lang, "source", F.concat("doc_id", F.lit("."), _pick("doc_id", _TREE_EXTENSIONS)))
    files = docs.select(path.alias("path"), F.encode(_put(F.col("text")), "UTF-8").alias("content"))
    files.mapInArrow(_written, "path string").agg(F.count("path")).collect()
    for directory, rules in _TREE_RULES.items():
        os.makedirs(f"{root}/{directory}", exist_ok=True)
        with open(f"{root}/{directory}/.gitignore", "w", encoding="utf-8") as f:
            f.write(rules)
    with open(f"{root}/alone.py", "w", encoding="utf-8") as f:
        f.write("# alone\nx = 1\n")
    return root


def tree_files(spark, sf: str) -> DataFrame:
    """The files that a walk visits, with their languages and lines."""
    root = _tree_on_disk(spark, sf)
    found = read_tree(spark, [root, f"{root}/alone.py", f"{root}/.fr", f"{root}/none.bin"])
    stats = file_stats(found.select(F.concat("rel", F.when(F.col("is_explicit"), "!").otherwise(F.lit(""))).alias("shown"), "path", "content"), REGISTRY, keep=("shown",))
    return stats.select(F.col("shown").alias("rel"), "language", "file_size", "total_lines", "code_lines", "comment_lines", "blank_lines")


_ON_DISK = f"""SELECT doc_id, lang, source, {_pick_sql('doc_id', _TREE_EXTENSIONS)} AS ext, {_put_sql('text')} AS text FROM documents"""
_VISITED = f"""
SELECT CASE WHEN lang = 'fr' THEN '' ELSE lang || '/' END || source || '/' || doc_id || '.' || ext AS rel, CAST(doc_id AS VARCHAR) AS path, ext, text FROM ({_ON_DISK})
WHERE ext <> 'zzz' AND (lang = 'fr' OR (source <> 'src3'
  AND NOT (ext = 'py' AND doc_id % 10 = 1 AND NOT doc_id % 100 = 21 AND NOT (lang = 'en' AND doc_id % 100 = 31))
  AND NOT (lang = 'en' AND source = 'src4' AND ext = 'c')))"""
_TREE_LANGUAGES = [("py", "Python"), ("c", "C"), ("md", "Markdown")]
_COUNTS = ("total_lines", "code_lines", "comment_lines", "blank_lines")
_TREE_FILES = " UNION ALL ".join(
    f"SELECT f.rel, '{key}' AS language, CAST(strlen(f.text) AS BIGINT) AS file_size, {', '.join(f'coalesce(s.{c}, 0) AS {c}' for c in _COUNTS)} "
    f"FROM (SELECT * FROM ({_VISITED}) WHERE ext = '{ext}') f LEFT JOIN ({lexer_sql(f'SELECT path, text FROM ({_VISITED}) WHERE ext = {_q(ext)}', REGISTRY.specs[key])}) s USING (path)"
    for ext, key in _TREE_LANGUAGES
) + " UNION ALL SELECT rel, 'Python', 14, 2, 1, 1, 0 FROM (VALUES ('alone.py'), ('alone.py!')) AS v(rel)"


def tree_languages(spark, sf: str) -> DataFrame:
    root = _tree_on_disk(spark, sf)
    return language_stats(file_stats(read_tree(spark, [root, root, f"{root}/alone.py"], hidden=True, gitignore=False), REGISTRY), REGISTRY).select(*_SHOWN)


_TREE_ALL = " UNION ALL ".join(
    f"SELECT '{key}' AS language, f.path, CAST(strlen(f.text) AS BIGINT) AS file_size, {', '.join(f'coalesce(s.{c}, 0) AS {c}' for c in _COUNTS)} "
    f"FROM (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM ({_ON_DISK}) WHERE ext = '{ext}') f LEFT JOIN ({lexer_sql(f'SELECT CAST(doc_id AS VARCHAR) AS path, text FROM ({_ON_DISK}) WHERE ext = {_q(ext)}', REGISTRY.specs[key])}) s USING (path)"
    for ext, key in _TREE_LANGUAGES
)
_TREE_TOTALS = f"""SELECT language, name, count(*) AS files, {_SUMS} FROM (
  SELECT * FROM ({_TREE_ALL}) UNION ALL SELECT * FROM ({_TREE_ALL}) UNION ALL SELECT 'Python', '', 14, 2, 1, 1, 0 FROM range(3)
) JOIN {_ORDINALS} USING (language) GROUP BY language, name"""


def grand_totals(spark, sf: str) -> DataFrame:
    return totals(ranked(language_totals(spark, sf), "lines", 3))


def csv_report(spark, sf: str) -> DataFrame:
    rows = ranked(language_totals(spark, sf), "lines")
    cells = lambda name: F.concat_ws(",", name, *METRICS[:5]).alias("line")
    head = spark.range(1).select(F.lit(CSV_HEADER).alias("line"))
    return head.unionByName(rows.select(cells("name"))).unionByName(totals(rows).select(cells(F.lit("Total"))))


_CSV = f"""WITH s AS ({_LANGUAGE_STATS})
SELECT '{CSV_HEADER}' AS line UNION ALL SELECT concat_ws(',', name, files, lines, code, comments, blanks) FROM s
UNION ALL SELECT concat_ws(',', 'Total', CAST(sum(files) AS BIGINT), CAST(sum(lines) AS BIGINT), CAST(sum(code) AS BIGINT), CAST(sum(comments) AS BIGINT), CAST(sum(blanks) AS BIGINT)) FROM s"""


def union_of_roots(spark, sf: str) -> DataFrame:
    """A tree given twice counts twice."""
    files = corpus(spark, sf)
    both = language_stats(file_stats(files.unionByName(files.filter("path like 'pages/%'")), REGISTRY), REGISTRY)
    return both.select(*_SHOWN)


_UNION = f"SELECT {', '.join(_SHOWN)} FROM (SELECT language, name, ordinal, count(*) AS files, {_SUMS} FROM (SELECT * FROM ({_FILE_STATS}) UNION ALL SELECT * FROM ({_FILE_STATS}) WHERE path LIKE 'pages/%') JOIN {_ORDINALS} USING (language) GROUP BY language, name, ordinal)"


def _tree(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.when(F.col("lang") == "fr", ".").otherwise(""), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".py")).alias("rel"))


_TREE = "SELECT CASE WHEN lang = 'fr' THEN '.' ELSE '' END || lang || '/' || source || '/' || doc_id || '.py' AS rel FROM documents"
# Each ignore query: the files, and the same rules as (dir, depth, line, expression, negated, directories only, anchored).
_IGNORES = {
    "ignore_last_match": ({"": "*1.py\n!*21.py\n121.py\n"}, [("", 0, 0, "^[^/]*1\\.py$", False, False, False), ("", 0, 1, "^[^/]*21\\.py$", True, False, False), ("", 0, 2, "^121\\.py$", False, False, False)]),
    "ignore_dir_only": ({"": "src1/\n7.py/\n"}, [("", 0, 0, "^src1$", False, True, False), ("", 0, 1, "^7\\.py$", False, True, False)]),
    "ignore_anchored": ({"": "/en/src2\nde/*/1*.py\nsrc3/2.py\n"}, [("", 0, 0, "^en/src2$", False, False, True), ("", 0, 1, "^de/[^/]*/1[^/]*\\.py$", False, False, True), ("", 0, 2, "^src3/2\\.py$", False, False, True)]),
    "ignore_nested_override": ({"": "*5.py\n", "en": "!15.py\n!src4/*5.py\n", "en/src5": "*\n"}, [("", 0, 0, "^[^/]*5\\.py$", False, False, False), ("en", 1, 0, "^15\\.py$", True, False, False), ("en", 1, 1, "^src4/[^/]*5\\.py$", True, False, True), ("en/src5", 2, 0, "^[^/]*$", False, False, False)]),
    "glob_class": ({"": "[1-3]?[!5-9].py\n*[04].py\n"}, [("", 0, 0, "^[1-3][^/][^5-9/]\\.py$", False, False, False), ("", 0, 1, "^[^/]*[04]\\.py$", False, False, False)]),
    "glob_double_star": ({"": "**/src6/**\nen/**1.py\n"}, [("", 0, 0, "^.*/src6/.*$", False, False, True), ("", 0, 1, "^en/.*1\\.py$", False, False, True)]),
}


def _kept(spark, sf: str, files: dict[str, str]) -> DataFrame:
    return pruning.prune(_tree(spark, sf), pruning.rule_rows(spark, files)).select("rel")


def _kept_sql(rules: list[tuple]) -> str:
    values = ", ".join(f"({_q(d)}, {depth}, {n}, {_q(x)}, {str(neg).lower()}, {str(only).lower()}, {str(anch).lower()})" for d, depth, n, x, neg, only, anch in rules)
    return f"""
WITH f AS ({_TREE}), r(dir, depth, line_no, regex, negated, dir_only, anchored) AS (VALUES {values}),
e AS (SELECT rel, false AS is_dir FROM f UNION SELECT regexp_extract(rel, '^[^/]*'), true FROM f UNION SELECT regexp_extract(rel, '^[^/]*/[^/]*'), true FROM f),
i AS (
  SELECT rel, is_dir FROM e JOIN r ON (dir = '' OR starts_with(rel, dir || '/')) AND (NOT dir_only OR is_dir)
   AND regexp_matches(CASE WHEN anchored THEN substr(rel, CASE WHEN dir = '' THEN 1 ELSE length(dir) + 2 END) ELSE regexp_extract(rel, '[^/]*$') END, regex)
  GROUP BY rel, is_dir HAVING NOT arg_max(negated, depth * 1000 + line_no)
)
SELECT rel FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE NOT is_dir AND i.rel = f.rel)
  AND NOT EXISTS (SELECT 1 FROM i WHERE is_dir AND starts_with(f.rel, i.rel || '/'))"""


def visible(spark, sf: str) -> DataFrame:
    return _tree(spark, sf).filter(~pruning.hidden(F.col("rel")))


def _shown(spark, sf: str, unit) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", unit.alias("shown"))


_AMOUNT = "CAST(floor(pow(7.0, (l_orderkey + l_linenumber) % 16)) AS DOUBLE)"


def _amount():
    return F.floor(F.pow(F.lit(7.0), F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(16)))).cast("double")


def _units_sql(value: str, steps: list[tuple[str, float, str]], rest: tuple[float, str]) -> str:
    case = " ".join(f"WHEN v < {bound} THEN printf('%.2f{unit}', v / {size:.20f})" for bound, size, unit in steps)
    return f"SELECT l_orderkey, l_linenumber, CASE {case} ELSE printf('%.2f{rest[1]}', v / {rest[0]:.20f}) END AS shown FROM (SELECT l_orderkey, l_linenumber, {value} AS v FROM lineitem)"


def nested_comments(spark, sf: str) -> DataFrame:
    return _lexed(spark, sf, "Rust")


_LEXED = {"lex_line_comment": "Makefile", "lex_block_comment": "Html", "lex_string": "C", "lex_multiline_string": "Python", "lex_raw_string": "Go", "lex_shared_prefix": "Lua", "lex_sql": "Sql", "lex_two_line_tokens": "Php", "blank_lines": "Text"}


def line_total(spark, sf: str) -> DataFrame:
    """All lines of a text, without a lexer: newlines, and a last line that is not blank."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", _put(F.col("text")).alias("t"))
    return docs.select("doc_id", (F.length("t") - F.length(F.replace("t", F.lit("\n"))) + F.rlike("t", F.lit(r"[^ \t\r\n][^\n]*\z")).cast("int")).cast("long").alias("lines"))


QUERIES = {
    "detect_language": detected,
    "basename_ext": name_parts,
    "every_extension": every_extension,
    "path_parts": path_parts,
    "tree_files": tree_files,
    "tree_languages": tree_languages,
    "line_total": line_total,
    "lex_nested_comment": nested_comments,
    **{name: partial(_lexed, key=key) for name, key in _LEXED.items()},
    "file_stats": lambda spark, sf: file_stats(corpus(spark, sf), REGISTRY),
    "language_stats": lambda spark, sf: language_totals(spark, sf).select(*_SHOWN),
    **{f"sort_{m}": partial(_ranked, sort=m) for m in ("files", "lines", "code", "comments", "blanks")},
    "top_n": partial(_ranked, sort="lines", top=3),
    "totals_after_top_n": grand_totals,
    "union_roots": union_of_roots,
    "hidden_filter": visible,
    **{name: partial(_kept, files=files) for name, (files, _) in _IGNORES.items()},
    "format_count": lambda spark, sf: _shown(spark, sf, names.format_count(_amount())),
    "format_bytes": lambda spark, sf: _shown(spark, sf, names.format_bytes(_amount())),
    "format_time": lambda spark, sf: _shown(spark, sf, names.format_time(_amount() / F.lit(1e6))),
    "csv_report": csv_report,
}

SQL = {
    "detect_language": f"SELECT doc_id, source || '/' || {_pick_sql('doc_id', _NAMES)} AS path, {_pick_sql('doc_id', _DETECTED)} AS language FROM documents",
    "basename_ext": _NAME_PARTS,
    "every_extension": _every_extension_sql(),
    "path_parts": _PATH_PARTS,
    "tree_files": _TREE_FILES,
    "tree_languages": _TREE_TOTALS,
    "line_total": f"SELECT doc_id, CAST(length(t) - length(replace(t, chr(10), '')) + CAST(regexp_matches(t, '[^ \\t\\r\\n][^\\n]*\\z') AS INT) AS BIGINT) AS lines FROM (SELECT doc_id, {_put_sql('text')} AS t FROM documents)",
    "lex_nested_comment": _lexed_sql("Rust"),
    **{name: _lexed_sql(key) for name, key in _LEXED.items()},
    "file_stats": _FILE_STATS,
    "language_stats": f"SELECT {', '.join(_SHOWN)} FROM ({_LANGUAGE_STATS})",
    **{f"sort_{m}": _ranked_sql(m) for m in ("files", "lines", "code", "comments", "blanks")},
    "top_n": _ranked_sql("lines", 3),
    "totals_after_top_n": f"SELECT {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in METRICS)} FROM ({_ranked_sql('lines', 3)})",
    "union_roots": _UNION,
    "hidden_filter": f"SELECT rel FROM ({_TREE}) WHERE NOT regexp_matches(rel, '(^|/)\\.')",
    **{name: _kept_sql(rules) for name, (_, rules) in _IGNORES.items()},
    "format_count": _units_sql(_AMOUNT, [("1e3", 1, ""), ("1e6", 1e3, "K"), ("1e9", 1e6, "M")], (1e9, "B")),
    "format_bytes": _units_sql(_AMOUNT, [("1024", 1, " B"), ("1048576", 2**10, " KiB"), ("1073741824", 2**20, " MiB"), ("1099511627776", 2**30, " GiB")], (2**40, " TiB")),
    "format_time": _units_sql(f"{_AMOUNT} / 1e6", [("1e-3", 1e-6, "ns"), ("1", 1e-3, "µs"), ("1e3", 1, "ms")], (1e3, "s")),
    "csv_report": _CSV,
}
