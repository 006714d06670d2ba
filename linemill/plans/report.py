"""The whole query, and its text and CSV forms."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from linemill.functions import names
from linemill.functions.names import shown
from linemill.operators.stats import METRICS, SORT_KEYS, file_stats, language_stats, ranked
from linemill.sources.registry import Registry
from linemill.sources.tree import read_tree

VERSION = "1.0.0"
# Fixed value.
CSV_HEADER = "Language,Files,Total Lines,Code Lines,Comment Lines,Blank Lines"


def count_tree(spark: SparkSession, roots: list[str], *, hidden: bool = False, gitignore: bool = True, sort: str = "lines", top: int = 0, registry: Registry | None = None) -> DataFrame:
    files = read_tree(spark, roots, hidden=hidden, gitignore=gitignore, extensions=registry is None)
    return ranked(language_stats(file_stats(files, registry), registry), sort, top)


def _sums(rows: list[dict]) -> dict:
    return {m: sum(r[m] for r in rows) for m in METRICS}


def as_csv(rows: list[dict]) -> str:
    """rows: name and METRICS, in order. No quoting."""
    shown = [(r["name"], r) for r in rows] + [("Total", _sums(rows))]
    return "\n".join([CSV_HEADER, *(",".join([n, *(str(r[m]) for m in METRICS[:5])]) for n, r in shown)]) + "\n"


# Parts of the text report, and the terminal's codes for them.
_STYLES = {"title": "1;36", "dim": "2", "good": "32", "accent": "1;34", "name": "36", "code": "32", "comment": "33", "total": "1"}


def as_text(rows: list[dict], elapsed_ms: float, colour: bool = False) -> str:
    """colour: with the codes of a terminal around the parts."""
    total = _sums(rows)
    width = max([len("Language"), *(len(r["name"].encode()) for r in rows)])
    paint = lambda style, text: f"\x1b[{_STYLES[style]}m{text}\x1b[0m" if colour else text
    rule = paint("dim", "─" * (1 + width + 11 + 13 * 4 + 1))
    rate = lambda m: total[m] * 1000 / elapsed_ms if elapsed_ms else 0.0
    facts = [f"analysis: {shown(elapsed_ms, names.TIMES)}", f"{shown(rate('files'), names.COUNTS)} files/s", f"{shown(rate('lines'), names.COUNTS)} lines/s", f"{shown(rate('bytes'), names.BYTES)}/s"]
    head = paint("dim", " | ").join([paint("title", f"linemill v{VERSION}"), *(paint("good", f) for f in facts)])

    def line(name: str, cells: list, styles: tuple) -> str:
        shown_cells = [f" {name:<{width}}", f" {cells[0]:>10}", *(f" {c:>12}" for c in cells[1:])]
        return "".join(paint(x, c) if x else c for x, c in zip(styles, shown_cells, strict=True))

    body = [line(r["name"], [r[m] for m in METRICS[:5]], ("name", "", "", "code", "comment", "dim")) for r in rows]
    titles = line("Language", ["Files", "Lines", "Code", "Comments", "Blanks"], ("accent",) * 6)
    foot = paint("dim", f"Total size: {total['bytes']:,} bytes ({shown(total['bytes'], names.BYTES)})")
    return "\n".join([head, rule, titles, rule, *body, rule, line("Total", [total[m] for m in METRICS[:5]], ("total",) * 6), rule, foot]) + "\n"


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linemill", description="Count lines of code, comments and blanks by language.")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("-v", "--version", action="version", version=f"linemill v{VERSION}")
    p.add_argument("-i", "--hidden", action="store_true")
    p.add_argument("-g", "--no-gitignore", action="store_true")
    p.add_argument("-s", "--sort", choices=sorted(SORT_KEYS), default="lines")
    p.add_argument("-n", "--top", type=int, default=0)
    p.add_argument("-f", "--format", choices=["text", "csv"], default="text")
    p.add_argument("-o", "--output")
    p.add_argument("-t", "--threads", help="cores of a local session; elsewhere the session's master decides")
    p.add_argument("--languages", help="a JSON file of languages instead of the built-in ones")
    return p


def _session(threads: str | None) -> SparkSession:
    """The session that is there, or one under the master that spark-submit or Spark's configuration names, or else a local one."""
    builder = SparkSession.builder.appName("linemill").config("spark.ui.enabled", "false")
    submitted = SparkContext._active_spark_context is not None or "PYSPARK_GATEWAY_PORT" in os.environ
    return (builder.master(f"local[{threads}]") if threads and not submitted else builder).getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = _arguments()
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = _session(args.threads)
    began = time.perf_counter()
    registry = Registry.from_json(args.languages) if args.languages else None
    found = count_tree(spark, args.paths, hidden=args.hidden, gitignore=not args.no_gitignore, sort=args.sort, top=args.top, registry=registry)
    rows = [r.asDict() for r in found.collect()]  # a row a language of the registry at most
    elapsed = (time.perf_counter() - began) * 1000
    text = as_csv(rows) if args.format == "csv" else as_text(rows, elapsed, colour=not args.output and sys.stdout.isatty())
    if not args.output:
        sys.stdout.write(text)
        return 0
    try:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    except OSError as e:
        sys.stderr.write(f"Can't write {args.output}: {e.strerror}\n")
        return 1
    return 0
