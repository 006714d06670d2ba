import random

import pytest

from linemill.operators import pruning
from linemill.sources import ignore

CASES = [
    ("*.log", "debug.log", False, True), ("*.log", "readme.txt", False, False), ("build/", "build", True, True), ("build/", "build", False, False),
    ("/root_only.txt", "root_only.txt", False, True), ("/root_only.txt", "sub/root_only.txt", False, False), ("*.o", "a/b/c/foo.o", False, True),
    ("*.log\n!important.log", "important.log", False, False), ("*.log\n!important.log\nimportant.log", "important.log", False, True),
    ("vendor/**", "vendor/pkg/sub/file.c", False, True), ("vendor/**", "vendored_thing.txt", False, False),
    ("file[0-9].txt", "file3.txt", False, True), ("file[0-9].txt", "fileA.txt", False, False), ("file[!0-9].txt", "fileA.txt", False, True), ("file[!0-9].txt", "file3.txt", False, False),
    ("file?.txt", "fileA.txt", False, True), ("file?.txt", "file.txt", False, False), ("file?.txt", "fileAB.txt", False, False),
    ("/src/*.cpp", "src/main.cpp", False, True), ("/src/*.cpp", "src/nested/main.cpp", False, False), ("*.min.*.js", "app.min.abc123.js", False, True), ("*.min.*.js", "app.js", False, False),
    ("*.log", ".debug.log", False, True), ("literal\\*star.txt", "literal*star.txt", False, True), ("literal\\*star.txt", "literalXstar.txt", False, False),
    ("keep\\ me\\ \nunescaped  ", "keep me ", False, True), ("keep\\ me\\ \nunescaped  ", "keep me", False, False), ("keep\\ me\\ \nunescaped  ", "unescaped", False, True),
    ("a?c", "a/c", False, False), ("**/x", "x", False, False), ("**/x", "a/x", False, True), ("a/**/b", "a/b", False, False), ("a/**/b", "a/q/b", False, True),
    ("**a*b", "a/ab", False, True), ("/**a*b", "a/ab", False, False), ("[", "[", False, True), ("[]a].c", "].c", False, True), ("é?", "éx", False, True), ("?", "é", False, False),
]


@pytest.mark.parametrize(("rules", "path", "is_dir", "want"), CASES)
def test_rules(rules, path, is_dir, want):
    assert ignore.ignored([(".", ignore.parse(rules))], "./" + path, is_dir) == want


def test_comments_and_empty_lines():
    assert len(ignore.parse("# this is a comment\n\n*.log\r\n\n  \n!\n/\n")) == 1


@pytest.mark.parametrize("literal", [200, 0])
def test_tables_agree_with_rules(spark, monkeypatch, literal):
    monkeypatch.setattr(pruning, "LITERAL", literal)
    for rules in ("*.log\n!important.log", "vendor/**", "/**a*b", "?", "keep\\ me\\ \nunescaped  "):
        paths = sorted({c[1] for c in CASES if c[0] == rules and not c[2]})
        frame = spark.createDataFrame([(p,) for p in paths], "rel string")
        kept = {r.rel for r in pruning.prune(frame, pruning.rule_rows(spark, {"": rules})).collect()}
        assert kept == {p for p in paths if not ignore.ignored([("", ignore.parse(rules))], "/" + p, False)}


def test_plans_of_few_and_many_rules(spark, monkeypatch):
    frame = spark.range(10).selectExpr("concat('a/', id, '.c') as rel")
    rules = pruning.rule_rows(spark, {"": "*1.c\n", "a": "!1.c\n"})
    plan = lambda: pruning.prune(frame, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan() and "Join" not in plan()
    monkeypatch.setattr(pruning, "LITERAL", 0)
    many = plan()
    assert many.count("Scan ExistingRDD") == 1 and "BroadcastHashJoin [dir" in many.replace("#", " #").replace("[dir ", "[dir") and "SortMergeJoin [dir" not in many


def test_rule_lines_longer_than_a_path(spark):
    name = "x" * 5000
    assert ignore.ignored([(".", ignore.parse(f"{name}.c\n"))], f"./{name}.c", False) and len(ignore.parse(f"{name}\n")) == 1


@pytest.mark.parametrize("literal", [200, 0])
def test_child_files_override_and_pruned_directories_stay(spark, monkeypatch, literal):
    monkeypatch.setattr(pruning, "LITERAL", literal)
    rng = random.Random(1)
    files = sorted({"/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + rng.choice([".tmp", ".c"]) for _ in range(60)})
    given = {"": "*.tmp\nb/\n", "a": "!a.tmp\n!c/*.tmp\n", "b": "!*\n"}
    chain = lambda p: [(d, ignore.parse(t)) for d, t in given.items() if d == "" or p.startswith(d + "/")]

    def gone(p):
        parts = p.split("/")
        dirs = ["/".join(parts[:i]) for i in range(1, len(parts))]
        below = lambda x: [("", r) if d == "" else ("/" + d, r) for d, r in chain(x)]
        return any(ignore.ignored(below(d), "/" + d, True) for d in dirs) or ignore.ignored(below(p), "/" + p, False)

    frame = spark.createDataFrame([(p,) for p in files], "rel string")
    kept = {r.rel for r in pruning.prune(frame, pruning.rule_rows(spark, given)).collect()}
    assert kept == {p for p in files if not gone(p)}
