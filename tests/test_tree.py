import json
import os
import re

import pytest

from linemill.functions import names
from linemill.operators.detect import detect
from linemill.operators.stats import file_stats, language_stats, per_file, ranked
from linemill.plans import report
from linemill.functions.lexer import lex_bytes
from linemill.sources.registry import LANGUAGES, Registry
from linemill.sources.tree import SourceTree, read_tree
from linemill.streaming.totals import running_totals


def make(root, files):
    for rel, text in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def visited(spark, root, **options):
    return {r.rel for r in read_tree(spark, [root], **options).collect()}


# Trees, options and the files that a walk visits.
TREES = [
    ({"main.cpp": "", "notes.bin": ""}, {"gitignore": False}, {"main.cpp"}),
    ({"a/b/c/deep.cpp": ""}, {}, {"a/b/c/deep.cpp"}),
    ({".hidden.cpp": "", ".hidden_dir/visible.cpp": "", "visible.cpp": "", "_x.py": ""}, {}, {"visible.cpp", "_x.py"}),
    ({".hidden.cpp": "", "visible.cpp": ""}, {"hidden": True}, {".hidden.cpp", "visible.cpp"}),
    ({".gitignore": "build/\n*.txt\n", "main.cpp": "", "notes.txt": "", "build/output.cpp": ""}, {}, {"main.cpp"}),
    ({".gitignore": "*.txt\n", "notes.txt": ""}, {"gitignore": False}, {"notes.txt"}),
    ({".gitignore": "*.txt\n", "sub/.gitignore": "!keep.txt\n", "sub/scratch.txt": "", "sub/keep.txt": ""}, {}, {"sub/keep.txt"}),
    ({f"dir{i % 5}/file{i}.cpp": "" for i in range(40)}, {"partitions": 5}, {f"dir{i % 5}/file{i}.cpp" for i in range(40)}),
]


@pytest.mark.parametrize(("files", "options", "want"), TREES)
def test_walk(spark, tmp_path, files, options, want):
    assert visited(spark, make(tmp_path, files), **options) == want


@pytest.mark.parametrize("listed", [0, 1, 2, 5])
def test_subtrees_are_walked_in_tasks(spark, tmp_path, listed):
    files = {f"d{i % 3}/e{i % 2}/f{i % 4}/x{i}.py": "a\n" for i in range(40)} | {"d1/.gitignore": "e1/f1/\n!x7.py\n*.c\n", "d1/e1/f3/z.c": "", "d0/z.c": "", "top.py": ""}
    root = make(tmp_path, files)
    want = {f for f in files if f.endswith((".py", ".c")) and not f.startswith("d1/e1/f1/") and f != "d1/e1/f3/z.c"}
    assert visited(spark, root, listed=listed) == want
    spark.dataSource.register(SourceTree)
    plain = spark.read.format("sourcetree").option("listed", listed).load(root)
    assert {r.rel: bytes(r.content) for r in plain.collect()} == {f: files[f].encode() for f in want}


def test_names_and_ignore_files_that_are_not_utf8(spark, tmp_path):
    root = os.fsencode(str(tmp_path))
    names = [b"caf\xe9.py", b"\xff\xfe.c", b"kept\xe8.py", b"gone\xe8.py", "\u00e9.py".encode()]
    for n in names:
        with open(root + b"/" + n, "wb") as f:
            f.write(b"x\n")
    os.mkdir(root + b"/dir\xf0")
    for n in (b"a.py", b"b.py"):
        with open(root + b"/dir\xf0/" + n, "wb") as f:
            f.write(b"y\n")
    with open(root + b"/.gitignore", "wb") as f:
        f.write(b"gone\xe8.py\n/dir\xf0/b.py\n")
    for listed in (0, 1, 3):
        rows = read_tree(spark, [str(tmp_path)], listed=listed).collect()
        assert {bytes(r.path_bytes)[len(root) + 1 :] for r in rows} == {*names[:3], names[4], b"dir\xf0/a.py"}
        assert {r.rel for r in rows} == {"caf\ufffd.py", "\ufffd\ufffd.c", "kept\ufffd.py", "\u00e9.py", "dir\ufffd/a.py"}
    assert language_stats(file_stats(read_tree(spark, [str(tmp_path)]))).groupBy().sum("files").first()[0] == 5


def test_files_that_are_too_long_fail_by_name(spark, tmp_path):
    root = make(tmp_path, {"a.py": "x" * 100})
    with pytest.raises(Exception, match="more than 50 bytes"):
        read_tree(spark, [root], longest=50).collect()


def test_links_are_not_followed(spark, tmp_path):
    root = make(tmp_path, {"real/a.py": "x\n"})
    (tmp_path / "link").symlink_to(tmp_path / "real")
    (tmp_path / "b.py").symlink_to(tmp_path / "real/a.py")
    assert visited(spark, root) == {"real/a.py"}


def test_roots_count_as_given(spark, tmp_path):
    root = make(tmp_path, {".hid/a.py": "# c\nx = 1\n", "b.py": "y = 1\n"})
    rows = read_tree(spark, [root, root, f"{root}/.hid/a.py", f"{root}/none.py", f"{root}/none.bin"])
    got = language_stats(file_stats(rows)).first()
    assert (got.language, got.files, got.lines, got.code, got.comments, got.blanks, got.bytes) == ("Python", 4, 4, 3, 1, 0, 22)


def test_detection(spark):
    want = {"main.cpp": "Cpp", "main.py": "Python", "src/lib.rs": "Rust", "Main.CPP": "Cpp", "SCRIPT.PY": "Python", "Makefile": "Makefile", "path/to/makefile": "Makefile", "CMakeLists.txt": "CMake", "data.bin": None, "no_extension": None, "": None, ".py": "Python", "x.": None}
    got = detect(spark.createDataFrame([(p,) for p in want], "path string"), keep_unknown=True).collect()
    assert {r.path: r.language for r in got} == want == {p: Registry().detect(p) for p in want}


def test_hidden_walks_version_control_folders_too(spark, tmp_path):
    root = make(tmp_path, {".git/hooks/a.py": "", "b.py": ""})
    assert visited(spark, root, hidden=True) == {".git/hooks/a.py", "b.py"} and visited(spark, root) == {"b.py"}


def test_registry_from_a_file_and_from_a_table(spark, tmp_path):
    given = {"languages": {"Zed": {"name": "Zed!", "extensions": ["zed"], "filenames": ["Zedfile"], "line_comment": ["%%"], "multi_line_comments": [["<#", "#>"]], "quotes": [["'", "'"]], "verbatim_quotes": [["|", "|"]], "nested": True}, "Plain": {"extensions": ["pl1"]}}}
    path = tmp_path / "languages.json"
    path.write_text(json.dumps(given))
    own = Registry.from_json(str(path))
    assert own.detect("a/ZEDFILE") == own.detect("x.Zed") == "Zed" and own.names == {"Zed": "Zed!", "Plain": "Plain"}
    assert lex_bytes(own.specs["Zed"], b"%% a\n<# <# #>\n#> x\n'\n") == (4, 2, 2, 0)
    rows = [(k, v.get("name"), v["extensions"], v.get("line_comment"), i) for i, (k, v) in enumerate(given["languages"].items())]
    table = Registry.from_frame(spark.createDataFrame(rows, "key string, name string, extensions array<string>, line_comment array<string>, ordinal int"))
    assert [x.key for x in table.languages] == ["Zed", "Plain"] and table.specs["Zed"].line == ("%%",)
    root = make(tmp_path / "t", {"a.zed": "%% c\nx\n", "b.py": "x\n"})
    assert report.main([root, "-f", "csv", "-o", str(tmp_path / "out.csv"), "--languages", str(path)]) == 0
    assert (tmp_path / "out.csv").read_text().splitlines()[1:] == ["Zed!,1,2,1,1,0", "Total,1,2,1,1,0"]


def test_registries_with_one_extension_or_key_twice_are_refused():
    one = {"key": "A", "extensions": ["x"]}
    for other in ({"key": "B", "extensions": ["X"]}, {"key": "A", "extensions": ["y"]}):
        with pytest.raises(ValueError):
            Registry.from_rows([one, other])
    names = [x.name for x in LANGUAGES]
    assert len(LANGUAGES) == 138 == len(set(names)) == len({x.key for x in LANGUAGES})


def test_running_totals_over_a_stream(spark, tmp_path):
    schema = "path string, content binary"
    for i, rows in enumerate([[("a.py", b"x\n# c\n")], [("b.py", b"y\n"), ("c.c", b"int x;\n")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append" if i else "error")
    totals = running_totals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = totals.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.language, r.files, r.lines, r.code, r.comments) for r in spark.table("running").collect()} == {("Python", 2, 3, 2, 1), ("C", 1, 1, 1, 0)}


ROWS = [dict(zip(("name", "files", "lines", "code", "comments", "blanks", "bytes"), r, strict=True)) for r in [("C++ Header", 13, 1579, 1301, 4, 274, 100_000), ("C++", 7, 1556, 1294, 17, 245, 8_000), ("Python", 1, 254, 177, 6, 71, 652)]]


def test_reports():
    lines = report.as_csv(ROWS).splitlines()
    assert lines[0] == "Language,Files,Total Lines,Code Lines,Comment Lines,Blank Lines"
    assert lines[3:] == ["Python,1,254,177,6,71", "Total,21,3389,2772,27,590"]
    assert report.as_csv(ROWS[:2]).splitlines()[-1] == "Total,20,3135,2595,21,519"
    text = report.as_text(ROWS, 0.68171).splitlines()
    assert "681.71µs" in text[0] and "30.80K files/s" in text[0] and "4.97M lines/s" in text[0] and "152.00 MiB/s" in text[0]
    assert text[-1] == "Total size: 108,652 bytes (106.11 KiB)"
    assert len(set(map(len, (text[1], text[3])))) == 1
    assert names.shown(999, names.COUNTS) == "999.00" and names.shown(1500, names.COUNTS) == "1.50K"


def test_colours_are_around_the_same_text():
    plain, painted = report.as_text(ROWS, 5.0), report.as_text(ROWS, 5.0, colour=True)
    assert plain != painted and re.sub(r"\x1b\[[0-9;]*m", "", painted) == plain


def test_own_function_per_file(spark, tmp_path):
    root = make(tmp_path, {"a.py": "x\ny\n", "b.c": ""})
    got = per_file(read_tree(spark, [root]), lambda path, content: {"name": path.rpartition("/")[2], "n": content.count(b"\n")}, "name string, n long")
    assert sorted(map(tuple, got.collect())) == [("a.py", 2), ("b.c", 0)]


def test_command_line(tmp_path, capsys, spark):
    root = make(tmp_path / "t", {"a.py": "x = 1\n", "b.c": "int x;\nint y;\n"})
    assert report.main([root, "-f", "csv", "-s", "code", "-n", "1"]) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ["C,1,2,2,0,0", "Total,1,2,2,0,0"]
    make(tmp_path / "t", {".gitignore": "b.c\n", ".h.py": "y\n"})
    assert report.main([root, "-f", "csv", "-i", "-g", "-t", "2"]) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ["C,1,2,2,0,0", "Python,2,2,2,0,0", "Total,3,4,4,0,0"]
    assert report.main(["--version"]) == 0 and report.main(["--sort", "none"]) == 1
    assert report.main([root, "-o", str(tmp_path / "no/such/dir")]) == 1


def test_plans(spark, tmp_path):
    root = make(tmp_path, {"a.py": "x\n"})
    plan = ranked(language_stats(file_stats(read_tree(spark, [root]))), "lines", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("BroadcastHashJoin") == 3 and plan.count("Exchange hashpartitioning") == 1
