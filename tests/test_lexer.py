import random

import pytest

from linemill.functions.lexer import Spec, lex, lex_bytes, lines_by_expressions
from linemill.sources.registry import Registry

Q = (('"', '"'),)
C = Spec(line=("//",), block=(("/*", "*/"),), quotes=Q)
N = Spec(line=("//",), block=(("/*", "*/"),), quotes=Q, nested=True)
D = Spec(line=("--",), block=(("--[[", "]]"),), quotes=Q)
V = Spec(line=("//",), quotes=Q, multiline=(('"""', '"""'),))
GOLDENS = [
    (C, "", 0, 0, 0, 0), (C, "int x;\n", 1, 1, 0, 0), (C, "int x;", 1, 1, 0, 0), (C, "int x;\n  ", 1, 1, 0, 0), (C, "\n \t\r\n", 2, 0, 0, 2),
    (C, "// c\n", 1, 0, 1, 0), (C, "// c", 1, 0, 1, 0), (C, "int x; // c\n", 1, 1, 0, 0), (C, "/* a\n\n b */\n", 3, 0, 2, 1), (C, "/* a\n  \n*/\n", 3, 0, 3, 0),
    (C, "/* a\r\n\r\n*/", 3, 0, 3, 0), (C, "/* c */ int x;\n", 1, 1, 0, 0), (C, 's = "// not";\n', 1, 1, 0, 0), (C, 's = "a\nb";\n', 2, 2, 0, 0), (C, '"\\"\n// c\n', 2, 1, 1, 0),
    (C, "\f\n", 1, 1, 0, 0), (C, "/* open\nint x;\n", 2, 0, 2, 0), (N, "/* /* */ x */\ny\n", 2, 1, 1, 0), (C, "/* /* */ x */\ny\n", 2, 2, 0, 0), (D, "--[[ a\nb ]]\n", 2, 1, 1, 0),
    (V, 'x = """\n\n  \n"""\n', 4, 3, 0, 1), (V, '"""a\\\n\n"""\n// c\n', 4, 3, 0, 1),
]


@pytest.mark.parametrize(("spec", "text", "total", "code", "comments", "blanks"), GOLDENS)
def test_goldens(spec, text, total, code, comments, blanks):
    assert lex_bytes(spec, text.encode()) == (total, code, comments, blanks)


def test_sums_and_last_line():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["a", " ", "\n", "\t", "//", "/*", "*/", '"', '"""', "\\", "é"]) for _ in range(rng.randrange(30)))
        for spec in (C, N, D, V):
            total, *parts = lex_bytes(spec, text.encode())
            assert total == sum(parts)
            assert total - text.count("\n") in (0, 1)
            if text.endswith("\n"):
                assert lex_bytes(spec, (text + "\n").encode())[0] == total + 1


SPECS = {
    "C": C, "D": D, "V": V, "none": Spec(), "go": Spec(line=("//",), block=(("/*", "*/"),), quotes=(*Q, ("'", "'")), multiline=(("`", "`"),)),
    "lua": Spec(line=("--",), block=(("--[[", "]]"),), quotes=Q, multiline=(("[[", "]]"),)), "mark": Spec(block=(("<!--", "-->"),)), "raw": Spec(line=("#",), quotes=(("r\"", "\"r"),), multiline=(('R"(', ')"'),)),
}


def test_expressions_agree_with_the_scanner(spark):
    rng = random.Random(9)
    parts = ["a", "b c", " ", "\n", "\n\n", "\t", "\r", "\f", "//", "/*", "*/", "--", "--[[", "[[", "]]", "<!--", "-->", '"', "'", "`", '"""', 'R"(', ')"', 'r"', '"r', "#", "\\", "\\\\", "é", "\x01", "\x02", "\x03", "\x04", "\x05"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40))).encode()) for k in SPECS for _ in range(400)]
    rows += [(next(k for k, x in SPECS.items() if x == spec), text.encode()) for spec, text, *_ in GOLDENS if not spec.nested]
    rows += [(k, b"\xff\xfe\n\x80//\xe9\n") for k in SPECS]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k string, c binary")
    got = {r.i: tuple(r.l) for r in frame.select("i", lines_by_expressions(spark_col("c"), spark_col("k"), SPECS).alias("l")).collect()}
    assert {i: lex_bytes(SPECS[k], t) for i, (k, t) in enumerate(rows)} == got


def test_expressions_agree_with_the_scanner_for_every_language(spark):
    rng = random.Random(10)
    specs = {k: x for k, x in Registry().specs.items() if not x.nested}
    rows = []
    for k, x in specs.items():
        tokens = [*x.line, *(t for pair in (*x.block, *x.quotes, *x.multiline) for t in pair), "a", " ", "\n", "\n", "\t", "\\"]
        rows += [(k, "".join(rng.choice(tokens) for _ in range(rng.randrange(50))).encode()) for _ in range(40)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k string, c binary")
    got = {r.i: tuple(r.l) for r in frame.select("i", lines_by_expressions(spark_col("c"), spark_col("k"), specs).alias("l")).collect()}
    assert {i: lex_bytes(specs[k], t) for i, (k, t) in enumerate(rows)} == got


def test_letters_of_a_token_match_inside_words():
    rem = Spec(line=("REM",))
    assert lex_bytes(rem, b"REMARK\nx REMOTE\n") == (2, 1, 1, 0)


def test_very_long_texts(spark):
    n = 300_000  # well over 256 KiB, with tokens across every bound of a page
    texts = ["/*" + "x\n" * n + "*/\ny\n", '"' + "\\a" * n + '"\n// c', "int x; // c\n" * n, "a" * (256 * 1024 - 1) + "/* c\n*/\n", '"""' + "\n" * n + '"""']
    for key in ("C", "V", "D"):
        frame = spark.createDataFrame([(i, key, t.encode()) for i, t in enumerate(texts)], "i long, k string, c binary")
        got = {r.i: tuple(r.l) for r in frame.select("i", lex(spark_col("c"), spark_col("k"), SPECS).alias("l")).collect()}
        assert got == {i: lex_bytes(SPECS[key], t.encode()) for i, t in enumerate(texts)}
    assert lex_bytes(C, texts[3].encode()) == (2, 1, 1, 0)


def test_no_python_for_languages_without_nesting(spark):
    frame = spark.createDataFrame([("C", b"x")], "k string, c binary")
    plan = lambda specs: frame.select(lex(spark_col("c"), spark_col("k"), specs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan({"C": C, "D": D}) and "Python" in plan({"C": C, "N": N})


def test_column(spark):
    rows = [("C", b"// a\nb\n"), ("C", None), ("none", b"x")]
    got = spark.createDataFrame(rows, "k string, c binary").select("k", lex(*map(spark_col, ("c", "k")), {"C": C}).alias("l")).collect()
    assert [r.l and tuple(r.l) for r in got] == [(2, 1, 1, 0), (0, 0, 0, 0), None]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
