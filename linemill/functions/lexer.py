"""Lines of a file as code, comment or blank, by the language's tokens.

Two forms give the same counts. ``lines_by_expressions`` is a column expression:
one regular expression marks comments and strings, others shrink every line to
what tells its kind, and counting is what is left; no Python runs. Nested comments
are not regular, so languages that have them go through ``lex_bytes`` in an Arrow
UDF, which gets no content of other languages. ``lex`` is both together.

The scanner of ``lex_bytes`` jumps from token to token with one compiled expression for each
state. What lies between is judged as a whole: outside comments and strings,
anything but space, tab and carriage return is code; inside, every byte makes a
line non-blank. Code outweighs comment on a line. Line comments are tried before
block comments, those before strings; of one kind the longest token wins.
A backslash in a string takes the next byte with it, over a newline too, where
the string may span lines. A last line without newline counts if not blank.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """Tokens of a language. Pairs are (start, end); ``multiline`` strings may span lines."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    quotes: tuple[tuple[str, str], ...] = ()
    multiline: tuple[tuple[str, str], ...] = ()
    nested: bool = False
    _scanner: list = field(default_factory=list, compare=False, repr=False)

    def scanner(self) -> _Scanner:
        if not self._scanner:
            self._scanner.append(_Scanner(self))
        return self._scanner[0]


def _any(tokens: list[bytes]) -> bytes:
    return b"|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True) if t) or b"(?!)"


class _Scanner:
    def __init__(self, spec: Spec):
        self.nested = spec.nested
        self.block = {s.encode(): e.encode() for s, e in reversed(spec.block)}
        strings = [(s, e, False) for s, e in spec.quotes] + [(s, e, True) for s, e in spec.multiline]
        self.string = {s.encode(): (e.encode(), many) for s, e, many in reversed(strings)}
        line = [t.encode() for t in spec.line]
        self.plain = re.compile(b"(\n)|(%s)|(%s)|(%s)" % (_any(line), _any(list(self.block)), _any(list(self.string))))
        starts = b"|".join(re.escape(s.encode()) for s, _ in spec.block if s) if spec.nested else b"(?!)"
        self.in_block = {e: re.compile(b"(\n)|(%s)|(%s)" % (starts or b"(?!)", re.escape(e) or b"(?!)")) for e in self.block.values()}
        self.in_string = {e: re.compile(b"(\n)|(\\\\)|(%s)" % (re.escape(e) or b"(?!)")) for e, _ in self.string.values()}

    def count(self, text: bytes) -> tuple[int, int, int]:
        """Lines of code, of comment, and blank ones."""
        code = comment = blank = 0
        has_code = filled = False
        at, size = 0, len(text)
        while at < size:
            m = self.plain.search(text, at)
            stop = m.start() if m else size
            if stop > at and text[at:stop].strip(b" \t\r"):
                has_code = filled = True
            if m is None:
                break
            at = m.end()
            kind = m.lastindex
            if kind == 1:
                code, comment, blank = code + has_code, comment + (filled and not has_code), blank + (not filled)
                has_code = filled = False
            elif kind == 2:
                filled = True
                at = text.find(b"\n", at)
                if at < 0:
                    break
            elif kind == 3:
                filled = True
                end, depth = self.block[m[0]], 1
                tokens = self.in_block[end]
                while depth:
                    m = tokens.search(text, at)
                    filled = filled or (m.start() if m else size) > at
                    if m is None:
                        at = size
                        break
                    at = m.end()
                    if m.lastindex == 1:
                        code, comment, blank = code + has_code, comment + (filled and not has_code), blank + (not filled)
                        has_code = filled = False
                    else:
                        filled = True
                        depth += 1 if m.lastindex == 2 else -1
            else:
                has_code = filled = True
                end, many = self.string[m[0]]
                tokens, escaped = self.in_string[end], False
                while at < size:
                    if escaped and text[at] != 10:
                        has_code, filled, escaped = True, True, False
                        at += 1
                        continue
                    m = tokens.search(text, at)
                    if (m.start() if m else size) > at:
                        has_code = filled = True
                    if m is None:
                        at = size
                        break
                    at = m.end()
                    if m.lastindex == 1:
                        code, comment, blank = code + has_code, comment + (filled and not has_code), blank + (not filled)
                        has_code = filled = False
                        if not many:
                            break
                    else:
                        has_code = filled = True
                        if m.lastindex == 3:
                            break
                        escaped = True
        if filled:
            code, comment = code + has_code, comment + (not has_code)
        return code, comment, blank


def lex_bytes(spec: Spec, text: bytes) -> tuple[int, int, int, int]:
    """(total, code, comments, blanks)."""
    found = spec.scanner().count(text)
    return (sum(found), *found)


LINES = "total long, code long, comments long, blanks long"
_STRUCT = f"struct<{LINES.replace(' long', ': bigint')}>"
_KIND = pa.struct([(n.split()[0], pa.int64()) for n in LINES.split(", ")])


# Marks inside a text that is being counted: 1 before a comment, 2 behind it and before a string, 3 behind that; 4 for a comment's piece, 5 for a piece of code.


def _quoted(token: str) -> str:
    """A token's bytes, as characters, in a regular expression for Java."""
    return "".join(f"\\x{b:02x}" for b in token.encode())


def _string(start: str, end: str, many: bool) -> str:
    s, e = _quoted(start), _quoted(end)
    if not end:
        return f"{s}[\\s\\S]*+" if many else f"{s}(?:[^\\\\\\n]|\\\\[^\\n])*+\\\\?+"
    other = f"[^\\\\{e}{'' if many else '\\n'}]" if len(end.encode()) == 1 else f"(?!{e})[^\\\\{'' if many else '\\n'}]"
    if many:
        return f"{s}(?:{other}|\\\\\\n*+[^\\n])*+(?:{e}|\\\\\\n*+\\z|\\z)"
    return f"{s}(?:{other}|\\\\[^\\n])*+\\\\?+(?:{e})?+"


def marking(spec: Spec) -> str:
    """The expression that takes all but white space: its first group is a comment, its second a string."""
    longest = lambda pairs: sorted(pairs, key=lambda p: -len(p[0].encode()))
    comments = [f"{_quoted(t)}[^\\n]*+" for t, _ in longest([(t, "") for t in spec.line if t])]
    comments += [f"{_quoted(a)}[\\s\\S]*?(?:{_quoted(b) or '(?!)'}|\\z)" for a, b in longest([x for x in spec.block if x[0]])]
    strings = [_string(a, b, many) for a, b, many in longest([(*q, False) for q in spec.quotes if q[0]] + [(*q, True) for q in spec.multiline if q[0]])]
    first = "".join(f"\\x{b:02x}" for b in sorted({t.encode()[0] for t in (*spec.line, *(a for a, _ in (*spec.block, *spec.quotes, *spec.multiline))) if t}))
    plain = f"[^{first}\\n \\t\\r]++" + (f"|[{first}]" if first else "")
    return f"({'|'.join(comments) or '(?!)'})|({'|'.join(strings) or '(?!)'})|{plain}"


def lines_by_expressions(content: Column, language: Column, specs: dict[str, Spec]) -> Column:
    """The struct ``LINES`` of each content by built-in expressions; for languages without nested comments."""
    text = F.decode(F.coalesce(content, F.lit("").cast("binary")), "ISO-8859-1")
    text = F.regexp_replace(text, F.lit(r"[\x01-\x05]"), F.lit("\x06"))
    by_marking: dict[str, list[str]] = {}
    for key, spec in specs.items():
        if not spec.nested:
            by_marking.setdefault(marking(spec), []).append(key)
    if not by_marking:
        return F.lit(None).cast(_STRUCT)
    # All languages in one text that is parsed at once: x holds the text and the language.
    literal = lambda t: "'" + "".join(c if c.isalnum() else f"\\u{ord(c):04x}" for c in t) + "'"
    cases = " ".join(f"WHEN x.language IN ({', '.join(map(literal, keys))}) THEN regexp_replace(x.text, {literal(pattern)}, '\\u0001$1\\u0002$2\\u0003')" for pattern, keys in by_marking.items())
    both = F.array(F.struct(text.alias("text"), language.alias("language")))
    marked = F.get(F.call_function("transform", both, F.expr(f"x -> CASE {cases} END")), F.lit(0))
    # What is neither comment nor string leaves the marks alone. Inside comments, then inside strings, each piece
    # of a line becomes one mark; \\G goes on where the last piece ended.
    pieces = F.replace(marked, F.lit("\x01\x02\x03"), F.lit("\x05"))
    pieces = F.regexp_replace(pieces, F.lit(r"(?:\x01|\G(?!\A))(\n*+)[^\n\x02]++"), F.lit("$1\x04"))
    pieces = F.regexp_replace(pieces, F.lit(r"(?:\x02|\G(?!\A))(\n*+)[^\n\x03]++"), F.lit("$1\x05"))
    pieces = F.translate(pieces, " \t\r\x01\x02\x03", "")

    def counts(z: Column) -> Column:
        filled = F.regexp_count(z, F.lit(r"[\x04\x05]++")).cast("long")
        code = F.regexp_count(z, F.lit(r"\x04*+\x05[\x04\x05]*+")).cast("long")
        newlines = (F.length(z) - F.length(F.replace(z, F.lit("\n"), F.lit("")))).cast("long")
        open_end = ((z != "") & ~z.endswith("\n")).cast("long")
        blank = newlines - filled + open_end
        return F.struct((filled + blank).alias("total"), code.alias("code"), (filled - code).alias("comments"), blank.alias("blanks"))

    # Bound once: the pieces are the argument of one function, not an expression for each count.
    return F.when(pieces.isNotNull(), F.transform(F.array(pieces), counts)[0])


def with_lines(files: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """``files`` (content, language, ...) with ``LINES`` in l, and without content.

    What the scanner's workers are handed beside a row is small: the expressions
    run below them, and content goes on only where comments nest.
    """
    nested = sorted(k for k, x in specs.items() if x.nested)
    rest = [c for c in files.columns if c != "content"]
    flat = lines_by_expressions(F.col("content"), F.col("language"), specs)
    if not nested:
        return files.select(*rest, flat.alias("l"))
    mine = F.col("language").isin(nested)
    rows = files.select(*rest, flat.alias("_flat"), F.when(mine, F.col("content")).alias("_own"))
    by_scanner = lines_by_scanner(F.col("_own"), F.when(mine, F.col("language")), specs)
    parts = ("total", "code", "comments", "blanks")
    # Several references to a costly column keep it from being moved up beside the scanner, where content would have to go with it.
    rows = rows.select(*rest, *(F.col(f"_flat.{x}").alias(f"_{x}") for x in parts), by_scanner.alias("_nested"))
    return rows.select(*rest, F.struct(*(F.when(mine, F.col(f"_nested.{x}")).otherwise(F.col(f"_{x}")).alias(x) for x in parts)).alias("l"))


def lex(content: Column, language: Column, specs: dict[str, Spec]) -> Column:
    """The struct ``LINES`` of each content; zeros for null content, null for an unknown language."""
    flat = lines_by_expressions(content, language, specs)
    nested = sorted(k for k, x in specs.items() if x.nested)
    if not nested:
        return flat
    mine = language.isin(nested)
    return F.when(mine, lines_by_scanner(F.when(mine, content), F.when(mine, language), specs)).otherwise(flat)


def lines_by_scanner(content: Column, language: Column, specs: dict[str, Spec]) -> Column:
    """The struct ``LINES`` of each content by ``lex_bytes``."""

    @F.arrow_udf(LINES)
    def lines(contents: pa.Array, languages: pa.Array) -> pa.Array:
        out = []
        for c, key in zip(contents, languages.to_pylist(), strict=True):
            spec = specs.get(key)
            found = None if spec is None else lex_bytes(spec, c.as_py() or b"")
            out.append(found and dict(zip(("total", "code", "comments", "blanks"), found, strict=True)))
        return pa.array(out, _KIND)

    return lines(content, language)
