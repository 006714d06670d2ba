"""Languages: display names, file names, extensions and tokens.

The definitions are this project's own, from the languages' public
specifications. Order gives each language its ordinal.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linemill.functions.lexer import Spec

REGISTRY_VERSION = "2"


@dataclass(frozen=True)
class Language:
    key: str
    name: str
    extensions: tuple[str, ...]
    filenames: tuple[str, ...] = ()
    spec: Spec = field(default_factory=Spec)


_Q, _A, _T = ('"', '"'), ("'", "'"), ("`", "`")
_SLASH = Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,))
_SLASH2 = Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q, _A))
_SLASHT = Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q, _A), multiline=(_T,))
_NEST = Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), nested=True)
_NEST3 = Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(('"""', '"""'),), nested=True)
_Q3, _A3 = ('"""', '"""'), ("'''", "'''")
_MARKS = Spec(block=(("<!--", "-->"),), quotes=(_Q,))
_HASH = Spec(line=("#",), quotes=(_Q, _A))
_MARK = Spec(block=(("<!--", "-->"),))
_SQL = Spec(line=("--",), block=(("/*", "*/"),), quotes=(_A,))
_LISP = Spec(line=(";",), block=(("#|", "|#"),), quotes=(_Q,), nested=True)

# One entry a language.
LANGUAGES: tuple[Language, ...] = (
    Language("C", "C", ("c",), (), _SLASH),
    Language("CHeader", "C Header", ("h",), (), _SLASH),
    Language("Cpp", "C++", ("cpp", "cc", "cxx", "c++", "tpp"), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(('R"(', ')"'),))),
    Language("CppHeader", "C++ Header", ("hpp", "hh", "hxx", "h++", "inl", "ipp"), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(('R"(', ')"'),))),
    Language("Python", "Python", ("py", "pyw", "pyi"), (), Spec(line=("#",), quotes=(_Q, _A), multiline=(('"""', '"""'), ("'''", "'''")))),
    Language("Rust", "Rust", ("rs",), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(('r#"', '"#'),), nested=True)),
    Language("Go", "Go", ("go",), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(_T,))),
    Language("Java", "Java", ("java",), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(('"""', '"""'),))),
    Language("JavaScript", "JavaScript", ("js", "mjs", "cjs", "jsx"), (), _SLASHT),
    Language("TypeScript", "TypeScript", ("ts", "mts", "cts", "tsx"), (), _SLASHT),
    Language("CSharp", "C#", ("cs",), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(('@"', '"'),))),
    Language("Kotlin", "Kotlin", ("kt", "kts"), (), _NEST3),
    Language("Swift", "Swift", ("swift",), (), _NEST3),
    Language("Scala", "Scala", ("scala", "sc"), (), _NEST3),
    Language("Dart", "Dart", ("dart",), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q, _A), multiline=(('"""', '"""'), ("'''", "'''")), nested=True)),
    Language("D", "D", ("d",), (), Spec(line=("//",), block=(("/*", "*/"), ("/+", "+/")), quotes=(_Q,), multiline=(_T,))),
    Language("Zig", "Zig", ("zig",), (), Spec(line=("//",), quotes=(_Q,))),
    Language("ObjectiveC", "Objective-C", ("m",), (), _SLASH),
    Language("Php", "PHP", ("php",), (), Spec(line=("//", "#"), block=(("/*", "*/"),), quotes=(_Q, _A))),
    Language("Groovy", "Groovy", ("groovy", "gradle"), ("Jenkinsfile",), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q, _A), multiline=(('"""', '"""'), ("'''", "'''")))),
    Language("Protobuf", "Protocol Buffers", ("proto",), (), _SLASH2),
    Language("Ruby", "Ruby", ("rb",), ("Rakefile", "Gemfile"), Spec(line=("#",), block=(("=begin", "=end"),), quotes=(_Q, _A))),
    Language("Perl", "Perl", ("pl", "pm"), (), Spec(line=("#",), block=(("=pod", "=cut"),), quotes=(_Q, _A))),
    Language("Shell", "Shell", ("sh", "bash", "zsh"), (), _HASH),
    Language("PowerShell", "PowerShell", ("ps1", "psm1"), (), Spec(line=("#",), block=(("<#", "#>"),), quotes=(_Q, _A))),
    Language("Julia", "Julia", ("jl",), (), Spec(line=("#",), block=(("#=", "=#"),), quotes=(_Q,), multiline=(('"""', '"""'),), nested=True)),
    Language("R", "R", ("r",), (), _HASH),
    Language("Lua", "Lua", ("lua",), (), Spec(line=("--",), block=(("--[[", "]]"),), quotes=(_Q, _A), multiline=(("[[", "]]"),))),
    Language("Haskell", "Haskell", ("hs",), (), Spec(line=("--",), block=(("{-", "-}"),), quotes=(_Q,), nested=True)),
    Language("OCaml", "OCaml", ("ml", "mli"), (), Spec(block=(("(*", "*)"),), quotes=(_Q,), nested=True)),
    Language("Erlang", "Erlang", ("erl", "hrl"), (), Spec(line=("%",), quotes=(_Q,))),
    Language("Elixir", "Elixir", ("ex", "exs"), (), Spec(line=("#",), quotes=(_Q,), multiline=(('"""', '"""'),))),
    Language("Clojure", "Clojure", ("clj", "cljs", "cljc"), (), Spec(line=(";",), multiline=(_Q,))),
    Language("Lisp", "Lisp", ("lisp", "lsp", "cl"), (), _LISP),
    Language("Scheme", "Scheme", ("scm", "ss"), (), _LISP),
    Language("Sql", "SQL", ("sql",), (), _SQL),
    Language("Fortran", "Fortran", ("f90", "f95", "f03"), (), Spec(line=("!",), quotes=(_Q, _A))),
    Language("Ada", "Ada", ("adb", "ads"), (), Spec(line=("--",), quotes=(_Q,))),
    Language("Pascal", "Pascal", ("pas",), (), Spec(line=("//",), block=(("{", "}"), ("(*", "*)")), quotes=(_A,))),
    Language("Assembly", "Assembly", ("asm", "s"), (), Spec(line=(";",), quotes=(_Q,))),
    Language("Makefile", "Makefile", ("mk", "mak"), ("Makefile", "GNUmakefile"), Spec(line=("#",))),
    Language("CMake", "CMake", ("cmake",), ("CMakeLists.txt",), Spec(line=("#",), block=(("#[[", "]]"),), quotes=(_Q,))),
    Language("Dockerfile", "Dockerfile", ("dockerfile",), ("Dockerfile",), Spec(line=("#",))),
    Language("Html", "HTML", ("html", "htm"), (), _MARK),
    Language("Xml", "XML", ("xml", "xsd", "xsl"), (), _MARK),
    Language("Markdown", "Markdown", ("md", "markdown"), (), _MARK),
    Language("Css", "CSS", ("css",), (), Spec(block=(("/*", "*/"),), quotes=(_Q, _A))),
    Language("Scss", "SCSS", ("scss",), (), _SLASH2),
    Language("Json", "JSON", ("json",), (), Spec()),
    Language("Yaml", "YAML", ("yml", "yaml"), (), _HASH),
    Language("Toml", "TOML", ("toml",), (), Spec(line=("#",), quotes=(_Q, _A), multiline=(('"""', '"""'), ("'''", "'''")))),
    Language("Ini", "INI", ("ini", "cfg"), (), Spec(line=(";", "#"))),
    Language("Tex", "TeX", ("tex", "sty"), (), Spec(line=("%",))),
    Language("Vim", "Vim Script", ("vim",), (), Spec(line=('"',), quotes=(_A,))),
    Language("Batch", "Batch", ("bat", "cmd"), (), Spec(line=("REM", "rem", "::"))),
    Language("Text", "Plain Text", ("txt",), (), Spec()),
    Language("Vue", "Vue", ("vue",), (), _MARKS),
    Language("Svelte", "Svelte", ("svelte",), (), _MARKS),
    Language("Astro", "Astro", ("astro",), (), _MARKS),
    Language("Less", "LESS", ("less",), (), _SLASH2),
    Language("Sass", "Sass", ("sass",), (), _SLASH2),
    Language("Stylus", "Stylus", ("styl",), (), _SLASH2),
    Language("Hcl", "HCL", ("hcl", "tf", "tfvars"), (), Spec(line=("#", "//"), block=(("/*", "*/"),), quotes=(_Q,))),
    Language("Nix", "Nix", ("nix",), (), Spec(line=("#",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(("''", "''"),))),
    Language("Nim", "Nim", ("nim", "nims", "nimble"), (), Spec(line=("#",), block=(("#[", "]#"),), quotes=(_Q,), multiline=(_Q3,), nested=True)),
    Language("Cuda", "CUDA", ("cu", "cuh"), (), _SLASH),
    Language("Glsl", "GLSL", ("glsl", "vert", "frag", "geom", "comp", "tesc", "tese"), (), _SLASH),
    Language("Hlsl", "HLSL", ("hlsl", "fx", "fxh"), (), _SLASH),
    Language("Wgsl", "WGSL", ("wgsl",), (), Spec(line=("//",), block=(("/*", "*/"),), nested=True)),
    Language("Metal", "Metal", ("metal",), (), _SLASH),
    Language("OpenCl", "OpenCL", ("opencl", "ocl"), (), _SLASH),
    Language("Verilog", "Verilog", ("v", "vh"), (), _SLASH),
    Language("SystemVerilog", "SystemVerilog", ("sv", "svh"), (), _SLASH),
    Language("Vhdl", "VHDL", ("vhd", "vhdl"), (), Spec(line=("--",), block=(("/*", "*/"),), quotes=(_Q,))),
    Language("Solidity", "Solidity", ("sol",), (), _SLASH2),
    Language("Vyper", "Vyper", ("vy",), (), Spec(line=("#",), quotes=(_Q, _A), multiline=(_Q3,))),
    Language("Move", "Move", ("move",), (), _NEST),
    Language("Cairo", "Cairo", ("cairo",), (), Spec(line=("//",), quotes=(_Q, _A))),
    Language("GraphQl", "GraphQL", ("graphql", "gql"), (), Spec(line=("#",), quotes=(_Q,), multiline=(_Q3,))),
    Language("Thrift", "Thrift", ("thrift",), (), Spec(line=("//", "#"), block=(("/*", "*/"),), quotes=(_Q, _A))),
    Language("CapnProto", "Cap'n Proto", ("capnp",), (), Spec(line=("#",), quotes=(_Q,))),
    Language("FlatBuffers", "FlatBuffers", ("fbs",), (), _SLASH),
    Language("Avro", "Avro IDL", ("avdl",), (), _SLASH),
    Language("ObjectiveCpp", "Objective-C++", ("mm",), (), _SLASH),
    Language("VisualBasic", "Visual Basic", ("vb", "vbs", "bas"), (), Spec(line=("'", "REM "), quotes=(_Q,))),
    Language("FSharp", "F#", ("fs", "fsi", "fsx"), (), Spec(line=("//",), block=(("(*", "*)"),), quotes=(_Q,), multiline=(_Q3, ('@"', '"')), nested=True)),
    Language("Crystal", "Crystal", ("cr",), (), Spec(line=("#",), quotes=(_Q,))),
    Language("Awk", "Awk", ("awk",), (), Spec(line=("#",), quotes=(_Q,))),
    Language("Fish", "Fish", ("fish",), (), _HASH),
    Language("Tcl", "Tcl", ("tcl",), (), Spec(line=("#",), quotes=(_Q,))),
    Language("Csh", "C Shell", ("csh", "tcsh"), (), _HASH),
    Language("Ksh", "Korn Shell", ("ksh",), (), _HASH),
    Language("Nushell", "Nushell", ("nu",), (), Spec(line=("#",), quotes=(_Q, _A), multiline=(_T,))),
    Language("Meson", "Meson", ("meson",), ("meson.build", "meson_options.txt"), Spec(line=("#",), quotes=(_A,), multiline=(_A3,))),
    Language("Bazel", "Bazel", ("bzl", "bazel"), ("BUILD", "WORKSPACE"), Spec(line=("#",), quotes=(_Q, _A), multiline=(_Q3, _A3))),
    Language("Ninja", "Ninja", ("ninja",), (), Spec(line=("#",))),
    Language("Just", "Just", ("just",), ("justfile",), _HASH),
    Language("Autoconf", "Autoconf", ("ac", "m4"), ("configure.ac",), Spec(line=("dnl ", "#"))),
    Language("QMake", "QMake", ("pri", "pro"), (), Spec(line=("#",))),
    Language("ReStructuredText", "reStructuredText", ("rst",), (), Spec()),
    Language("AsciiDoc", "AsciiDoc", ("adoc", "asciidoc"), (), Spec(line=("//",), block=(("////", "////"),))),
    Language("Org", "Org", ("org",), (), Spec(line=("# ",))),
    Language("Typst", "Typst", ("typ",), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), nested=True)),
    Language("Jupyter", "Jupyter Notebooks", ("ipynb",), (), Spec()),
    Language("Csv", "CSV", ("csv", "tsv"), (), Spec()),
    Language("Svg", "SVG", ("svg",), (), _MARKS),
    Language("Xaml", "XAML", ("xaml",), (), _MARKS),
    Language("MsBuild", "MSBuild", ("csproj", "fsproj", "vbproj", "props", "targets"), (), _MARKS),
    Language("Properties", "Java Properties", ("properties",), (), Spec(line=("#", "!"))),
    Language("Json5", "JSON5", ("json5", "jsonc"), (), _SLASH2),
    Language("Jsonnet", "Jsonnet", ("jsonnet", "libsonnet"), (), Spec(line=("//", "#"), block=(("/*", "*/"),), quotes=(_Q, _A), multiline=(("|||", "|||"),))),
    Language("Dhall", "Dhall", ("dhall",), (), Spec(line=("--",), block=(("{-", "-}"),), quotes=(_Q,), multiline=(("''", "''"),), nested=True)),
    Language("Cue", "CUE", ("cue",), (), Spec(line=("//",), quotes=(_Q, _A), multiline=(_Q3, _A3))),
    Language("Starlark", "Starlark", ("star",), (), Spec(line=("#",), quotes=(_Q, _A), multiline=(_Q3, _A3))),
    Language("Elm", "Elm", ("elm",), (), Spec(line=("--",), block=(("{-", "-}"),), quotes=(_Q,), multiline=(_Q3,), nested=True)),
    Language("PureScript", "PureScript", ("purs",), (), Spec(line=("--",), block=(("{-", "-}"),), quotes=(_Q,), multiline=(_Q3,), nested=True)),
    Language("Idris", "Idris", ("idr",), (), Spec(line=("--",), block=(("{-", "-}"),), quotes=(_Q,), multiline=(_Q3,), nested=True)),
    Language("Agda", "Agda", ("agda",), (), Spec(line=("--",), block=(("{-", "-}"),), quotes=(_Q,), nested=True)),
    Language("Lean", "Lean", ("lean",), (), Spec(line=("--",), block=(("/-", "-/"),), quotes=(_Q,), nested=True)),
    Language("Coq", "Coq", ("coq",), (), Spec(block=(("(*", "*)"),), quotes=(_Q,), nested=True)),
    Language("StandardMl", "Standard ML", ("sml", "sig"), (), Spec(block=(("(*", "*)"),), quotes=(_Q,), nested=True)),
    Language("Racket", "Racket", ("rkt",), (), _LISP),
    Language("EmacsLisp", "Emacs Lisp", ("el",), (), Spec(line=(";",), multiline=(_Q,))),
    Language("Prolog", "Prolog", ("prolog",), (), Spec(line=("%",), block=(("/*", "*/"),), quotes=(_Q, _A))),
    Language("Cobol", "COBOL", ("cob", "cbl", "cpy"), (), Spec(line=("*>",), quotes=(_Q, _A))),
    Language("Forth", "Forth", ("fth", "4th"), (), Spec(line=("\\ ",), block=(("( ", ")"),))),
    Language("Apl", "APL", ("apl",), (), Spec(line=("\u235d",), quotes=(_A,))),
    Language("Matlab", "MATLAB", ("mlx", "matlab"), (), Spec(line=("%",), block=(("%{", "%}"),), quotes=(_Q,))),
    Language("Gleam", "Gleam", ("gleam",), (), Spec(line=("//",), multiline=(_Q,))),
    Language("Haxe", "Haxe", ("hx",), (), _SLASH2),
    Language("Vala", "Vala", ("vala",), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(_Q3,))),
    Language("Odin", "Odin", ("odin",), (), Spec(line=("//",), block=(("/*", "*/"),), quotes=(_Q,), multiline=(_T,), nested=True)),
    Language("Gdscript", "GDScript", ("gd",), (), Spec(line=("#",), quotes=(_Q, _A), multiline=(_Q3,))),
    Language("GdShader", "GDShader", ("gdshader",), (), _SLASH),
    Language("Qml", "QML", ("qml",), (), _SLASH2),
    Language("CoffeeScript", "CoffeeScript", ("coffee",), (), Spec(line=("#",), block=(("###", "###"),), quotes=(_Q, _A), multiline=(_Q3, _A3))),
    Language("Handlebars", "Handlebars", ("hbs", "handlebars"), (), Spec(block=(("<!--", "-->"), ("{{!", "}}")))),
    Language("Pug", "Pug", ("pug",), (), Spec(line=("//",), quotes=(_Q, _A))),
)


def _once(pairs: list[tuple[str, str]]) -> dict[str, str]:
    found: dict[str, str] = {}
    for text, key in pairs:
        if found.setdefault(text.lower(), key) != key:
            raise ValueError(f"{text} belongs to both {found[text.lower()]} and {key}")
    return found


class Registry:
    """Definitions with unique extensions and file names, compared in lower case."""

    def __init__(self, languages: tuple[Language, ...] = LANGUAGES):
        self.languages = languages
        if len({x.key for x in languages}) < len(languages):
            raise ValueError("two languages have one key")
        self.by_extension = _once([(e, x.key) for x in languages for e in x.extensions])
        self.by_filename = _once([(f, x.key) for x in languages for f in x.filenames])
        self.specs = {x.key: x.spec for x in languages}
        self.names = {x.key: x.name for x in languages}

    @classmethod
    def from_json(cls, path: str) -> Registry:
        """From a file of {"languages": {key: {name, extensions, filenames, line_comment, multi_line_comments, quotes, verbatim_quotes, nested}}}; all but the key may be missing."""
        with open(path, encoding="utf-8") as f:
            return cls.from_rows([{"key": k} | v for k, v in json.load(f)["languages"].items()])

    @classmethod
    def from_frame(cls, frame: DataFrame) -> Registry:
        """From a table with columns of those names, and optionally an ordinal; a registry is small."""
        rows = [r.asDict(recursive=True) for r in frame.collect()]
        return cls.from_rows(sorted(rows, key=lambda r: (r.get("ordinal") or 0, r["key"])))

    @classmethod
    def from_rows(cls, rows: list[dict]) -> Registry:
        got = lambda r, k: tuple(r.get(k) or ())
        pairs = lambda r, k: tuple((x[0], x[1]) for x in got(r, k))
        languages = []
        for r in rows:
            spec = Spec(line=got(r, "line_comment"), block=pairs(r, "multi_line_comments"), quotes=pairs(r, "quotes"), multiline=pairs(r, "verbatim_quotes"), nested=bool(r.get("nested")))
            languages.append(Language(r["key"], r.get("name") or r["key"], got(r, "extensions"), got(r, "filenames"), spec))
        return cls(tuple(languages))

    def detect(self, path: str) -> str | None:
        """The language of a path, by file name and then by extension; None if unknown."""
        name = path.rpartition("/")[2]
        lowered = name.translate(_ASCII)
        if lowered in self.by_filename:
            return self.by_filename[lowered]
        return self.by_extension.get(lowered.rpartition(".")[2]) if "." in name else None

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, x.key, x.name, x.spec.nested, [(s, "", False) for s in x.spec.line] + [(s, e, True) for s, e in x.spec.block], [(s, e, False) for s, e in x.spec.quotes] + [(s, e, True) for s, e in x.spec.multiline]) for i, x in enumerate(self.languages, 1)]
        token = "array<struct<start: string, end: string, multiline: boolean>>"
        return spark.createDataFrame(rows, f"ordinal short, key string, name string, nested boolean, comments {token}, strings {token}")

    def ordinals(self, spark: SparkSession) -> DataFrame:
        """(language, ordinal, name), in the plan itself."""
        keys = [x.key for x in self.languages]
        return spark.createDataFrame(pa.table({"language": pa.array(keys, pa.string()), "ordinal": pa.array(range(1, len(keys) + 1), pa.int16()), "name": pa.array([self.names[k] for k in keys], pa.string())}))

    def extensions(self, spark: SparkSession) -> DataFrame:
        return self._lookup(spark, "ext_lower", self.by_extension)

    def filenames(self, spark: SparkSession) -> DataFrame:
        return self._lookup(spark, "name_lower", self.by_filename)

    @staticmethod
    def _lookup(spark: SparkSession, column: str, pairs: dict[str, str]) -> DataFrame:
        """A table that lies in the plan itself, so that no job is needed to broadcast it."""
        names, keys = zip(*sorted(pairs.items()), strict=True) if pairs else ((), ())
        return spark.createDataFrame(pa.table({column: pa.array(names, pa.string()), "key": pa.array(keys, pa.string())}))


_ASCII = {c: c + 32 for c in range(65, 91)}
