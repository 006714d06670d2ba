"""File trees as a Python data source, ``sourcetree``.

Options: ``roots`` (a JSON array; a single path will do; default "."), ``hidden``
("true" walks names that start with a dot), ``gitignore`` ("false" reads no
ignore files), ``content`` ("false" leaves contents null), ``extensions``
("false" keeps files of unknown language), ``listed`` (levels of directories that
are listed ahead of the tasks, 2 by default), ``parts`` (partitions that walk at
most, 500 by default), ``longest`` (bytes of a content at
most, 2 ** 30 by default).

The driver lists the uppermost levels only. The directories below them are dealt
to partitions, which walk their subtrees with the ignore rules of the directories
above as their state. The walk prunes hidden and ignored directories and keeps regular
files only; links are followed at roots alone. A root that is a file is never
pruned, and has a row even if it can't be read; its content is then null.

Names are bytes. ``path_bytes`` holds a path as it is; ``path``, ``root``,
``rel`` and ``name`` show bytes that aren't UTF-8 as U+FFFD. Rules match bytes.

A content is one binary value. A file of more than ``longest`` bytes fails the
read with its path rather than being counted short.

``read_tree`` lists with the source, deals the files out evenly and reads them
where they were dealt to, so that one large subtree isn't one task's reading.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linemill.sources import ignore
from linemill.sources.registry import Registry

SCHEMA = "path string, root string, rel string, name string, is_explicit boolean, length long, content binary, path_bytes binary"
_LONGEST_PATH = 4096
#: Bytes of contents in an Arrow batch, but for a longer file alone.
_BATCH = 16 << 20


@dataclass
class _Part(InputPartition):
    """Files that are listed already, and directories whose subtrees are to be walked, each with its rules."""

    files: list[tuple[bytes, bytes, bytes, bool, int]] = field(default_factory=list)
    subtrees: list[tuple[bytes, bytes, list]] = field(default_factory=list)

    def __hash__(self):
        return id(self)


def _flag(options: dict, key: str, default: bool) -> bool:
    return str(options.get(key, default)).lower() == "true"


def shown(name: bytes) -> str:
    return name.decode("utf-8", "replace")


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        roots = options.get("roots", options.get("path", "."))
        self.roots = json.loads(roots) if roots.startswith("[") else [roots]
        self.roots = self.roots or ["."]
        self.hidden, self.gitignore = _flag(options, "hidden", False), _flag(options, "gitignore", True)
        self.content, self.known = _flag(options, "content", True), _flag(options, "extensions", True)
        self.listed, self.parts, self.longest = int(options.get("listed", 2)), int(options.get("parts", 500)), int(options.get("longest", 1 << 30))
        self.registry = Registry()

    def partitions(self) -> list[InputPartition]:
        """The files of the levels listed here, by the thousand; the directories below them, ``parts`` partitions at most."""
        files, subtrees = [], []
        for root in map(os.fsencode, self.roots):
            if not os.path.isdir(root):
                if self.registry.detect(os.fsdecode(root)) or not self.known:
                    length = os.stat(root).st_size if os.path.isfile(root) else 0
                    files.append((root, root, os.path.basename(root), True, length))
                continue
            base = root.rstrip(b"/") or b"/"
            level = [(base, base, [])]
            for _ in range(self.listed):
                below = []
                for item in level:
                    own, dirs = self._scan(*item)
                    files += own
                    below += dirs
                level = below
            subtrees += level
        n = min(self.parts, len(subtrees))
        parts = [_Part(subtrees=subtrees[i::n]) for i in range(n)]
        parts += [_Part(files=files[i : i + 1000]) for i in range(0, len(files), 1000)]
        return parts or [_Part()]

    def _scan(self, root: bytes, directory: bytes, chain: list) -> tuple[list, list]:
        """Files and directories of one directory that stay."""
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError:
            return [], []
        below = directory.rstrip(b"/")
        if self.gitignore:
            try:
                with open(below + b"/.gitignore", "rb") as f:
                    rules = ignore.parse(os.fsdecode(f.read()))
                chain = [*chain, (os.fsdecode(below), rules)] if rules else chain
            except OSError:
                pass
        files, dirs = [], []
        for e in entries:
            path = below + b"/" + e.name
            if (not self.hidden and e.name.startswith(b".")) or len(path) >= _LONGEST_PATH:
                continue
            if e.is_dir(follow_symlinks=False):
                if not (chain and ignore.ignored(chain, os.fsdecode(path), True)):
                    dirs.append((root, path, chain))
            elif e.is_file(follow_symlinks=False) and (not self.known or self.registry.detect(os.fsdecode(e.name))):
                if chain and ignore.ignored(chain, os.fsdecode(path), False):
                    continue
                try:
                    files.append((path, root, path[len(root.rstrip(b"/")) + 1 :], False, e.stat(follow_symlinks=False).st_size))
                except OSError:
                    continue
        return files, dirs

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from map(self._row, filter(self._readable, partition.files))
        todo = list(partition.subtrees)
        while todo:
            files, dirs = self._scan(*todo.pop())
            todo += dirs
            yield from map(self._row, filter(self._readable, files))

    def _readable(self, file: tuple) -> bool:
        """Files that the walk met and that can't be opened are left out, as are all that are gone by now."""
        return file[3] or os.access(file[0], os.R_OK)

    def _row(self, file: tuple) -> tuple:
        path, root, rel, explicit, length = file
        content = read_content(path, self.longest) if self.content else None
        length = len(content) if content is not None else length if not self.content else 0
        return shown(path), shown(root), shown(rel), shown(os.path.basename(path)), explicit, length, content, path


def read_content(path: bytes, longest: int) -> bytes | None:
    """The whole file, or None if it can't be read."""
    try:
        with open(path, "rb") as f:
            if os.fstat(f.fileno()).st_size > longest:
                raise ValueError(f"{shown(path)} has more than {longest} bytes")
            return f.read()
    except OSError:
        return None


def _contents(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("path_bytes")
            held, rows, size = [], [], 0
            for i, path in enumerate(b.column(at).to_pylist()):
                held.append(read_content(path, longest))
                rows.append(i)
                size += len(held[-1] or b"")
                if size > _BATCH:
                    yield _with(b, rows, held)
                    held, rows, size = [], [], 0
            if rows:
                yield _with(b, rows, held)

    return run


def _with(b: pa.RecordBatch, rows: list[int], contents: list) -> pa.RecordBatch:
    """The rows with their contents; rows of the walk whose file can't be read are left out."""
    explicit = b.column(b.schema.get_field_index("is_explicit")).to_pylist()
    stay = [k for k, i in enumerate(rows) if contents[k] is not None or explicit[i]]
    out = b.take(pa.array([rows[k] for k in stay], pa.int64()))
    columns = {n: out.column(i) for i, n in enumerate(out.schema.names)}
    columns["content"] = pa.array([contents[k] for k in stay], pa.binary())
    columns["length"] = pa.array([len(contents[k] or b"") for k in stay], pa.int64())
    return pa.RecordBatch.from_arrays([columns[n] for n in out.schema.names], names=out.schema.names)


def read_tree(spark: SparkSession, roots: list[str], *, longest: int = 1 << 30, partitions: int | None = None, **options) -> DataFrame:
    """The files of the roots. partitions: that the files are read in; four a core by default."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("sourcetree").option("roots", json.dumps(roots or ["."]))
    wanted = str(options.pop("content", True)).lower() == "true"
    for k, v in options.items():
        reader = reader.option(k, str(v).lower())
    files = reader.option("content", "false").load()
    if not wanted:
        return files
    dealt = files.repartition(partitions or 4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(_contents(longest), SCHEMA)
