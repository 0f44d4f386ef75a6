"""Documentation trees as a data source: `spark.read.format("doctree").load(top)`, one root for each directory in `top`."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not, StringEndsWith

from .corpus import VERSION_CONTROL

SCHEMA = pa.schema([("root", pa.string()), ("path", pa.string()), ("content", pa.string()), ("hidden", pa.bool_())])
#: Directories are opened while planning until there are so many parts.
PARTS = 256
#: Rows are handed on in batches of about so many bytes of content.
BATCH_BYTES = 4 << 20


@dataclass
class Part(InputPartition):
    """A directory of a root, with all below it or with its own files alone."""

    root: str
    path: str
    below: bool


class DocTrees(DataSource):
    """(root, path, content, hidden) of every file below the directories of `path`, empty, dot- and underscore-files included.

    `hidden` says that a directory on the way begins with a dot; version-control directories are never entered, linked ones
    neither. Only .md files have their content read; one that can't be read has none. Filters on root (=, IN), on the end of path and on
    hidden decide what is walked, not only what is returned. Directories must be visible to all executors.
    Options: `parts`, how many parts to plan at least, if there are as many directories.
    """

    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return "root string, path string, content string, hidden boolean"

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("load() needs the directory that holds the roots")
        return DocTreeReader(self.options["path"].removeprefix("file://").removeprefix("file:"), int(self.options.get("parts", PARTS)))


class DocTreeReader(DataSourceReader):
    def __init__(self, top: str, parts: int):
        self.top, self.parts = top, parts
        #: None: all.
        self.roots: set[str] | None = None
        self.ends: list[str] = []
        self.hidden: bool | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what a walk can go by; the rest is left to Spark."""
        for f in filters:
            match f:
                case EqualTo(("root",), str(v)):
                    self._only({v})
                case In(("root",), values) if all(isinstance(v, str) for v in values):
                    self._only(set(values))
                case StringEndsWith(("path",), end):
                    self.ends.append(end)
                case EqualTo(("hidden",), bool(v)) if self.hidden in (None, v):
                    self.hidden = v
                case Not(EqualTo(("hidden",), bool(v))) if self.hidden in (None, not v):
                    self.hidden = not v
                case IsNotNull(("root" | "path" | "hidden",)):
                    pass
                case _:
                    yield f

    def _only(self, roots: set[str]) -> None:
        self.roots = roots if self.roots is None else self.roots & roots

    def _entered(self, path: str, name: str) -> bool:
        return name not in VERSION_CONTROL and not (self.hidden is False and name.startswith("."))

    def _open(self, root: str, path: str) -> tuple[list[str], list[str]]:
        """(directories, files) directly in a directory of a root, as paths."""
        dirs, files = [], []
        with os.scandir(os.path.join(self.top, root, path)) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                below = f"{path}/{e.name}" if path else e.name
                if e.is_dir(follow_symlinks=False):
                    dirs += [below] * self._entered(path, e.name)
                elif not e.is_dir() and all(below.endswith(end) for end in self.ends):
                    files.append(below)
        return dirs, files

    def partitions(self) -> list[InputPartition]:
        """Opens directories, widest trees first, until there are enough parts; each opened one's own files are a part."""
        with os.scandir(self.top) as entries:
            names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and (self.roots is None or e.name in self.roots))
        todo, done = deque(Part(n, "", True) for n in names), []
        while todo and len(todo) + len(done) < self.parts:
            part = todo.popleft()
            dirs, files = self._open(part.root, part.path)
            if files:
                done.append(Part(part.root, part.path, False))
            todo += [Part(part.root, d, True) for d in dirs]
        return [*done, *todo]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, size, todo = [], 0, [partition.path]
        while todo:
            path = todo.pop()
            dirs, files = self._open(partition.root, path)
            todo += dirs if partition.below else []
            hidden = any(part.startswith(".") for part in path.split("/"))
            if self.hidden is not None and hidden != self.hidden:
                continue
            for f in files:
                content = self._content(partition.root, f)
                rows.append((partition.root, f, content, hidden))
                size += len(content or "") + 256
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _content(self, root: str, path: str) -> str | None:
        if not path.endswith(".md"):
            return None
        try:
            with open(os.path.join(self.top, root, path), "rb") as f:
                return f.read().decode("utf-8", "replace")
        except OSError:
            return None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocTrees)
