"""A data source of the files below a folder, names with a dot or an underscore in front included.

A partition is some folders; its task walks what is below them and never lists a folder that the ignore rules exclude. The
driver lists folders only until there are enough to deal out. Contents are read for wanted names alone, and leave a task in
batches of bounded size. Folders that can't be read, and links that lead nowhere, are passed over. Any file system that
Arrow opens by its address can be listed; the folder must be visible to all executors.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.functions.ignores import Matcher

SCHEMA = "path string, rel_path string, length bigint, modified_at timestamp, content binary"
#: Folders to deal out at least, if there are so many, and at most that partitions hold each.
SPREAD = 64
#: Bytes of contents of a batch.
BATCH = 8 << 20
#: Folders in folders, against links that lead back up.
DEEPEST = 100


@dataclass
class Folders(InputPartition):
    below: list[str]
    """Folders to walk, by their paths below the root."""
    only: list[str]
    """Folders whose own files count, without what is below."""


class FileTree(DataSource):
    """``spark.read.format("file_tree")`` with the options ``path``, ``rules`` (JSON list of ignore lines), ``wanted`` (a
    regular expression of paths below the root; all by default) and ``contents`` (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.address = options["path"]
        self.rules = json.loads(options.get("rules", "[]"))
        self.wanted = options.get("wanted")
        self.contents = options.get("contents", "true") == "true"
        self.spread = int(options.get("spread", SPREAD))

    def _open(self) -> tuple[arrow_fs.FileSystem, str]:
        if re.match(r"^[a-z][a-z0-9+.-]*:/", self.address):
            at, root = arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.address))
        else:
            at, root = arrow_fs.LocalFileSystem(), self.address
        return at, root.rstrip("/") or "/"

    def _listed(self, at: arrow_fs.FileSystem, root: str, folder: str, matcher: Matcher) -> tuple[list[str], list[arrow_fs.FileInfo]]:
        """The folders and files in a folder that are not ignored."""
        try:
            found = at.get_file_info(arrow_fs.FileSelector(posixpath.join(root, folder) if folder else root))
        except OSError:
            return [], []
        state = matcher.start
        for name in folder.split("/") if folder else ():
            state = matcher.step(state, name)
        folders, files = [], []
        for info in sorted(found, key=lambda i: i.base_name):
            own = matcher.step(state, info.base_name)
            if info.type == arrow_fs.FileType.Directory:
                if not matcher.decided(own, True) and folder.count("/") < DEEPEST:
                    folders.append(f"{folder}/{info.base_name}" if folder else info.base_name)
            elif info.type == arrow_fs.FileType.File and not matcher.decided(own, False):
                files.append(info)
        return folders, files

    def partitions(self) -> list[InputPartition]:
        at, root = self._open()
        matcher, level, only = Matcher(self.rules), [""], []
        while level and len(level) < self.spread:
            only += level
            level = [f for folder in level for f in self._listed(at, root, folder, matcher)[0]]
        n = max(1, min(self.spread, len(level) + len(only)))
        return [Folders(level[i::n], only[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        at, root = self._open()
        matcher = Matcher(self.rules)
        wanted = re.compile(self.wanted).search if self.wanted else lambda _: True
        rows: list[tuple] = []
        held = 0
        stack = [(f, True) for f in reversed(partition.below)] + [(f, False) for f in partition.only]
        while stack:
            folder, deeper = stack.pop()
            folders, files = self._listed(at, root, folder, matcher)
            if deeper:
                stack += [(f, True) for f in reversed(folders)]
            for info in files:
                rel = f"{folder}/{info.base_name}" if folder else info.base_name
                if not wanted(rel):
                    continue
                content = None
                if self.contents:
                    try:
                        with at.open_input_stream(info.path) as f:
                            content = f.read()
                    except OSError:
                        continue
                rows.append((info.path, rel, info.size, info.mtime, content))
                held += len(content or b"") + 200
                if held >= BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def files_below(spark: SparkSession, root: str, rules: list[str] | tuple[str, ...] = (), wanted: str | None = None, contents: bool = True) -> DataFrame:
    """``path, rel_path, length, modified_at, content`` of the files below ``root`` that ``rules`` don't ignore and ``wanted`` finds."""
    spark.dataSource.register(FileTree)
    read = spark.read.format("file_tree").option("rules", json.dumps(list(rules))).option("contents", str(contents).lower())
    return (read.option("wanted", wanted) if wanted else read).load(root)
