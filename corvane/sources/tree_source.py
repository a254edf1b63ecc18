"""Directory trees as a Spark data source: a partition a subtree, and filters that are tried while the tree is walked.

    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("corvane_tree").option("roots", json.dumps(["/a", "/b"])).load().where("depth <= 3 AND size < 1000")

Options: roots (a JSON list, or load()'s path), hidden, ignore, max_depth, subtrees (as many partitions as are tried for, 1 by
default: only the roots' own entries are listed while planning). Files are rows (path, full, size, mtime, depth, name), read by
tasks, which must see the same folders. The largest known subtrees are cut first: those with the most folders.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

from corvane.operators.filters import MAX_DEPTH
from corvane.sources.tree import _above, _file, _listed

SCHEMA = "path string, full string, size long, mtime long, depth int, name string"
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Rows of a batch.
BATCH = 10_000
_TESTS = {
    EqualTo: lambda x, f: x == f.value, In: lambda x, f: x in f.value, LessThan: lambda x, f: x < f.value, LessThanOrEqual: lambda x, f: x <= f.value, GreaterThan: lambda x, f: x > f.value,
    GreaterThanOrEqual: lambda x, f: x >= f.value, StringStartsWith: lambda x, f: x.startswith(f.value), StringEndsWith: lambda x, f: x.endswith(f.value), StringContains: lambda x, f: f.value in x,
}


class Subtree(InputPartition):
    """Folders that a task walks, as _listed takes them, and files that are known already."""

    def __init__(self, folders: list, files: list):
        self.folders, self.files = folders, files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        roots = json.loads(options["roots"]) if options.get("roots") else [options["path"]]
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.roots, self.hidden, self.ignore = roots, flag("hidden", False), flag("ignore", True)
        self.max_depth, self.subtrees = int(options.get("max_depth", MAX_DEPTH)), int(options.get("subtrees", 1))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons with a column's value, and patterns of paths and names. A bound of the depth, and the beginning of a
        path, also keep whole folders from being listed."""
        for f in filters:
            column = f.attribute[0]
            if isinstance(f, IsNotNull):
                continue  # no column is ever null
            if type(f) in _TESTS and getattr(f, "value", None) is not None and len(f.attribute) == 1 and column in _COLUMNS:
                self.tests.append(f)
                if column == "depth" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.max_depth = min(self.max_depth, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _wanted(self, folder: tuple) -> bool:
        """Whether a folder can hold a file that the filters leave."""
        path = folder[1] + "/"
        for f in self.tests:
            if f.attribute[0] == "path" and isinstance(f, (StringStartsWith, EqualTo)) and not (path.startswith(f.value) or f.value.startswith(path)):
                return False
        return True

    def _list(self, folder: tuple) -> tuple[list, list]:
        files, folders = _listed(*folder, self.hidden, self.ignore, self.max_depth)
        return files, [f for f in folders if self._wanted(f)]

    def partitions(self) -> list[Subtree]:
        """A subtree for each folder in the roots; while there are fewer than asked for, the one with the most folders is cut."""
        files = [_file(r) for r in self.roots if os.path.isfile(r)]
        heap: list[tuple[int, int, list]] = []
        known = 0

        def cut(folders: list) -> None:
            nonlocal known
            for folder in folders:
                try:
                    found, below = self._list(folder)
                except OSError:
                    if folder[1] == "":
                        raise  # a root that isn't there
                    continue
                files.extend(found)
                for f in below:
                    known += 1
                    heapq.heappush(heap, (0, known, [f]))

        if self.max_depth > 0:
            cut([(r, "", 1, _above(r) if self.ignore else []) for r in self.roots if not os.path.isfile(r)])
        while heap and len(heap) < self.subtrees:
            cut(heapq.heappop(heap)[2])
        return [*([Subtree([], files)] if files else []), *[Subtree(folders, []) for _, _, folders in heap]] or [Subtree([], [])]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        held, stack = [], list(partition.folders)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) if held else [[]] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], names=_COLUMNS)

        def keep(files: list) -> None:
            for path, full, size, mtime in files:
                row = (path, full, size, mtime, path.count("/") + 1, os.path.basename(path))
                if all(_TESTS[type(f)](row[_COLUMNS.index(f.attribute[0])], f) for f in self.tests):
                    held.append(row)

        keep(partition.files)
        while stack:
            try:
                files, folders = self._list(stack.pop())
            except OSError:  # it went away, or may not be read
                continue
            keep(files)
            stack += folders
            if len(held) >= BATCH:
                yield batch()
                held.clear()
        yield batch()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvane_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
