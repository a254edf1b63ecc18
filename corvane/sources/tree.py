"""Files of directory trees as rows (path, content, size): a manifest, filters on it, contents read afterwards."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.operators.filters import MAX_DEPTH, glob_regex
from corvane.operators.graph import checkpointed

#: Characters of file contents that a task holds before it passes them on; bounds memory, never a file.
MOST_CHARS = 8_000_000
MANIFEST = "path string, full string, size long, mtime long"
#: Written by the tool itself, never scanned. Fixed value for the index folder's kind.
OWN_FILES = {".corvane", "CORVANE.md"}


#: The driver lists folders until so many are left, which tasks list.
FOLDERS = 64


def _rules(file: str) -> list[tuple[bool, bool, re.Pattern]]:
    """(keeps, folders only, pattern) of each line of an ignore file; none if it can't be read."""
    rules = []
    try:
        with open(file, encoding="utf-8", errors="replace") as f:
            lines = f.read().splitlines()
    except OSError:
        return rules
    for line in lines:
        line = line.rstrip()
        if line and not line.startswith("#"):
            rules.append((line.startswith("!"), line.endswith("/"), re.compile(glob_regex(line.removeprefix("!").rstrip("/")))))
    return rules


def _above(root: str) -> list[tuple[int, str, tuple]]:
    """Rules that hold in root from outside: the user's, the repository's, and those of ignore files of folders above it,
    of which .gitignore counts up to the repository's top only."""
    root = os.path.realpath(root)
    folders = [root]
    while os.path.dirname(folders[-1]) != folders[-1]:
        folders.append(os.path.dirname(folders[-1]))
    top = next((i for i, f in enumerate(folders) if os.path.exists(os.path.join(f, ".git"))), -1)
    prefix = lambda folder: os.path.relpath(root, folder).replace(os.sep, "/") + "/" if folder != root else ""
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    files = []
    if top >= 0:
        files = [(prefix(folders[top]), os.path.join(base, "git", "ignore")), (prefix(folders[top]), os.path.join(folders[top], ".git", "info", "exclude"))]
    for i in range(len(folders) - 1, 0, -1):
        names = (".gitignore", ".ignore") if i <= top else (".ignore",)
        files += [(prefix(folders[i]), os.path.join(folders[i], name)) for name in names]
    return [(0, add, rule) for add, file in files for rule in _rules(file)]


def _listed(root: str, rel: str, level: int, rules: list, hidden: bool, ignore: bool, max_depth: int) -> tuple[list, list]:
    """The files of a folder, and its folders as (root, relative path, level, rules). A rule (strip, add, rule) is matched
    against add + path[strip:]; the last one that matches wins."""
    folder, files, folders = os.path.join(root, rel), [], []
    if ignore:
        strip = len(rel) + 1 if rel else 0
        rules = [*rules, *[(strip, "", r) for name in (".gitignore", ".ignore") for r in _rules(os.path.join(folder, name))]]
    for e in sorted(os.scandir(folder), key=lambda e: e.name):
        path = f"{rel}/{e.name}" if rel else e.name
        if e.name in OWN_FILES or (not hidden and e.name.startswith(".")):
            continue
        is_dir, gone = e.is_dir(follow_symlinks=False), False
        for strip, add, (keep, only_dirs, pattern) in rules:
            if (is_dir or not only_dirs) and pattern.match(add + path[strip:]):
                gone = not keep
        if gone:
            continue
        if is_dir and level < max_depth:
            folders.append((root, path, level + 1, rules))
        elif e.is_file(follow_symlinks=False):
            s = e.stat()
            files.append((path, e.path, s.st_size, int(s.st_mtime)))
    return files, folders


def _file(path: str) -> tuple[str, str, int, int]:
    s = os.stat(path)
    return os.path.basename(path), path, s.st_size, int(s.st_mtime)


def walk(root: str, hidden: bool = False, ignore: bool = True, max_depth: int = MAX_DEPTH) -> Iterator[tuple[str, str, int, int]]:
    """(relative path, full path, size, mtime) of regular files up to max_depth. Rules of ignore files hold below their folder."""
    if os.path.isfile(root):
        yield _file(root)
        return
    stack = [(root, "", 1, _above(root) if ignore else [])]
    while stack:
        files, folders = _listed(*stack.pop(), hidden, ignore, max_depth)
        yield from files
        stack += reversed(folders)


def manifest(spark: SparkSession, roots: list[str], hidden: bool = False, ignore: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All files below the roots; a file below two roots is there twice. The driver lists level by level until FOLDERS are
    left; tasks list what is below these, which must be mounted wherever they run, and the list is checkpointed."""
    files = [_file(r) for r in roots if os.path.isfile(r)]
    left = [(r, "", 1, _above(r) if ignore else []) for r in roots if not os.path.isfile(r)]
    while left and len(left) < FOLDERS:
        level = [_listed(*f, hidden, ignore, max_depth) for f in left]
        files += [x for some, _ in level for x in some]
        left = [f for _, more in level for f in more]
    here = spark.createDataFrame(files, MANIFEST)
    if not left:
        return here

    def run(batches):
        for b in batches:
            for k in b.column("k").to_pylist():
                stack = [left[k]]
                while stack:
                    some, more = _listed(*stack.pop(), hidden, ignore, max_depth)
                    stack += more
                    cols = list(zip(*some, strict=True)) if some else [[]] * 4
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["path", "full", "size", "mtime"])

    numbers = spark.createDataFrame([(k,) for k in range(len(left))], "k long").repartition(min(len(left), 1024), "k")
    return checkpointed(here.union(numbers.mapInArrow(run, MANIFEST)))


def contents(files: DataFrame) -> DataFrame:
    """files with content instead of full: only these files are read, a few megabytes at a time, hidden ones too; those
    that can't be read or aren't UTF-8 are left out. The tree must be mounted wherever tasks run."""
    columns = [c for c in files.columns if c != "full"]
    schema = ", ".join([*[f"`{c}` {files.schema[c].dataType.simpleString()}" for c in columns], "content string"])

    def run(batches):
        for b in batches:
            rows, texts, held = [], [], 0
            for i, full in enumerate(b.column("full").to_pylist()):
                try:
                    with open(full, "rb") as f:
                        texts.append(f.read().decode())
                except (OSError, UnicodeDecodeError):
                    continue
                rows.append(i)
                held += len(texts[-1])
                if held > MOST_CHARS:
                    yield _rows(b, rows, texts, columns)
                    rows, texts, held = [], [], 0
            yield _rows(b, rows, texts, columns)

    return files.mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, rows: list[int], texts: list[str], columns: list[str]) -> pa.RecordBatch:
    some = batch.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*[some.column(c) for c in columns], pa.array(texts, pa.string())], names=[*columns, "content"])
