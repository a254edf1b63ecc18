"""Definitions, calls and imports of source files. Python is parsed, in Arrow batches; Python files that don't parse are read by
patterns over text without comments and strings, and the other languages by patterns over token tables (syntax.py)."""

from __future__ import annotations

import ast
import keyword
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.paths import clean_import
from corvane.operators import syntax

SCHEMA = "path string, what string, name string, kind string, qualifier string, start_byte long, end_byte long, start_line int, end_line int"
Row = tuple[str, str, str | None, str | None, int, int, int, int]


def python_text(text: str) -> Iterator[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from _python_patterns(text)
        return
    starts = [0]
    for line in text.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    at = lambda n: (starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset, n.lineno, n.end_lineno)
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "definition", n.name, "function", None, *at(n)
        elif isinstance(n, ast.ClassDef):
            yield "definition", n.name, "class", None, *at(n)
        elif isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                yield "call", f.id, None, None, *at(f)
            elif isinstance(f, ast.Attribute):
                s, e, a, b = at(f)
                yield "call", f.attr, None, ast.unparse(f.value), e - len(f.attr.encode()), e, a, b
        elif isinstance(n, ast.Import):
            for a in n.names:
                yield "import", a.name, None, a.asname, *at(n)
        elif isinstance(n, ast.ImportFrom):
            yield "import", "." * n.level + (n.module or ""), None, None, *at(n)


_PY_NOISE = re.compile(r"#[^\n]*|(?:\"\"\".*?\"\"\"|\'\'\'.*?\'\'\')|\"(?:\\\\.|[^\"\\\\\n])*\"|\'(?:\\\\.|[^\'\\\\\n])*\'", re.S)
_PY_DEFINITION = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)[ \t]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?[^:\n]*:", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+(\.*[\w.]*)[ \t]+import\b|import[ \t]+([^\n;]+))", re.M)
_PY_CALL = re.compile(r"(?:([^\W\d][\w.]*)[ \t]*\.[ \t]*)?([^\W\d]\w*)[ \t]*\(")
_PY_WORDS = set(keyword.kwlist)


def _python_patterns(text: str) -> Iterator[Row]:
    """A file that doesn't parse: what its whole lines hold. A definition ends before the next line indented no more."""
    code = _PY_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    byte, line = _places(text)
    row = lambda what, name, kind, q, s, e: (what, name, kind, q, byte(s), byte(e), line(s), line(e))
    taken: set[int] = set()
    for m in _PY_DEFINITION.finditer(code):
        taken.add(m.start(3))
        end = re.compile(rf"^(?![ \t]{{{len(m[1]) + 1},}})[ \t]*\S", re.M).search(code, code.find("\n", m.end()) + 1 or len(code))
        stop = m.end() + len(code[m.end() : end.start() if end else len(code)].rstrip())
        yield row("definition", m[3], "class" if m[2] == "class" else "function", None, m.end(1), stop)
    for m in _PY_CALL.finditer(code):
        if m[2] not in _PY_WORDS and m.start(2) not in taken and not re.search(r"\b(?:def|class)[ \t]+$", code[max(0, m.start() - 20) : m.start()]):
            yield row("call", m[2], None, m[1], m.start(2), m.end(2))
    for m in _PY_IMPORT.finditer(code):
        s = m.end() - len(m[0].lstrip())
        if m[1]:
            yield row("import", m[1], None, None, s, m.end())
        else:
            for part in m[2].split(","):
                name = part.split()
                if name and re.fullmatch(r"[\w.]+", name[0]):
                    yield row("import", name[0], None, name[2] if len(name) == 3 and name[1] == "as" else None, s, m.end())


def _places(text: str):
    """Byte offset and line of a place in text, from running tables."""
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    if text.isascii():
        return (lambda i: i), (lambda i: bisect_right(lines, i))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)))).tolist()
    return size.__getitem__, (lambda i: bisect_right(lines, i))


def facts(files: DataFrame, registry: str = syntax.REGISTRY) -> DataFrame:
    """All definitions, calls and imports of files (path, content); files of kinds that the registry doesn't name, and null
    ones, give none. Python files are parsed in Arrow batches, the others are matched as token tables (syntax.py)."""

    def run(batches):
        for b in batches:
            rows = [(p, *r) for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) if p and t for r in python_text(t)]
            kinds = (pa.string(),) * 5 + (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    found = files.select("path", "content").where(F.endswith("path", F.lit(".py"))).mapInArrow(run, SCHEMA)
    return found.unionByName(syntax.facts(files, registry))


def definitions(files: DataFrame) -> DataFrame:
    return facts(files).where("what = 'definition'").select("path", "name", "kind", "start_line", "end_line")


def calls(files_or_facts: DataFrame) -> DataFrame:
    """file, pos (of the name), callee, qualifier."""
    return _facts(files_or_facts).where("what = 'call'").select(F.col("path").alias("file"), F.col("start_byte").alias("pos"), F.col("name").alias("callee"), "qualifier")


def imports(files_or_facts: DataFrame) -> DataFrame:
    """file, import_pos, module_path without quotes; of imports found at the same place the first by name counts."""
    found = _facts(files_or_facts).where("what = 'import'").groupBy("path", "start_byte", "end_byte").agg(F.min("name").alias("name"))
    return found.select(F.col("path").alias("file"), F.col("start_byte").alias("import_pos"), clean_import(F.col("name")).alias("module_path"))


def spans(files_or_facts: DataFrame) -> DataFrame:
    """Definitions as the call graph takes them: file, name, kind, start_byte, end_byte, start_line, end_line."""
    return _facts(files_or_facts).where("what = 'definition'").select(F.col("path").alias("file"), "name", "kind", "start_byte", "end_byte", "start_line", "end_line")


def _facts(df: DataFrame) -> DataFrame:
    return df if "what" in df.columns else facts(df)


def registry(spark: SparkSession, path: str = syntax.REGISTRY) -> DataFrame:
    """(ext, language) of what can be extracted: Python, and what a registry file names."""
    return syntax.languages(spark, path).unionByName(spark.createDataFrame([("py", "python")], "ext string, language string"))


def sample_sources(part: DataFrame) -> DataFrame:
    """A small file for each row of part, in turns of four languages."""
    k = F.col("p_partkey")
    code = [
        ("py", "import os\n\ndef a{k}():\n    return b{k}(os.getcwd())\n\nclass C{k}:\n    def m(self):\n        return a{k}()\n"),
        ("rs", "use crate::x::y;\n\nfn a{k}() {\n    b{k}();\n}\n"),
        ("go", 'package x\n\nimport "fmt"\n\nfunc a{k}() {\n\tfmt.Println(b{k}())\n}\n'),
        ("js", "const b{k} = (x) => { return x; };\nfunction a{k}() { return b{k}(1); }\n"),
    ]
    text, ext = F.lit(""), F.lit("")
    for i, (e, t) in enumerate(code):
        text = F.when(k % 4 == i, F.replace(F.lit(t), F.lit("{k}"), k.cast("string"))).otherwise(text)
        ext = F.when(k % 4 == i, F.lit(e)).otherwise(ext)
    return part.select(F.concat(F.lit("src/f"), k.cast("string"), F.lit("."), ext).alias("path"), text.alias("content"))


def sample_broken(part: DataFrame) -> DataFrame:
    """A file with a broken line, or with what reads like something else, for each row of part, in turns of five languages."""
    k = F.col("p_partkey")
    code = [
        ("java", "import a.b;\nclass A{k} {\n  A{k}() { g{k}(1); }\n  int f{k}(int x {\n}\n  void h{k}() { this.m{k}(\"//\"); }\n"),
        ("ts", "const r = /foo{k}(/;\nconst t = `a ${bar{k}(1)} b(`;\nexport default () => baz{k}();\nclass C { m{k}() { return [ ; }\n  o{k}(a: number): string { return p{k}(a); } }\n"),
        ("rb", "class C{k} < D\n  def a{k}\n    x = 1\n\n    b{k} 2\n    y.each{k} do |q| q.r{k} end\n    z = [1, # no{k}()\n  end\n  def self.z{k}; end\nend\n"),
        ("hs", "import Data.Map\nf{k} x = g{k} x\n\nmain{k} = do\n  put{k} \"a(\" -- b(\n{- c( -}\n"),
        ("rs", "use a::b{k};\nfn broken{k}( {\nfn k{k}() { x.y{k}().z{k}(); m::n{k}(1); }\n/* fn no{k}() { } */\n"),
    ]
    text, ext = F.lit(""), F.lit("")
    for i, (e, t) in enumerate(code):
        text = F.when(k % 5 == i, F.replace(F.lit(t), F.lit("{k}"), k.cast("string"))).otherwise(text)
        ext = F.when(k % 5 == i, F.lit(e)).otherwise(ext)
    return part.select(F.concat(F.lit("lib/b"), k.cast("string"), F.lit("."), ext).alias("path"), text.alias("content"))
