"""Command line: scan and pack a tree (the default), `code` for call-graph questions, `index build|clear|status`."""

from __future__ import annotations

import argparse
import hashlib
import os
import shutil
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import extract, filters, graph, index, pack, tokens
from corvane.sources import config, pdf, tree

UNLIMITED = 1 << 30
DEFAULT_FILE = "CORVANE.md"
SCHEMAS = {
    name: T.StructType([T.StructField(c, {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType()}[t]) for c, t in map(str.split, ddl.split(", "))])
    for name, ddl in {"files": "path string, mtime long, size long", "facts": extract.SCHEMA}.items()
}


class Refused(Exception):
    """A request that can't be met; its text is shown to the user."""


def session() -> SparkSession:
    s = SparkSession.builder.appName("corvane").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def project_name(paths: list[str]) -> str:
    """The folder's name, or that of the folder of a file; the argument itself if it is neither."""
    if not paths:
        return "project"
    p = Path(paths[0])
    name = p.name if p.is_dir() else p.parent.name if p.is_file() else ""
    return name or paths[0]


def first_url(paths: list[str]) -> str | None:
    """The one that a request is about: of several URLs the first counts."""
    return next((p for p in paths if "://" in p or p.startswith("git:") or p.endswith(".git") and not os.path.exists(p)), None)


def index_place(root: str) -> str:
    base = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share")
    return os.path.join(base, "corvane", hashlib.sha256(root.encode()).hexdigest()[:16])


def user_config() -> Path:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return Path(base) / "corvane" / "config.toml"


def scan(spark: SparkSession, roots: list[str], s: config.Settings) -> DataFrame:
    """Chosen files (path, size, mtime, content) of the roots. Files that are too large or excluded aren't read; others that
    names don't choose are, as their first line may."""
    found = tree.manifest(spark, roots, s.hidden, not s.no_ignore, s.max_depth)
    exclude = [p for root in roots for e in s.exclude if (p := config.exclude_pattern(e, root))]
    rules = {"max_size": s.max_size, "include": s.include, "only_include": s.only_include, "exclude": list(dict.fromkeys(exclude))}
    path, size = F.col("path"), F.col("size")
    maybe = filters.should_process(path, size, **rules)
    if not s.only_include:
        maybe |= (size <= s.max_size) & ~filters.matches_any(path, rules["exclude"])
    return tree.contents(found.where(maybe)).where(filters.should_process(path, size, F.col("content"), **rules))


def packed(files: DataFrame, output: str, project: str | None) -> DataFrame:
    return pack.document(files, tree=output != "files", contents=output != "tree", project=project)


def show_tokens(files: DataFrame, counter) -> None:
    counts = tokens.count(files, counter).persist()
    print(f"Total tokens: {tokens.total(counts).first()['tokens'] or 0:,}", file=sys.stderr)
    for row in counts.orderBy(F.desc("tokens"), "path").limit(15).collect():
        print(f"  {row['tokens']:>12,}  {row['path']}", file=sys.stderr)


def run_scan(spark: SparkSession, args: argparse.Namespace) -> None:
    if url := first_url(args.paths):
        raise Refused(f"{url}: web pages and remote repositories are taken as tables, not fetched")
    for p in args.paths:
        if not os.path.exists(p):
            raise Refused(f"{p}: no such file or folder")
    options = {k: v for k, v in vars(args).items() if k in ("include", "only_include", "exclude", "max_size", "max_depth", "output_format") and v is not None}
    options |= {k: True for k in ("hidden", "no_ignore") if getattr(args, k)}
    found = config.repository_file(args.paths[0])
    try:
        s = config.load(config.first_run(user_config()), *([found] if found else []), **options)
    except ValueError as e:
        raise Refused(str(e)) from e
    files = scan(spark, args.paths, s).persist()
    pieces = packed(files, s.output_format, project_name(args.paths) if args.xml else None)
    if args.pdf or args.file:
        _put(spark, pdf.write if args.pdf else pack.write, pieces, args.pdf or args.file)
    else:
        for row in pieces.orderBy(*pack.order()).select("line").toLocalIterator():
            print(row["line"])
    if not args.no_tokens:
        show_tokens(files, tokens.tokenizer_file(args.tokenizer_file) if args.tokenizer_file else tokens.words)


def _put(spark: SparkSession, write, pieces: DataFrame, path: str) -> None:
    """Tasks write the parts, in a folder beside the file; the file is what they are put together."""
    folder = f"{os.path.abspath(path)}.parts"
    try:
        write(pieces, f"file://{folder}")
        pdf.put_together(spark, f"file://{folder}", os.path.abspath(path))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(f"Written to {path}", file=sys.stderr)


def build(spark: SparkSession, root: str, place: str, force: bool = False, hidden: bool = False, ignore: bool = True) -> None:
    """Brings the index of root up to date: changed files are extracted anew, rows of files that are gone go too."""
    now = tree.manifest(spark, [root], hidden, ignore, UNLIMITED).where(filters.indexable(F.col("path")))
    old = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()} if force else index.load(spark, place, SCHEMAS)
    stale = index.stale(now, old["files"])
    kept = old["facts"].join(now.join(stale.select("path"), "path", "left_anti").select("path"), "path", "left_semi")
    index.save({"files": now.select("path", "mtime", "size"), "facts": kept.unionByName(extract.facts(tree.contents(stale)))}, place)


def counts(spark: SparkSession, place: str) -> dict[str, int]:
    tables = index.load(spark, place, SCHEMAS)
    what = {r["what"]: r["count"] for r in tables["facts"].groupBy("what").count().collect()}  # three rows
    return {"Files": tables["files"].count(), "Definitions": what.get("definition", 0), "Calls": what.get("call", 0), "Imports": what.get("import", 0)}


def run_index(spark: SparkSession, args: argparse.Namespace) -> None:
    root = os.path.realpath(args.path)
    place = index_place(root)
    if args.action == "clear":
        index.clear(spark, place)
        print(f"Index cleared for: {root}", file=sys.stderr)
        return
    if args.action == "build":
        if args.precise:
            raise Refused("language servers are not run; resolve with a table of locations instead")
        build(spark, root, place, args.force, args.hidden, not args.no_ignore)
    elif not os.path.isdir(place):
        print(f"No index found for: {root}")
        return
    print(f"Index status for: {root}")
    for name, n in counts(spark, place).items():
        print(f"  {name + ':':<13}{n}")


def answer(spark: SparkSession, root: str, place: str, target: str, callers: bool = False, depth: int = 1, strict: bool = False) -> DataFrame:
    """Blocks of the definitions at most `depth` calls from the target FILE:FUNCTION or FUNCTION: depth, node, block."""
    file, _, function = target.rpartition(":")
    if os.path.isabs(file):
        file = os.path.relpath(os.path.realpath(file), root)
    facts = index.load(spark, place, SCHEMAS)["facts"]
    defs = extract.spans(facts)
    wanted = spark.createDataFrame([(file or None, function)], "file string, func string")
    node = graph.find_nodes(wanted, defs).first()["node"]
    if node is None:
        raise Refused(f"function '{target}' not found in index")
    edges = graph.checkpointed(graph.call_edges(extract.calls(facts), extract.imports(facts), defs, strict))
    found = graph.definitions_to_depth(edges, spark.createDataFrame([(node,)], "node string"), defs, depth, callers)
    read = tree.contents(found.withColumn("full", F.concat(F.lit(root.rstrip("/") + "/"), "file")))
    block = pack.definition_block(F.col("file"), F.col("name"), F.col("content"), F.col("start_line"), F.col("end_line"))
    return read.select("depth", "node", block.alias("block"))


def run_code(spark: SparkSession, args: argparse.Namespace) -> None:
    root = os.path.realpath(args.root)
    place = index_place(root)
    build(spark, root, place, hidden=args.hidden, ignore=not args.no_ignore)
    blocks = answer(spark, root, place, args.target, args.callers, args.depth, args.strict)
    if args.file:
        text = blocks.orderBy("depth", "node").select(F.concat("block", F.lit("\n")).alias("line"))
        _put(spark, lambda lines, folder: lines.write.mode("overwrite").text(folder), text, args.file)
    else:
        for row in blocks.orderBy("depth", "node").toLocalIterator():
            print(row["block"] + "\n")


def _several(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parsed(argv: list[str]) -> argparse.Namespace:
    walk = argparse.ArgumentParser(add_help=False)
    walk.add_argument("-H", "--hidden", action="store_true")
    walk.add_argument("--no-ignore", action="store_true")
    if argv[:1] == ["code"]:
        p = argparse.ArgumentParser(prog="corvane code", parents=[walk])
        p.add_argument("target", help="FILE:FUNCTION or FUNCTION")
        p.add_argument("--root", default=".")
        p.add_argument("--callers", action="store_true")
        p.add_argument("--depth", type=int, default=1)
        p.add_argument("--strict", action="store_true")
        p.add_argument("-f", "--file")
        p.set_defaults(run=run_code)
        return p.parse_args(argv[1:])
    if argv[:1] == ["index"]:
        p = argparse.ArgumentParser(prog="corvane index", parents=[walk])
        p.add_argument("action", choices=["build", "clear", "status"])
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--force", action="store_true")
        p.add_argument("--precise", action="store_true")
        p.set_defaults(run=run_index)
        return p.parse_args(argv[1:])
    p = argparse.ArgumentParser(prog="corvane", parents=[walk])
    p.add_argument("paths", nargs="*")
    p.add_argument("-i", "--include", type=_several)
    p.add_argument("--only-include", type=_several)
    p.add_argument("-e", "--exclude", type=_several)
    p.add_argument("-m", "--max-size", type=int)
    p.add_argument("--max-depth", type=int)
    p.add_argument("-o", "--output", dest="output_format", choices=["tree", "files", "both"])
    p.add_argument("-f", "--file", nargs="?", const=DEFAULT_FILE)
    p.add_argument("-x", "--xml", action="store_true")
    p.add_argument("--pdf")
    p.add_argument("--no-tokens", action="store_true")
    p.add_argument("--tokenizer-file")
    p.add_argument("--config-path", action="store_true")
    p.set_defaults(run=run_scan)
    out = p.parse_args(argv)
    out.paths = out.paths or ["."]
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parsed(sys.argv[1:] if argv is None else argv)
    if getattr(args, "config_path", False):
        print(user_config())
        return 0
    try:
        args.run(spark or session(), args)
    except Refused as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
