"""Rendering a corpus: directory tree, file blocks, definition blocks and the packed document as ordered lines."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import xml_escape


def tree_lines(files: DataFrame, faithful: bool = True) -> DataFrame:
    """path, level, line: the tree entries that each path adds to those of the path before it, by components.

    faithful compares each component with that of the same level before; otherwise whole prefixes are compared,
    so that equal names below different parents are both shown. Paths that share their first two components are ordered
    apart from others; only each group's last path meets the next one's first. A null path gives no line; repeated paths
    give theirs once."""
    parts = files.where("path is not null").select("path", F.split("path", "/").alias("c")).withColumn("_top", F.slice("c", 1, 2))
    # One row a folder of the second level, or file above it.
    tops = parts.groupBy("_top").agg(F.max("c").alias("_last"))
    tops = tops.select("_top", F.lag("_last").over(Window.orderBy("_top")).alias("_before"))
    seen = parts.withColumn("_prev", F.lag("c").over(Window.partitionBy("_top").orderBy("c"))).join(tops, "_top")
    seen = seen.withColumn("prev", F.coalesce("_prev", "_before"))
    each = seen.select("path", "c", "prev", F.posexplode("c").alias("level", "name"))
    same = F.get("prev", F.col("level")) == F.col("name")
    if not faithful:
        same = F.slice("c", F.lit(1), F.col("level") + 1) == F.slice("prev", F.lit(1), F.col("level") + 1)
    counts = each.groupBy("level").agg(F.count_distinct("name").alias("_n"))
    shown = each.where(~F.coalesce(same, F.lit(False))).join(counts, "level")
    leaf = F.col("level") == F.size("c") - 1
    text = F.when(leaf, F.concat(F.lit("└── "), "name")).when(F.col("_n") == 1, F.concat(F.lit("└── "), "name", F.lit("/"))).otherwise(F.concat(F.lit("├── "), "name", F.lit("/")))
    return shown.select("path", "level", F.concat(F.repeat(F.lit("  "), F.col("level")), text).alias("line"))


def file_block(path: Column, content: Column, xml: bool = False) -> Column:
    if xml:
        return F.concat(F.lit('<file path="'), xml_escape(path), F.lit('">\n'), F.repeat(F.lit("="), F.lit(48)), F.lit("\n"), content, F.lit("\n</file>\n"))
    return F.concat(F.lit("\nFile: "), path, F.lit("\n"), F.repeat(F.lit("="), F.lit(48)), F.lit("\n"), content, F.lit("\n"))


def definition_block(file: Column, name: Column, content: Column, start: Column, end: Column) -> Column:
    """A heading and the fenced source lines start to end (from 1, inclusive)."""
    lines = F.slice(F.split(content, "\n"), start, end - start + 1)
    return F.concat(F.lit("## "), file, F.lit(":"), name, F.lit("\n```\n"), F.array_join(lines, "\n"), F.lit("\n```"))


def order() -> list[Column]:
    """Order of a document's pieces: paths by their components."""
    return [F.col("section"), F.split("path", "/"), F.col("ord")]


def document(files: DataFrame, tree: bool = True, contents: bool = True, project: str | None = None) -> DataFrame:
    """section, path, ord, line: the packed document in pieces; ordered by these columns they make the text.

    With a project name, which is escaped, the pieces are tagged. The document isn't gathered in one row. A null content
    leaves its block out of the text; no files give the headings and a summary of 0."""
    spark = files.sparkSession
    xml = project is not None
    fixed: list[tuple[int, str]] = []
    if xml:
        fixed.append((0, f'<context name="{escape(project, {chr(34): "&quot;", chr(39): "&apos;"})}">'))
    if tree:
        fixed += [(1, "<tree>" if xml else "Directory Structure:"), (3, "</tree>\n" if xml and contents else "</tree>" if xml else "")]
    if contents:
        fixed += [(4, "<files>" if xml else "File Contents:"), (6, "</files>" if xml else "")]
    out = spark.createDataFrame([(s, "", 0, t) for s, t in fixed] or [(0, "", 0, "")], "section int, path string, ord int, line string")
    if tree:
        out = out.unionByName(tree_lines(files).select(F.lit(2).alias("section"), "path", F.col("level").alias("ord"), "line"))
    if contents:
        out = out.unionByName(files.select(F.lit(5).alias("section"), "path", F.lit(0).alias("ord"), file_block(F.col("path"), F.col("content"), xml).alias("line")))
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
    head, tail = ("<summary>", "</summary>\n</context>") if xml else ("Summary:", "")
    line = F.concat(F.lit(f"{head}\nTotal files: "), F.col("n").cast("string"), F.lit("\nTotal size: "), F.col("b").cast("string"), F.lit(f" bytes\n{tail}"))
    return out.unionByName(total.select(F.lit(7).alias("section"), F.lit("").alias("path"), F.lit(0).alias("ord"), line.alias("line")))


def write(pieces: DataFrame, folder: str) -> None:
    """A document in parts (text files of a folder); put together in the order of their names they are its text. Tasks write
    ranges of the order, and a part is there when its task and the job have committed."""
    pieces.where("line IS NOT NULL").orderBy(*order()).select("line").write.mode("overwrite").text(folder)
