"""Ignore files over tables: their rules meet files by the folders that both have in common.

A table of trees has its ignore files as rows. Each line becomes a rule of its folder; each folder and file of the table meets
the rules of the folders above it by a join on the folder, and the last rule that matches it decides: deeper folders after
shallower ones, later lines after earlier ones. What lies below a folder that is excluded so is closed, whatever its own rules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _prefixes(path: Column, least: int = 1) -> Column:
    """The folders above a path, outermost first, and the path itself; with least = 0 the top, '', too."""
    p = _parts(path)
    return F.transform(F.sequence(F.lit(least), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))


def glob_form(pattern: Column) -> Column:
    """Regular expression of an ignore pattern without its '!' and last '/', for paths below the folder of its rule.

    A pattern without a slash is matched at any depth, ** spans folders, * and ? stay in a component, [!a] is anything but a."""
    anywhere = ~F.contains(pattern, F.lit("/"))
    p = F.regexp_replace(F.regexp_replace(pattern, "^/", ""), r"([.+^$(){}|])", r"\\$1")
    # marks stand for what ** becomes until single stars are replaced
    p = F.regexp_replace(F.regexp_replace(p, r"(?<![^/])\*\*/", "\u0001"), r"(?<![^/])\*\*$", "\u0002")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\[!", "[^"), r"\*+", "[^/]*"), r"(?<!\\)\?", "[^/]")
    p = F.replace(F.replace(p, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".+"))
    return F.concat(F.lit("^"), F.when(anywhere, "(?:.*/)?").otherwise(""), p, F.lit("$"))


def rules(ignore_files: DataFrame) -> DataFrame:
    """folder, ord, keeps, folders_only, form of every rule of ignore files (path, content): empty lines and comments are none, a
    '\\' keeps a first '#' or '!'; null contents have none."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    lines = ignore_files.select(folder.alias("folder"), "path", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    text = F.regexp_replace("text", r"(?<!\\)[ \t]+$", "")
    lines = lines.withColumn("text", text).where((F.col("text") != "") & ~F.startswith("text", F.lit("#")))
    keeps = F.startswith("text", F.lit("!"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^!", ""), r"^\\(?=[#!])", ""), "/$", "")
    # of several ignore files in a folder the later by name counts more
    return lines.where(bare != "").select("folder", F.struct("path", "line").alias("ord"), keeps.alias("keeps"), F.endswith("text", F.lit("/")).alias("folders_only"), glob_form(bare).alias("form"))


def verdicts(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """node, keeps: each file or folder of files (path) that a rule matches, and what the last such rule says."""
    nodes = files.where("path IS NOT NULL").select(F.posexplode(_prefixes(F.col("path"))).alias("_i", "node"), (F.size(_parts(F.col("path"))) - 1).alias("_n"))
    nodes = nodes.groupBy("node").agg(F.max(F.col("_i") < F.col("_n")).alias("is_folder"))
    above = nodes.select("node", "is_folder", F.posexplode(F.slice(_prefixes(F.col("node"), 0), F.lit(1), F.size(_parts(F.col("node"))))).alias("depth", "folder"))
    below = F.when(F.col("folder") == "", F.col("node")).otherwise(F.substring(F.col("node"), F.length("folder") + 2, F.length("node")))
    met = above.join(rules(ignore_files), "folder").where((F.col("is_folder") | ~F.col("folders_only")) & F.regexp_like(below, F.col("form")))
    return met.groupBy("node").agg(F.max_by("keeps", F.struct("depth", "ord")).alias("keeps"))


def kept(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """The rows of files (path, and any other columns) that no ignore file (path, content) excludes.

    Paths of both are relative to one top and use '/'. Null paths are kept; paths that repeat are treated alike; without
    ignore files all rows are kept."""
    closed = verdicts(files, ignore_files).where("NOT keeps").select(F.col("node").alias("_node"))
    held = files.where("path IS NOT NULL").select(F.col("path").alias("_path"), F.explode(_prefixes(F.col("path"))).alias("_node"))
    gone = held.join(closed, "_node", "left_semi").select("_path").distinct()
    return files.join(gone, files["path"] == F.col("_path"), "left_anti")
