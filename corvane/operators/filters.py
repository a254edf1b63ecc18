"""Scan predicates as Columns; globs are compiled to regular expressions on the driver, once a plan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.paths import base_name, extension, interpreter
from corvane.operators import source_kinds

MAX_SIZE, MAX_DEPTH = 10 * 1024 * 1024, 20
# Patterns excluded unless others are configured.
DEFAULT_EXCLUDES = ["**/.git/**", "**/.svn/**", "**/.hg/**", "**/target/**", "**/node_modules/**", "**/dist/**", "**/build/**"]
# Our own list of source kinds.
SOURCE_EXTENSIONS, SOURCE_NAMES, INTERPRETERS = (list(dict.fromkeys(x)) for x in (source_kinds.EXTENSIONS, source_kinds.NAMES, source_kinds.INTERPRETERS))
OWN_KINDS = source_kinds.Kinds(SOURCE_EXTENSIONS, SOURCE_NAMES, INTERPRETERS)


def among(value: Column, names: Sequence[str]) -> Column:
    """Whether value is one of the names: one literal, folded into an array, however many there are."""
    return F.array_contains(F.split(F.lit("\n".join(names)), "\n"), value) if names else F.lit(False)


def glob_regex(pattern: str) -> str:
    """A gitignore-like pattern for whole paths: * stays within a component, ** spans them, and a pattern
    without a slash is matched against the name."""
    p = pattern.removeprefix("!")
    anywhere = "/" not in p.rstrip("/")
    p, out, i = p.lstrip("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p[i:] == "**" and (i == 0 or p[i - 1] == "/"):
            out, i = out + ".+" if i else out + ".*", len(p)
        elif p[i] == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            out += "[^/]*"
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            inside = p[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", j + 1
        elif p[i] == "{" and "}" in p[i:]:
            j = p.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in p[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return "^" + ("(?:.*/)?" if anywhere else "") + out + "$"


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """One alternation for all patterns."""
    return path.rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(False)


def is_source(path: Column, content: Column | None = None, kinds: source_kinds.Kinds = OWN_KINDS) -> Column:
    """By name, else by the extension in lower case, else, also with an unknown extension, by the script's interpreter if
    content is given. kinds: our own list, or one that source_kinds.load() reads."""
    known = among(base_name(path), kinds.names) | among(F.lower(extension(path)), kinds.extensions)
    if content is None:
        return known
    return known | F.coalesce(among(interpreter(content), kinds.interpreters), F.lit(False))


def should_process(path: Column, size: Column, content: Column | None = None, *, max_size: int = MAX_SIZE, include: Sequence[str] = (), only_include: Sequence[str] = (), exclude: Sequence[str] = (), kinds: source_kinds.Kinds = OWN_KINDS) -> Column:
    """Small enough; chosen by only_include instead of, or by include besides, source detection; not excluded."""
    if include and only_include:
        raise ValueError("include and only_include exclude each other")
    chosen = matches_any(path, only_include) if only_include else is_source(path, content, kinds) | matches_any(path, include)
    return (size <= max_size) & chosen & ~matches_any(path, exclude)


def indexable(path: Column, kinds: source_kinds.Kinds = OWN_KINDS) -> Column:
    """What the code index takes: source files with an extension, of any size and depth."""
    return (extension(path) != "") & is_source(path, kinds=kinds)
