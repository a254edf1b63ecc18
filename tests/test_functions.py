import pytest
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.operators import filters as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "name"),
    [("#!/usr/bin/python\n", "python"), ("#!/usr/bin/env -S node -x", "node"), ("#!/usr/bin/env A=1 ruby", "ruby"), ("#!/opt/perl5.30.1", "perl5"), ('#!/bin/sh\nexec lua "$0"', "lua"), ("none", None), ("#!/", None), ("", None)],
)
def test_interpreter(spark, text, name):
    assert one(spark, text, P.interpreter) == name


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.md", "a/b.md", True), ("a/*.md", "a/b/c.md", False), ("**/target/**", "x/target/y/z", True), ("target/*", "target/a/b", False), ("!x?.rs", "q/xy.rs", True), ("a/**/b", "a/b", True), ("[ab].c", "z/a.c", True), ("*.{ts,js}", "m.js", True)],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, path, lambda c: S.matches_any(c, [pattern])) is hit


@pytest.mark.parametrize(
    ("module", "ext", "first"),
    [("crate::a::b", "rs", "a/b.rs"), ("a.b", "py", "a/b.py"), ("../m/x", "ts", "m/x.ts"), ("a.b.C", "java", "a/b/C.java"), ("a.b._", "scala", "a/b.scala"), ("x.h", "c", "x.h"), ("std", "zig", "std.zig"), ("github.com/a/b/c/d", "go", "c/d")],
)
def test_import_candidates(spark, module, ext, first):
    assert one(spark, module, lambda c: P.import_candidates(c, F.lit(ext)))[0] == first


def test_relative_python_imports_have_none(spark):
    assert one(spark, ".x", lambda c: P.import_candidates(c, F.lit("py"))) == []


def test_include_rules():
    with pytest.raises(ValueError):
        S.should_process(F.lit("a"), F.lit(1), include=["*.a"], only_include=["*.b"])


@pytest.mark.parametrize("path", ["a.vue", "a.dart", "a.pl", "a.R", "a.jl", "a.ex", "a.ps1", "a.proto", "b/go.mod"])
def test_common_kinds_are_source(spark, path):
    assert one(spark, path, S.is_source) is True


@pytest.mark.parametrize(
    "path, shown",
    [("a/b/c", "a/b/c"), ("aaaaaaaaaa/b/c.rs", ".../b/c.rs"), ("aaaaaaaaaaaaaaaaaa/c.rs", "aaaaaaaaaaaaaaaaaa/c.rs"), ("/aaaaaaaaaaaaaaaa", "/aaaaaaaaaaaaaaaa"), ("/aaaaaaaaaaaaa/é", ".../aaaaaaaaaaaaa/é"), ("aa//bbbbbbb/./ccc", ".../bbbbbbb/ccc"), (None, None)],
)
def test_shortened(spark, path, shown):
    assert spark.createDataFrame([(path,)], "p string").select(P.shortened(F.col("p"), 36)).first()[0] == shown
