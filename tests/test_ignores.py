"""Ignore rules over tables, against the walk of a tree and by hand."""

import random

import pytest

from corvane.operators import ignores
from corvane.sources import tree

CASES = [
    ({".gitignore": "*.log\n!keep.log\nbuild/\n/top\n"}, "a.log keep.log x/keep.log build/a x/build/b top x/top buildx/a", "keep.log x/keep.log x/top buildx/a"),
    ({".gitignore": "a/**/z\n**/q\nb/**\n"}, "a/z a/x/z a/x/y/z q c/q b/x b/c/d bb", "bb"),
    ({".gitignore": "dir/\n", "dir/.gitignore": "!x\n"}, "dir/x dir/y dir.c", "dir.c"),
    ({".gitignore": "*\n!*/\n!*.py\n"}, "a.py b.c d/e.py d/f", "a.py d/e.py"),
    ({"s/.gitignore": "/only\n*.t[!x]\nw?\n# no\n\\#yes\n  \n"}, "only s/only s/d/only a.ty s/a.ty s/a.tx s/wz s/w s/#yes", "only s/d/only a.ty s/a.tx s/w"),
    ({".gitignore": "f\n", "d/.gitignore": "!f\n", "d/.ignore": "f\n"}, "f d/f e/f", ""),
    ({}, "a b/c", "a b/c"),
]


@pytest.mark.parametrize("given, paths, left", CASES)
def test_rules(spark, given, paths, left):
    files = spark.createDataFrame([(p, 1) for p in paths.split()], "path string, folder int")
    rules = spark.createDataFrame(list(given.items()), "path string, content string")
    assert sorted(r.path for r in ignores.kept(files, rules).collect()) == sorted(left.split())


def test_odd_rows(spark):
    files = spark.createDataFrame([("a.log",), ("a.log",), (None,), ("b",)], "path string")
    rules = spark.createDataFrame([(".gitignore", None), ("x/.gitignore", "*"), (".ignore", "*.log")], "path string, content string")
    assert sorted(str(r.path) for r in ignores.kept(files, rules).collect()) == ["None", "b"]
    assert ignores.kept(files.where("false"), rules).count() == 0


def test_the_join_equals_the_walk(spark, tmp_path):
    r = random.Random(2)
    names = ["a", "b", "c.log", "d.py", "e"]
    paths = sorted({"/".join(r.choice(names[:2]) for _ in range(r.randint(0, 3))) + "/" + r.choice(names[2:]) for _ in range(40)})
    paths = [p.lstrip("/") for p in paths]
    given = {"": "*.log\n!/c.log\na/b/\n", "a/": "!c.log\nd.py\n", "b/": "/a\n!e\n", "b/b/": "**/d.py\ne\n"}
    for p in paths:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    given = {f: t for f, t in given.items() if (tmp_path / f).is_dir()}
    for folder, text in given.items():
        (tmp_path / folder / ".ignore").write_text(text)
    want = sorted(r.path for r in tree.manifest(spark, [str(tmp_path)]).collect())
    rules = spark.createDataFrame([(f"{f}.ignore", t) for f, t in given.items()], "path string, content string")
    assert sorted(r.path for r in ignores.kept(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()) == want
