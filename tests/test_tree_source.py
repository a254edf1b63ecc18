"""The tree data source against the walk, and lists of source kinds from a file."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import filters, source_kinds
from corvane.sources import tree
from corvane.sources.tree_source import TreeReader, TreeSource


@pytest.fixture
def root(tmp_path):
    for i in range(40):
        f = tmp_path / ("abc"[i % 3]) / f"d{i % 5}" / (f"f{i}.py" if i % 2 else f"f{i}.log")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * i)
    (tmp_path / "top.md").write_text("# t")
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "a" / ".gitignore").write_text("*.log\n")
    return str(tmp_path)


@pytest.fixture
def load(spark):
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda *roots, **options: spark.read.format("corvane_tree").options(roots=json.dumps(roots), **options).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_rows_equal_the_walk(load, root):
    for options in ({}, {"hidden": True}, {"ignore": False}, {"max_depth": 2}, {"subtrees": 9}):
        want = sorted(tree.walk(root, **{k: v for k, v in options.items() if k != "subtrees"}))
        assert sorted(tuple(r)[:4] for r in load(root, **options).collect()) == want, options
    assert load(root, root).count() == 2 * load(root).count()
    assert [r.path for r in load(root + "/top.md").collect()] == ["top.md"]


def test_a_partition_a_subtree(load, root):
    assert load(root).rdd.getNumPartitions() == 4  # a, b, c and the roots' own files
    assert load(root, subtrees=9).rdd.getNumPartitions() >= 9


def test_filters_reach_the_walk(load, root, capsys):
    found = load(root).where((F.col("size") > 10) & (F.col("depth") <= 3) & F.col("path").startswith("b/") & F.col("name").endswith(".py") & (F.length("name") > 0))
    want = sorted(p for p, _, size, _ in tree.walk(root) if size > 10 and p.startswith("b/") and p.endswith(".py"))
    assert sorted(r.path for r in found.collect()) == want and want
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(depth,3)" in plan and "GreaterThan(size,10)" in plan and "StringStartsWith(path,b/)" in plan


def test_folders_that_no_file_can_come_from_are_not_listed(root, monkeypatch):
    from pyspark.sql.datasource import LessThan, StringStartsWith

    from corvane.sources import tree_source

    reader = TreeReader({"roots": json.dumps([root])})
    assert list(reader.pushFilters([StringStartsWith(("path",), "b/d1"), LessThan(("depth",), 9)])) == []
    seen = []
    listed = tree_source._listed
    monkeypatch.setattr(tree_source, "_listed", lambda *a: (seen.append(a[1]), listed(*a))[1])
    paths = [p for part in reader.partitions() for b in reader.read(part) for p in b.column("path").to_pylist()]
    assert paths and all(p.startswith("b/d1") for p in paths) and set(seen) == {"", "b", "b/d1"}


def test_a_root_that_is_not_there_fails_and_an_empty_one_has_no_rows(load, root, tmp_path_factory):
    with pytest.raises(Exception, match="missing"):
        load(root + "/missing").collect()
    assert load(str(tmp_path_factory.mktemp("empty"))).count() == 0


def test_source_kinds_from_a_file(spark, tmp_path):
    f = tmp_path / "kinds.yml"
    f.write_text("# list\nToy:\n  type: programming\n  color: \"#fff\"\n  extensions:\n  - \".toy\"\n  - .T2 # old\n  aliases:\n  - no\n  filenames:\n  - Toyfile\n  interpreters:\n  - toysh\nOther:\n  extensions:\n    - '.o.x'\n")
    kinds = source_kinds.load(str(f))
    assert kinds == source_kinds.Kinds(["toy", "t2", "o.x"], ["Toyfile"], ["toysh"])
    rows = spark.createDataFrame([("a.toy", None), ("b.py", None), ("x/Toyfile", None), ("c", "#!/bin/toysh"), ("A.T2", None)], "path string, content string")
    assert {r.path for r in rows.where(filters.is_source(F.col("path"), F.col("content"), kinds)).collect()} == {"a.toy", "x/Toyfile", "c", "A.T2"}
