import time

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.functions import paths
from corvane.operators import extract, graph, index, pack, tokens, web
from corvane.plans.adapters import view
from corvane.queries import ORACLE_SQL, QUERIES
from corvane.sources import config, tree
from corvane.streaming.reindex import current, reindex

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())))
    want = sorted(map(str, con.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()))
    assert got == want


def edge_table(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def start(spark, n):
    return spark.createDataFrame([(n,)], "node string")


def names(df):
    return sorted(r["node"] for r in df.collect())


def test_closure_keeps_a_start_on_a_cycle(spark):
    assert names(graph.transitive(edge_table(spark, "ab", "bc", "ca"), start(spark, "a"))) == ["a", "b", "c"]
    assert names(graph.transitive(edge_table(spark, "ab", "bc"), start(spark, "a"))) == ["b", "c"]
    assert names(graph.transitive(edge_table(spark, "ab", "bc"), start(spark, "c"), reverse=True)) == ["a", "b"]


def test_depths(spark):
    got = {r["node"]: r["depth"] for r in graph.to_depth(edge_table(spark, "ab", "ac", "bc", "cd"), start(spark, "a"), 1).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_post_order(spark):
    e = edge_table(spark, "ab", "ac", "bd", "cd", "da")
    order = [r["node"] for r in graph.post_order(spark, e, "a").orderBy("ord").collect()]
    assert order == ["d", "b", "c", "a"]


def test_tree_modes(spark):
    files = spark.createDataFrame([("a/m.rs",), ("b/m.rs",)], "path string")
    assert pack.tree_lines(files).count() == 3
    assert pack.tree_lines(files, faithful=False).count() == 4


def test_markdown():
    html = "<head><title>t</title></head><body><h1>T</h1><p>a <b>b</b><ul><li>x<li>y</ul><a href='/p'>l</a><a>gone</a><pre>c</pre></body>"
    text = web.html_to_markdown(html, "http://h")
    assert text.startswith("# T") and "- x" in text and "- y" in text and "[l](http://h/p)" in text and "gone" not in text and "```" in text
    assert web.resolved("http://h", "mailto:a") is None
    assert web.html_to_markdown("<div>" * 5000 + "x", "") == "x"


def test_crawl_stops_on_cycles(spark):
    pages = spark.createDataFrame([(1, "http://a/x", '<a href="/y">'), (2, "http://a/y", '<a href="/x"><a href="http://b/">')], "page_id long, url string, html string")
    got = {r["start"]: (r["n_urls"], r["n_fetched"]) for r in web.crawl(pages, 3).collect()}
    assert got == {1: (3, 2), 2: (3, 2)}


def test_links_of_real_pages(spark):
    html = """<a href='/s?a=1&amp;b=2'>1</a><A HREF="/up">2</A><a class=x href=plain>3</a><a href="../x">4</a><a href="./y">5</a>
    <a href="//other/z">6</a><a>7</a><a href="mailto:q">8</a><!-- <a href="/no">9</a> --><a href="http://c">10</a>"""
    got = web.page_links(spark.createDataFrame([(1, "http://h/d/e/f", html)], "page_id long, url string, html string")).collect()
    want = ["http://h/s?a=1&b=2", "http://h/up", "http://h/d/e/plain", "http://h/d/x", "http://h/d/e/y", "http://other/z", None, "http://c/"]
    assert [(r["pos"], r["link"]) for r in got] == [(i, x) for i, x in enumerate(want) if x]


def test_extraction_of_python_that_does_not_parse():
    text = "import os, sys as s\nfrom .a import b\n\ndef f(x=(1, 2)):\n    print 'g()'  # h()\n    return os.path.k(é(x))\n\n<<<<<<< HEAD\nclass C(B):\n    async def m(self):\n        pass\n"
    got = list(extract.python_text(text))
    assert {r[:4] for r in got} == {
        ("import", "os", None, None), ("import", "sys", None, "s"), ("import", ".a", None, None), ("definition", "f", "function", None), ("definition", "C", "class", None),
        ("definition", "m", "function", None), ("call", "k", None, "os.path"), ("call", "é", None, None),
    }
    raw = text.encode()
    f = next(r for r in got if r[1] == "f")
    assert raw[f[4] : f[5]].decode() == text[text.index("def f") : text.index("\n\n<<<")] and f[6:] == (4, 6)
    e = next(r for r in got if r[1] == "é")
    assert raw[e[4] : e[5]].decode() == "é"


def test_index_round_trip_and_version(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "path string, size long")
    index.save({"files": df}, str(tmp_path / "i"))
    assert index.load(spark, str(tmp_path / "i"), {"files": df.schema})["files"].collect() == df.collect()
    df.withColumn("_version", F.lit(2)).write.mode("overwrite").parquet(str(tmp_path / "i" / "files"))
    assert index.load(spark, str(tmp_path / "i"), {"files": df.schema, "none": df.schema})["files"].count() == 0


def test_scan(spark, tmp_path):
    for p, t in {"a.py": "x", "b/c.log": "y", "b/.h": "z", "target/o.rs": "w", ".gitignore": "*.log\n", "bad.txt": b"\xff"}.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(t if isinstance(t, bytes) else t.encode())
    m = tree.manifest(spark, [str(tmp_path)])
    assert sorted(r["path"] for r in m.collect()) == ["a.py", "bad.txt", "target/o.rs"]
    assert sorted(r["path"] for r in tree.contents(m).collect()) == ["a.py", "target/o.rs"]
    assert {r[0] for r in tree.walk(str(tmp_path), max_depth=1)} == {"a.py", "bad.txt"}


def test_settings(tmp_path):
    (tmp_path / ".corvane").write_text("max_depth = 3\nexclude = ['x/*']\n")
    s = config.load(config.repository_file(tmp_path), max_size=5)
    assert (s.max_depth, s.max_size, s.exclude[-1], len(s.exclude)) == (3, 5, "x/*", 8)


def test_tokens(spark):
    files = spark.createDataFrame([("a", "x  y"), ("b", None)], "path string, content string")
    assert {r["path"]: r["tokens"] for r in tokens.count(files, tokens.words).collect()} == {"a": 2, "b": 0}


def test_streaming_reindex(spark, tmp_path):
    spark.createDataFrame([("a.py", "def f(): pass")], "path string, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    reindex(stream, str(tmp_path / "facts"), str(tmp_path / "cp")).awaitTermination()
    assert [r["name"] for r in current(spark, str(tmp_path / "facts")).where("what = 'definition'").collect()] == ["f"]
    spark.createDataFrame([("a.py", "def g(): pass"), ("b.py", "x = 1")], "path string, content string").write.mode("append").parquet(str(tmp_path / "in"))
    reindex(stream, str(tmp_path / "facts"), str(tmp_path / "cp")).awaitTermination()
    assert [r["name"] for r in current(spark, str(tmp_path / "facts")).where("what = 'definition'").collect()] == ["g"]


@pytest.fixture
def project(tmp_path, monkeypatch):
    for name in ("XDG_DATA_HOME", "XDG_CONFIG_HOME"):
        monkeypatch.setenv(name, str(tmp_path / name))
    root = tmp_path / "project"
    for p, t in {"a.py": "import b\ndef f():\n    return g()\n", "b.py": "def g():\n    return 1\n", "run": "#!/bin/sh\necho\n", "notes": "plain\n", ".h.py": "x\n"}.items():
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text(t)
    return root


def test_command_scan(spark, project, capsys):
    assert cli.main([str(project), "-o", "files"], spark) == 0
    shown = capsys.readouterr()
    assert [x for x in shown.out.split("\n") if x.startswith("File: ")] == ["File: a.py", "File: b.py", "File: run"]
    assert "Total files: 3" in shown.out and "Total tokens:" in shown.err
    assert cli.main([str(project), "-H", "-x", "--no-tokens", "-f", str(project / "out.txt"), "--only-include", "*.py"], spark) == 0
    text = (project / "out.txt").read_text()
    assert text.startswith('<context name="project">') and '<file path=".h.py">' in text and "run" not in text
    assert cli.main([str(project), "-i", "*.x", "--only-include", "*.y"], spark) == 1
    assert cli.main([str(project / "none")], spark) == 1


def test_command_code_and_index(spark, project, capsys):
    assert cli.main(["index", "status", str(project)], spark) == 0
    assert "No index" in capsys.readouterr().out
    assert cli.main(["code", "a.py:f", "--root", str(project)], spark) == 0
    out = capsys.readouterr().out
    assert out.index("## a.py:f") < out.index("## b.py:g") and "def g():\n    return 1" in out
    assert cli.main(["code", "g", "--callers", "--root", str(project)], spark) == 0
    assert "## a.py:f" in capsys.readouterr().out
    assert cli.main(["code", "nobody", "--root", str(project)], spark) == 1
    (project / "b.py").write_text("def h():\n    return 22\n")
    (project / "c.py").write_text("def i(): pass\n")
    (project / "a.py").unlink()
    assert cli.main(["index", "build", str(project)], spark) == 0
    out = capsys.readouterr().out
    assert "Files:       2" in out and "Definitions: 2" in out and "Calls:       0" in out
    assert cli.main(["index", "clear", str(project)], spark) == 0
    assert cli.counts(spark, cli.index_place(str(project)))["Files"] == 0


@pytest.mark.parametrize(
    "hover, kind", [("let x: i32 = 1", "i32"), ("fn f()\nconst y: &str", "&str"), ("fn f()", "fn f()"), (" \n", None), ("def g\nlet z", "let z"), (None, None)]
)
def test_hover_type(spark, hover, kind):
    df = spark.createDataFrame([(hover,)], "h string")
    assert df.select(paths.hover_type(F.col("h"))).first()[0] == kind


def test_find_nodes(spark):
    defs = spark.createDataFrame([("b", "f", 0, 1), ("a", "f", 5, 6)], "file string, name string, start_byte long, end_byte long")
    targets = spark.createDataFrame([("b", "f"), (None, "f"), ("b", "g"), (None, "g")], "file string, func string")
    assert {(r["file"], r["func"]): r["node"] for r in graph.find_nodes(targets, defs).collect()} == {("b", "f"): "b:f", (None, "f"): "a:f", ("b", "g"): None, (None, "g"): None}


def test_excludes_and_settings_files(spark, project, tmp_path, monkeypatch):
    assert config.exclude_pattern(str(project / "a.py"), project) == "a.py" and config.exclude_pattern("*.md", project) == "*.md"
    assert config.exclude_pattern(str(tmp_path), project) is None and config.exclude_pattern("/no/such", project) == "/no/such"
    assert {r["path"] for r in cli.scan(spark, [str(project)], config.Settings(exclude=[str(project / "a.py"), str(tmp_path)])).collect()} == {"b.py", "run"}
    config.save(tmp_path / "x" / "s.toml", {"exclude": ['a"b', "ü\\"], "max_size": 5, "hidden": True})
    s = config.load(tmp_path / "x" / "s.toml")
    assert s.max_size == 5 and s.hidden and {'a"b', "ü\\"} <= set(s.exclude)
    assert config.load(config.first_run(tmp_path / "new" / "c.toml")) == config.Settings() and (tmp_path / "new" / "c.toml").exists()
    assert cli.first_url(["a", "https://x/y", "git@h:z.git"]) == "https://x/y" and cli.first_url(["a"]) is None
    assert cli.main(["https://x/y"], spark) == 1


def test_shebang_with_an_unknown_extension(spark, tmp_path):
    for name, text in {"a.zzz": "#!/usr/bin/env python3\n", "b.zzz": "plain\n"}.items():
        (tmp_path / name).write_text(text)
    assert [r["path"] for r in cli.scan(spark, [str(tmp_path)], config.Settings()).collect()] == ["a.zzz"]


def test_index_survives_a_save_that_was_broken_off(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "path string, size long")
    index.save({"files": df}, str(tmp_path / "i"))
    (tmp_path / "i").rename(tmp_path / "i.old")
    assert index.load(spark, str(tmp_path / "i"), {"files": df.schema})["files"].collect() == df.collect()
    index.save({"files": df.union(df)}, str(tmp_path / "i"))
    assert index.load(spark, str(tmp_path / "i"), {"files": df.schema})["files"].count() == 2 and not (tmp_path / "i.old").exists()


def test_project_names_are_escaped(spark):
    files = spark.createDataFrame([("a.py", "x", 1)], "path string, content string, size long")
    assert pack.document(files, project="a<b>&\"'").where("section = 0").first()["line"] == '<context name="a&lt;b&gt;&amp;&quot;&apos;">'


def test_plans_of_traversals_grow_with_the_depth_only(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "n0")], "src string, dst string")
    start = spark.createDataFrame([("n0",)], "node string")
    size = [len(graph.to_depth(edges, start, d)._jdf.queryExecution().optimizedPlan().toString()) for d in (2, 4, 8)]
    assert size[2] < 8 * size[0]
    assert {r["node"]: r["depth"] for r in graph.to_depth(edges, start, 30).collect()} == {f"n{i}": i for i in range(13)}
    assert graph.to_depth(edges, start, 0).collect() == [("n0", 0)]


def test_calls_find_definitions_across_bins(spark):
    defs = spark.createDataFrame([("a", "wide", 0, 10 * graph.BIN), ("a", "in", graph.BIN - 5, graph.BIN + 5), ("a", "empty", 50, 50), ("b", "wide", 0, 3)], "file string, name string, start_byte long, end_byte long")
    calls = spark.createDataFrame([("a", p, "x", None) for p in (50, graph.BIN - 1, graph.BIN, graph.BIN + 5, 10 * graph.BIN, None)], "file string, pos long, callee string, qualifier string")
    got = {r["pos"]: r["caller"] for r in graph.enclosing_definition(calls, defs).collect()}
    assert got == {50: "wide", graph.BIN - 1: "in", graph.BIN: "in", graph.BIN + 5: "wide", 10 * graph.BIN: None, None: None}
    assert graph.enclosing_definition(calls.limit(0), defs).count() == 0


def test_walks_of_tasks_and_rules_from_above(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "conf"))
    texts = {"conf/git/ignore": "*.tmp\n", "repo/.git/info/exclude": "secret\n", "repo/.gitignore": "/sub/gone.py\n*.log\n!keep.log\n", ".ignore": "*.bak\n", ".gitignore": "*.py\n"}
    texts |= {f"repo/sub/{n}": "x" for n in ("gone.py", "a.py", "b.log", "keep.log", "c.tmp", "d.bak", "secret", "deep/gone.py", "deep/e/f.py", "deep/g.log")}
    for p, t in texts.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    root = str(tmp_path / "repo" / "sub")
    want = ["a.py", "deep/e/f.py", "deep/gone.py", "keep.log"]
    assert sorted(r[0] for r in tree.walk(root)) == want
    monkeypatch.setattr(tree, "FOLDERS", 1)
    for roots in ([root], [root, str(tmp_path / "repo" / "sub" / "a.py")]):
        got = tree.manifest(spark, roots)
        assert sorted(r["path"] for r in got.collect()) == sorted(want + ["a.py"] * (len(roots) - 1))
    assert sorted(r["path"] for r in tree.manifest(spark, [root], ignore=False).collect()) == sorted(n for n in (p.removeprefix("repo/sub/") for p in texts if p.startswith("repo/sub/")))
    assert sorted(r["path"] for r in tree.contents(tree.manifest(spark, [root])).collect()) == want


def test_model_tokens_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["path"]: r["content"] for r in view(spark, SF, "files").collect()}
    got = {r["path"]: r["tokens"] for r in QUERIES["model_tokens"](spark, SF).collect()}
    assert got == {p: len(t.encode(x or "", add_special_tokens=False).ids) for p, x in texts.items()}


def test_calls_are_the_same_by_numbers_and_are_shuffled_once_for_their_definitions(spark):
    from corvane.plans import adapters

    sf = "/root/testdata/sf0.001"
    calls, defs = (adapters.view(spark, sf, n) for n in ("calls", "defs"))
    odd = spark.createDataFrame([(1, 41, 5, 1), (10, 41, 5, 1), (10, 41, 5, 1), (1, 41, 5, 3), (1, 41, 5, 6), (1, None, 5, 1), (None, 41, 5, 1), (10, 41, None, 1), (1, 41, None, 2), (1, 41, 5, None)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    for rows in (odd, spark.read.parquet(f"{sf}/lineitem.parquet")):
        one, other = (spark.sql(q.replace("FROM lineitem", "FROM {t}"), t=rows) for q in (adapters.CALLS, adapters.CALLS_BY_NUMBER))
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count()
    flat = spark.createDataFrame([("a", 1, "f", None)], "file string, pos long, callee string, qualifier string")
    plan = graph.enclosing_definition(flat, defs.limit(5).hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "src string, dst string")
    plan = graph.adjacency(edges)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, plan.collect())) == [("a", 2, 1), ("b", 1, 1), ("c", 0, 1)] and calls.count()


def test_adjacency_has_the_sets_both_ways_of_all_nodes(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "b"), ("b", "b"), ("d", "d"), ("b", "a"), ("x", None), (None, "y")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("alone",), ("alone",), ("d",)], "node string")
    want = {"a": (["b", "c"], ["b"]), "b": (["a"], ["a"]), "c": ([], ["a"])}
    got = graph.adjacency_sets(edges, nodes)
    assert {r["node"]: (r["callees"], r["callers"]) for r in got.collect()} == want | {"alone": ([], []), "d": ([], [])} and got.count() == 5
    assert {r["node"] for r in graph.adjacency_sets(edges).collect()} == set(want)
    sf = "/root/testdata/sf0.001"
    rows = {r["node"]: r for r in QUERIES["adjacency"](spark, sf).collect()}
    near = {n: (set(), set()) for n in rows}
    for e in QUERIES["call_edges"](spark, sf).collect():
        near[e["src"]][0].add(e["dst"])
        near[e["dst"]][1].add(e["src"])
    assert near == {n: (set(r["callees"].split(",")) - {""}, set(r["callers"].split(",")) - {""}) for n, r in rows.items()} and any(r["n_callees"] for r in rows.values())
    assert all((r["n_callees"], r["n_callers"]) == tuple(map(len, near[n])) for n, r in rows.items())
    assert QUERIES["graph_counts"](spark, sf).first()["n_nodes"] == len(rows)
