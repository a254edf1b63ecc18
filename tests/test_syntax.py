"""Definitions, calls and imports of all languages, by patterns over token tables."""

import pytest

from corvane.operators import extract, syntax

FILES = {
    "a.py": ("import os\ndef f():\n    return g(os.x())\nclass C: pass\n", "import os|def f 2 3|def C 4 4|call g|call os . x", ""),
    "b.py": ("def broken(", "", ""),
    "a.rs": ("use a::b;\n// fn no() {}\nfn f<'a>(x: &'a str) { let c = '\"'; g(\"h()\"); x.y().z(); w!(q()); } // k()\nfn broken( {\nfn k() { m::n(1); }\ntrait T { fn t(); }", "import a::b|def f 3 3|def k 5 5|call g|call x . y|call x.y() . z|call q|call m . n", "no h w broken t"),
    "a.java": ("import a.b;\nclass A {\n  A() { g(1); }\n  @O public int f(int x) throws E {\n    return g2(\"//\") + this.h(x) + new B(2).c();\n  }\n  abstract int no(int x);\n}", "import a.b|def A 3 3|def f 4 6|call g|call g2|call this . h|call B|call B(2) . c", ""),
    "a.ts": ("import x from \"m//n\";\nconst r = /foo(/;\nconst t = `a ${bar(1)} b(`;\nexport default () => baz();\nclass C { m() { return n(); }\n  o(a: number): string { return p; } }\nconst f = async (a) => {\n  g(a);\n};\nfunction h() { return require('z'); }\nif (q) { s(); }", "import m//n|import z|def m 5 5|def o 6 6|def f 7 9|def h 10 10|call bar|call baz|call n|call g|call require|call s", "foo b if"),
    "a.js": ("import x from \"m//n\"; const u = \"http://x.y\"; foo(); const s = 'bar()'; `baz()`; /* no() */ // gone()\nfunction a() { b( }\nfunction c() { d(); }\nconst e = x => x.f(1)\nvar z = a / b2; g(1) / 2;", "import m//n|def a 2 2|def c 3 3|def e 4 4|call foo|call d|call x . f|call g", "bar baz no gone"),
    "a.rb": ("require 'm'\nclass C < D\n  def a # g()\n    x = 1\n\n    b('i()')\n    d 2\n    s = \"#{e(3)}\"\n    y.each do |q| q.r end\n    return 1 if x\n  end\n  def self.z; end\nend\nt = <<-SQL\n  no(1)\nSQL\nv(2)", "import m|def C 2 13|def a 3 11|def z 12 12|call require|call b|call d|call e|call y . each|call q . r|call v", "i no"),
    "a.hs": ("import Data.Map\nf x = g x\n\nmain = do\n  putStrLn \"a(\" -- b(\n{- c( -}", "import Data.Map|def f 2 2|def main 4 5|call g|call putStrLn", "a b c"),
    "a.go": ("package p\nimport (\n \"a/b\"\n x \"c\"\n)\nfunc (r *R) M() { s := `x()`; t(\"y()\"); r.u.V(1) }\nfunc W() {\n", "import a/b|import c|def M 6 6|def W 7 7|call t|call r.u . V", "x y"),
    "a.lua": ("local m = require(\"m\")\n-- no()\nlocal function f() return g(\"h()\") end --[[ k()\nl() ]]\nfunction A.b(x) if x then y:z(1) end end\nlocal q = function() w() end", "import m|def f 3 3|def b 5 5|def q 6 6|call require|call g|call y . z|call w", "no h k l"),
    "a.c": ("#include \"z.h\"\nint main(void) { p(\"q(\\\"r()\"); /* s() */ return '('; }\nstatic char *u(int a)\n{\n  if (a) { v(a); }\n}\nint no(int x);", "import z.h|def main 2 2|def u 3 6|call p|call v", "q r s if"),
    "a.cpp": ("#include <v>\nint A::f(int x) const { return g(x); }\nint main() { std::x(1); a->b(2); }", "import v|def f 2 2|def main 3 3|call g|call std . x|call a . b", ""),
    "a.kt": ("import a.b\nfun f() { g(\"\"\"h()\"\"\") }\nfun i(x: Int): Int = j(x)\nclass K { fun l() {} }", "import a.b|def f 2 2|def i 3 3|def K 4 4|def l 4 4|call g|call j", "h"),
    "a.nix": ("{ pkgs }: let f = x: g x 1; in import ./y.nix { a = f 2; }", "import ./y.nix|def f 1 1|call g|call f|call import", ""),
    "a.scala": ("import a.b\nobject O { def f(x: Int): Int = {\n g(x)\n }\n def h = i(2) }", "import a.b|def O 2 5|def f 2 4|def h 5 5|call g|call i", ""),
    "a.cs": ("using S.T;\nclass A { public int F(int x) { return G(x).H(); } }", "import S.T|def A 2 2|def F 2 2|call G|call G(x) . H", ""),
    "a.swift": ("import F\nfunc f() { g(1) }\nclass C { func h() -> Int { return i(\"\\(j(2))\") } }", "import F|def f 2 2|def C 3 3|def h 3 3|call g|call i|call j", ""),
    "a.zig": ("const std = @import(\"std\");\npub fn main() void { a.b(1); c(2); }", "import std|def main 2 2|call a . b|call c", ""),
    "a.txt": ("fn f() { g(); }", "", "f g"),
    "null.rs": (None, "", ""),
    "empty.rs": ("", "", ""),
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(p, t, "clash") for p, (t, _, _) in FILES.items()], "path string, content string, name string")
    rows = {p: [] for p in FILES}
    for r in extract.facts(files).collect():
        rows[r.path].append(r)
    return rows


def shown(r) -> str:
    return {"import": f"import {r.name}", "definition": f"def {r.name} {r.start_line} {r.end_line}", "call": f"call {r.qualifier} . {r.name}" if r.qualifier else f"call {r.name}"}[r.what]


@pytest.mark.parametrize("path", FILES)
def test_facts_of_each_language(found, path):
    text, has, lacks = FILES[path]
    got = found[path]
    assert {x for x in has.split("|") if x} == {shown(r) for r in got}
    assert not {r.name for r in got} & set(lacks.split())
    for r in got:
        span = text.encode()[r.start_byte : r.end_byte].decode()
        assert span == r.name if r.what == "call" else r.name in span


def test_spans_count_bytes(spark):
    text = "// é漢\U0001f600\nfn f() {\n é(g());\n}\n"
    d = extract.facts(spark.createDataFrame([("a.rs", text)], "path string, content string")).where("what = 'definition'").first()
    assert text.encode()[d.start_byte : d.end_byte].decode() == "fn f() {\n é(g());\n}" and (d.start_line, d.end_line) == (2, 4)


def test_tokens_cover_a_file_and_long_strings_do_not_fail(spark):
    text = 'let s = "' + 'a\\"' * 200_000 + '"; f(1); /* ' + "* " * 200_000 + "*/ g(2); " + "x" * 100_000
    files = spark.createDataFrame([("a.js", text)], "path string, content string")
    assert {(r.name, r.start_byte) for r in extract.facts(files).collect()} == {("f", text.index("f(1)")), ("g", text.index("g(2)"))}


def test_a_registry_file_is_loaded_at_run_time(spark, tmp_path):
    own = tmp_path / "own.toml"
    own.write_text(
        "[defaults]\nwords = '\\w'\ncomments = ';[^\\n]*+'\nstrings = '\"[^\"\\n]*+\"?'\nkeywords = ['sub', 'end', 'use', 'load']\nchain = ['.']\n"
        "[toy]\nextensions = ['toy']\nblocks = { always = ['sub'], close = ['end'] }\n"
        "definitions = [{ kind = 'function', match = 'sub @name', body = 'end', block_at = 0 }]\n"
        "calls = [{ match = '@name ( )', not_after = ['sub'] }]\nimports = [{ match = '[use|load] only? @path' }, { match = 'use = /v\\d+/ @path' }]\n"
    )
    files = spark.createDataFrame([("x.toy", 'use "a" ; no()\nload only "b"\nuse = v12 "c"\nsub f\n  x.g(1)\nend\nuse = w "d"'), ("y.rs", "fn f() { g(); }")], "path string, content string")
    assert sorted(shown(r) for r in syntax.facts(files, str(own)).collect()) == ["call x . g", "def f 4 6", "import a", "import b", "import c"]
    assert {r.language for r in extract.registry(spark, str(own)).collect()} == {"toy", "python"}
    own.write_text("[toy]\nextensions = ['toy']\nwords = '\\w'\ncomments = ';'\nstrings = '\"'\nkeywords = []\nchain = []\ncalls = [{ match = 'a b' }]\n")
    syntax.load.cache_clear()
    with pytest.raises(ValueError, match="without a name"):
        syntax.facts(files, str(own))


def test_files_are_shuffled_before_they_become_tokens_by_their_bytes(spark):
    text = "fn f() { g(1); }\n" * 2_000
    files = spark.createDataFrame([(f"{i}.rs", text) for i in range(40)], "path string, content string")
    rows = syntax.siblings(syntax.tokens(files))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Exchange hashpartitioning(path") and plan.count("Exchange hashpartitioning") == 1
    assert syntax.dealt(files).rdd.getNumPartitions() == 40 * len(text) // syntax.PART_BYTES + 1
    assert not {"lexer", "quotes", "keywords", "chain", "directive"} & set(rows.columns)


def test_facts_are_those_of_windows_and_tokens_are_not_sorted(spark, monkeypatch):
    from corvane.operators import matching

    rows = [(f"{n}/{p}", t if n == "whole" else t[:i] + t[j:]) for p, (t, _, _) in FILES.items() if t for n, i, j in (("whole", 0, 0), ("cut", len(t) // 2, len(t) // 2 + 9), ("head", 0, 12), ("tail", len(t) - 7, len(t)))]
    rows += [("many.js", "".join(f"function f{i}() {{ g{i}(`${{h(1)}} k(`); }}\n" for i in range(300))), ("blank.go", " \n\t// é\n"), (None, "fn f() {}")]
    files = spark.createDataFrame(rows, "path string, content string").repartition(3)
    want = sorted(map(tuple, syntax.table_facts(files).collect()), key=str)
    for chunk in (100_000, 1):
        monkeypatch.setattr(matching, "CHUNK", chunk)
        assert sorted(map(tuple, syntax.facts(files).collect()), key=str) == want and len(want) > 400
    plan = syntax.facts(files)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "_p ASC" not in plan


def test_what_is_not_closed_ends_with_its_file_and_blank_lines_do_not_indent(spark):
    texts = {"a.lua": "local q = function() w()\nx(1)", "a.hs": "f x = g x\n  \nh y = g y"}
    found = syntax.facts(spark.createDataFrame(list(texts.items()), "path string, content string")).where("what = 'definition'")
    assert sorted((r.name, r.start_byte, r.end_byte, r.end_line) for r in found.collect()) == [("f", 0, 9, 1), ("h", 13, 22, 3), ("q", 6, 29, 2)]


def test_a_path_that_is_there_twice_is_two_files(spark):
    files = spark.createDataFrame([("a.rs", "fn f() { g(1); }"), ("a.rs", "fn h() { k(2);\n}")], "path string, content string")
    assert sorted((r.name, r.start_byte, r.end_line) for r in syntax.facts(files).collect()) == [("f", 0, 1), ("g", 9, 1), ("h", 0, 2), ("k", 9, 1)]


def test_signs_of_levels_in_a_source_are_only_text(spark):
    files = spark.createDataFrame([("a.rb", "module x1 ⟩ ⟨ y end\nz(1)")], "path string, content string")
    assert [(r.name, r.end_byte) for r in syntax.facts(files).where("what = 'definition'").collect()] == [("x1", 23)]
