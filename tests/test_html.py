"""Trees of pages, each insertion mode on its own."""

import time

import pytest

from corvane.operators import html_tree, web


def shown(node) -> str:
    return "".join(c if isinstance(c, str) else f"<{c.tag}>{shown(c)}</{c.tag}>" for c in node.children)


@pytest.mark.parametrize(
    "html, body",
    [
        ("<head><title>T</title><style>p{}</style></head><p>x</p>", "<p>x</p>"),
        ("<title>T</title><meta a><p>x", "<p>x</p>"),
        (" \n <!doctype html><html><head></head>\n x", "x"),
        ("<html><head><script>var a = '<p>';</script></head></html>", ""),
        ("", ""),
        ("x</head>y", "xy"),
        ("<body><title>in</title>x", "<title>in</title>x"),
        ("<p>a<p>b<div>c</div>", "<p>a</p><p>b</p><div>c</div>"),
        ("<p>a<b>b<p>c</b>d", "<p>a<b>b</b></p><p><b>c</b>d</p>"),
        ("a</p>b", "a<p></p>b"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<h1>a<h2>b</h3>c", "<h1>a</h1><h2>b</h2>c"),
        ("<b>1<i>2</b>3</i>4", "<b>1<i>2</i></b><i>3</i>4"),
        ("<a>1<div>2</a>3</div>", "<a>1</a><div><a>2</a>3</div>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<a href=1>x<a href=2>y", "<a>x</a><a>y</a>"),
        ("<table>a<tr><td>b<b>c</table>d", "a<table><tbody><tr><td>b<b>c</b></td></tr></tbody></table>d"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
        ("<table><td>1</table>", "<table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<table><tr><p>x</p><td>1<table><tr><td>2</table></table>", "<p>x</p><table><tbody><tr><td>1<table><tbody><tr><td>2</td></tr></tbody></table></td></tr></tbody></table>"),
        ("<td>1<tr>2", "12"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
        ("<select><option>a<option>b</select>c", "<select><option>a</option><option>b</option></select>c"),
        ("a<br/>b</br>c<img>d", "a<br></br>b<br></br>c<img></img>d"),
        ("x<script>if (a<b) '</p>'</script>y", "x<script>if (a<b) '</p>'</script>y"),
        ("<span>a</div>b</span>c", "<span>ab</span>c"),
        ("a<!-- <p> -->b<", "ab<"),
    ],
)
def test_tree(html, body):
    assert shown(html_tree.body_of(html)) == body


def test_markdown_never_holds_a_head():
    assert web.html_to_markdown("<head><title>T</title><style>p{}</style></head><p>x</p>", "") == "x"
    assert web.html_to_markdown("<title>T</title><h1>A</h1><table><a href='/y'>l</a><tr><td>c</table>", "http://h") == "# A \n[l](http://h/y)c"
    assert web.html_to_markdown("<p>a<ul><li>b<li>c", "") == "a \n\n  - b \n  - c"


def test_long_and_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert web.html_to_markdown("<div>" * 50_000 + "x", "") == "x"
    assert web.html_to_markdown("<p>a<b>b" * 300, "").count("b") == 300
    assert web.html_to_markdown("<tr><td>x</td>" * 20_000, "").count("x") == 20_000
    assert web.html_to_markdown("<table>" + "<tr><td><p>x" * 20_000, "").count("x") == 20_000
    assert time.perf_counter() - began < 20


def test_places_in_a_walk_equal_its_steps(spark):
    links = {"a": "bcb", "b": "ad", "c": "cx", "d": "", "e": "abcd"}
    rows = [(i, f"http://h/{u}", "".join(f'<a href="/{x}">' for x in to)) for i, (u, to) in enumerate(links.items())] + [(9, None, "<a href='http://h/a'>"), (8, "http://h/n", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (0, 1, 4):
        order = sorted((r.start, list(r.steps), r.url or "") for r in web.crawl_order(pages, most).collect())
        want, last, at = [], None, 0
        for start, steps, url in order:
            at = at + 1 if start == last else 0
            want.append((start, at, len(steps), url))
            last = start
        assert sorted((r.start, r.position, r.depth, r.url or "") for r in web.crawl_positions(pages, most).collect()) == sorted(want)
    assert web.crawl_positions(pages.where("false"), 2).count() == 0
