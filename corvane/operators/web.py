"""Pages to Markdown, their links, and bounded crawls over a table of pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import checkpointed
from corvane.operators.html_tree import body_of


def absolute(base: str, href: str) -> str | None:
    """The absolute http(s) URL of a link, or None; letters stay as they are written, as in the URLs of a table of pages."""
    try:
        url = urljoin(base, href.strip().replace("\\", "/"))
        parts = urlsplit(url)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    return url if parts.path else url.replace(parts.netloc, parts.netloc + "/", 1)


def resolved(base: str, href: str) -> str | None:
    """The absolute http(s) URL of a link with escapes, or None."""
    url = absolute(base, href)
    return url and quote(url, safe="%/:=&?~#+!$,;'@()*[]|-._")


def html_to_markdown(html: str, base: str) -> str:
    """Markdown of a page's body, the tree of which is built as browsers do (html_tree.py); a head's text is never in it."""
    body = body_of(html or "")
    out: list[str] = []
    # (node, list depth) to render, or text to append; a stack, so that deep pages don't exhaust recursion
    work: list = [(c, 0) for c in reversed(body.children)]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        node, depth = item
        if isinstance(node, str):
            if text := node.strip():
                out.append(text + " ")
            continue
        tag, attrs, children = node.tag, node.attrs, node.children
        inside = lambda d, kids=children: [(c, d) for c in reversed(kids)]
        if tag == "br":
            out.append("\n")
        elif tag == "p":
            work += ["\n", *inside(depth + 1), "\n\n"]
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            work += ["\n", *inside(0), "\n\n" + "#" * int(tag[1]) + " "]
        elif tag in ("ul", "ol"):
            work += ["\n", *inside(depth + 1), "\n"]
        elif tag == "li":
            work += [*inside(depth + 1), "\n" + "  " * depth + "- "]
        elif tag == "a":
            url = resolved(base, attrs["href"]) if attrs.get("href") is not None else None
            if url:
                words, stack = [], list(reversed(children))
                while stack:
                    c = stack.pop()
                    if isinstance(c, str):
                        words.append(c)
                    else:
                        stack += list(reversed(c.children))
                out.append(f"[{''.join(words).strip() or url}]({url})")
        elif tag in ("pre", "code"):
            work += ["\n```\n", *inside(depth), "\n```\n"]
        elif tag == "blockquote":
            work += ["\n", *inside(depth), "\n> "]
        else:
            work += inside(depth)
    return "".join(out).replace("\n" * 4, "\n\n").replace("\n" * 3, "\n\n").strip()


class _Anchors(HTMLParser):
    """Targets of the anchors, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = next((v or "" for k, v in attrs if k == "href"), None) if tag == "a" else None
        if href is not None:
            self.found.append(href)


def hrefs(html: str) -> list[str]:
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    return parser.found


def markdown(pages: DataFrame) -> DataFrame:
    """page_id and markdown for pages (page_id, url, html); parsed in Arrow batches. A null page is empty; rows that repeat
    repeat; other columns are ignored."""

    def run(batches):
        for b in batches:
            text = [html_to_markdown(h or "", u or "") for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(text, pa.string())], names=["page_id", "markdown"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, markdown string")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, link: anchors of the parsed page in document order, their targets made absolute;
    pos counts the anchors with a target, and those that are no http(s) link give no row; repeats stay."""

    def run(batches):
        for b in batches:
            got = [(i, pos, link) for i, (h, u) in enumerate(zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True)) for pos, href in enumerate(hrefs(h or "")) if (link := absolute(u or "", href))]
            at, pos, link = zip(*got, strict=True) if got else ((), (), ())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id").take(rows), b.column("url").take(rows), pa.array(pos, pa.int32()), pa.array(link, pa.string())], names=["page_id", "url", "pos", "link"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, pos int, link string")


def crawl(pages: DataFrame, most: int) -> DataFrame:
    """start, n_urls, n_fetched: URLs met by a crawl from each page of at most `most` links, and those that are in the table.

    A null page has no links, an empty table no starts, and pages that share a URL share their links.
    Frontiers are distinct (start, url), so cycles end; a URL that isn't in the table has no links. The links and each
    round's frontier are checkpointed, so pages are parsed once and plans don't grow with the rounds."""
    links = page_links(pages).select(F.col("url").alias("_from"), "link").distinct()
    links = checkpointed(links) if most > 1 else links
    seen = pages.select(F.col("page_id").alias("start"), "url")
    frontier = seen
    for k in range(most):
        frontier = frontier.join(links, frontier["url"] == links["_from"]).select("start", F.col("link").alias("url")).distinct().join(seen, ["start", "url"], "left_anti")
        frontier = checkpointed(frontier) if k < most - 1 else frontier
        seen = seen.union(frontier)
    known = pages.select("url", F.lit(True).alias("_in")).distinct()
    met = seen.distinct().join(known, "url", "left")
    return met.groupBy("start").agg(F.count(F.lit(1)).alias("n_urls"), F.count("_in").alias("n_fetched"))


def crawl_order(pages: DataFrame, most: int) -> DataFrame:
    """start, steps, url: every page met by following at most `most` links from each page, in the order of a depth-first walk.

    steps are the places of the links followed; ordered by start and steps they give the walk. Of a page's links to
    one URL the first counts; pages reached on several ways come again, URLs that aren't in the table are passed over."""
    links = page_links(pages).groupBy(F.col("url").alias("_from"), "link").agg(F.min("pos").alias("_pos"))
    links = links.join(pages.select(F.col("url").alias("link")).distinct(), "link", "left_semi")
    links = checkpointed(links) if most > 1 else links
    step = pages.select(F.col("page_id").alias("start"), F.array().cast("array<int>").alias("steps"), "url")
    out = step
    for _ in range(most):
        step = step.join(links, F.col("url") == F.col("_from")).select("start", F.concat("steps", F.array("_pos")).alias("steps"), F.col("link").alias("url"))
        out = out.union(step)
    return out


def crawl_positions(pages: DataFrame, most: int) -> DataFrame:
    """start, position, depth, url: the rows of crawl_order(), each with its place in its start's walk, from 0.

    How many pages a walk meets from a page with so many links left is the page and the sums of its links with one left less; a
    page's place is its parent's and what the links before it meet. So rows carry numbers, not the ways to them, and only
    (page, links left) and its links are joined. Null URLs lead nowhere but are places; a table without pages has no rows."""
    links = page_links(pages).groupBy(F.col("url").alias("_from"), "link").agg(F.min("pos").alias("_pos"))
    urls = pages.select(F.col("url").alias("link")).distinct()
    links = checkpointed(links.join(urls, "link", "left_semi"))
    met = urls.select("link", F.lit(1).cast("long").alias("_n"))  # what a walk with no link left meets
    before = Window.partitionBy("_from").orderBy("_pos", "link").rowsBetween(Window.unboundedPreceding, -1)
    steps = []
    for _ in range(most):
        sized = links.join(met, "link")
        steps.append(checkpointed(sized.select("_from", "link", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))))
        below = sized.groupBy(F.col("_from").alias("link")).agg(F.sum("_n").alias("_below"))
        met = checkpointed(urls.join(below, "link", "left").select("link", (F.coalesce("_below", F.lit(0)) + 1).alias("_n")))
    step = pages.select(F.col("page_id").alias("start"), F.lit(0).cast("long").alias("position"), "url")
    out = step.withColumn("depth", F.lit(0))
    for depth, link in enumerate(reversed(steps), 1):
        step = step.join(link, F.col("url") == F.col("_from")).select("start", (F.col("position") + 1 + F.col("_before")).alias("position"), F.col("link").alias("url"))
        out = out.unionByName(step.withColumn("depth", F.lit(depth)))
    return out.select("start", "position", "depth", "url")
