"""The element tree of a page as browsers build it: implied head and body, tags closed by others, formatting that is misnested
or goes on in the next block, and content that a table pushes out. Parsing never fails; work is linear but for misnesting."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# Fixed values of the HTML standard: which elements are void, stand in a head, end a paragraph, bound a scope, carry formatting.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
HEAD = frozenset("base link meta title style script template noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre listing search section summary table ul xmp plaintext".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SCOPES = frozenset("html body table td th caption marquee object applet template".split())
SPECIAL = CLOSES_P | SCOPES | VOID | HEAD | frozenset("button iframe noembed select textarea tbody tfoot thead tr colgroup".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
IMPLIED = frozenset(("dd", "dt", "li", "optgroup", "option", "p", "rp", "rt"))
TABLE_PARTS = frozenset(("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"))
PUSHES_OUT = frozenset(("table", "tbody", "tfoot", "thead", "tr"))
ROWS, CELLS = ("tbody", "thead", "tfoot"), ("td", "th")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def add(self, child, before: Node | None = None) -> None:
        if isinstance(child, Node):
            if child.parent:
                child.parent.children.remove(child)
            child.parent = self
        at = self.children.index(before) if before is not None else len(self.children)
        if isinstance(child, str) and at and isinstance(self.children[at - 1], str):
            self.children[at - 1] += child
        else:
            self.children.insert(at, child)


class Builder(HTMLParser):
    """Feed a page, close, and take `head` and `body`."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.head, self.body = Node("head"), Node("body")
        self.open: list[Node] = [self.head]
        self.count: Counter[str] = Counter()
        self.active: list[Node | None] = []  # formatting elements; None at the start of a cell or the like
        self.in_body = False

    # --- the stack of open elements

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.tag] += 1

    def pop(self) -> Node:
        node = self.open.pop()
        self.count[node.tag] -= 1
        return node

    def pop_to(self, *tags: str) -> None:
        while len(self.open) > 1 and self.pop().tag not in tags:
            pass

    def pop_above(self, *tags: str) -> None:
        while len(self.open) > 1 and self.open[-1].tag not in tags:
            self.pop()

    def within(self, tags, bounds=SCOPES) -> bool:
        """Whether one of the tags is open and nothing that bounds a scope is open inside it."""
        if not any(self.count[t] for t in tags):
            return False
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in bounds:
                return False
        return False

    def imply(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED and self.open[-1].tag != but:
            self.pop()

    def close_p(self) -> None:
        if self.count["p"] and self.within(("p",), SCOPES | {"button"}):
            self.imply("p")
            self.pop_to("p")

    # --- insertion

    def place(self, what, structural: bool = False) -> None:
        """Into the current element; what a table can't hold goes in front of it."""
        here = self.open[-1]
        if not structural and here.tag in PUSHES_OUT and self.in_body:
            table = next((n for n in reversed(self.open) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                table.parent.add(what, table)
                return
        here.add(what)

    def enter(self, tag: str, attrs: dict, structural: bool = False) -> Node:
        node = Node(tag, attrs)
        self.place(node, structural)
        self.push(node)
        return node

    def to_body(self) -> None:
        if not self.in_body:
            self.in_body, self.open, self.count = True, [self.body], Counter()

    def reopen(self) -> None:
        """Formatting that was open when its block ended is open again in the next."""
        if not self.active or self.active[-1] is None or self.active[-1] in self.open:
            return
        i = len(self.active)
        while i and self.active[i - 1] is not None and self.active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self.enter(self.active[k].tag, self.active[k].attrs)

    def forget(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # --- tags

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body", "frame", "frameset"):
            if tag == "body":
                self.to_body()
            return
        if not self.in_body:
            if tag in HEAD or tag == "noscript":
                self.pop_above("head")
                self.enter(tag, attrs)
                if tag in VOID:
                    self.pop()
                return
            self.to_body()
        if tag in TABLE_PARTS:
            self.table_part(tag, attrs)
            return
        if tag in HEAD:
            self.enter(tag, attrs)
        elif tag in CLOSES_P:
            if tag in ("li", "dd", "dt"):
                self.close_item((tag,) if tag == "li" else ("dd", "dt"))
            self.close_p()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.pop()
            self.enter(tag, attrs)
        elif tag in FORMATTING:
            if tag in ("a", "nobr") and any(n is not None and n.tag == tag for n in self.since_mark()):
                self.handle_endtag(tag)
                for n in [n for n in self.since_mark() if n.tag == tag]:
                    self.active.remove(n)
                    if n in self.open:
                        self.open.remove(n)
                        self.count[tag] -= 1
            self.reopen()
            node = self.enter(tag, attrs)
            same = [n for n in self.since_mark() if n.tag == tag and n.attrs == attrs]
            if len(same) > 2:  # no more than three alike
                self.active.remove(same[0])
            self.active.append(node)
        else:
            if tag in ("option", "optgroup") and self.open[-1].tag == "option":
                self.pop()
            if tag == "button" and self.within(("button",)):
                self.imply()
                self.pop_to("button")
            self.reopen()
            self.enter(tag, attrs)
            if tag in ("object", "applet", "marquee"):
                self.active.append(None)
        if tag in VOID:
            self.pop()

    handle_startendtag = handle_starttag

    def since_mark(self) -> list[Node]:
        out = []
        for n in reversed(self.active):
            if n is None:
                break
            out.append(n)
        return out[::-1]

    def close_item(self, tags) -> None:
        if not any(self.count[t] for t in tags):
            return
        for node in reversed(self.open):
            if node.tag in tags:
                self.imply(node.tag)
                self.pop_to(node.tag)
                return
            if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                return

    def table_part(self, tag: str, attrs: dict) -> None:
        if not self.within(("table",), {"template"}):
            return  # outside a table it means nothing
        if self.within(("td", "th", "caption"), {"table", "template"}):
            self.end_cell()
        if tag in ("caption", "colgroup", "col", *ROWS):
            self.pop_above("table")
        elif tag == "tr":
            self.pop_above("table", *ROWS)
            if self.open[-1].tag == "table":
                self.enter("tbody", {}, True)
        else:
            self.pop_above("table", "tr", *ROWS)
            if self.open[-1].tag == "table":
                self.enter("tbody", {}, True)
            if self.open[-1].tag != "tr":
                self.enter("tr", {}, True)
        self.enter(tag, attrs, True)
        if tag in (*CELLS, "caption"):
            self.active.append(None)
        if tag == "col":
            self.pop()

    def end_cell(self) -> None:
        self.pop_to(*CELLS, "caption")
        self.forget()

    def handle_endtag(self, tag):
        if not self.in_body:
            if tag in HEAD or tag == "noscript":
                if self.count[tag]:
                    self.pop_to(tag)
                return
            if tag not in ("body", "html", "br", "head"):
                return
            if tag != "head":
                self.to_body()
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag in ("html", "body", "head"):
            return
        elif tag == "p":
            if not self.within(("p",), SCOPES | {"button"}):
                self.enter("p", {})
            self.imply("p")
            self.pop_to("p")
        elif tag in TABLE_PARTS or tag == "table":
            if not self.within((tag,), {"table", "template"} - {tag}):
                return
            if tag in (*CELLS, "caption"):
                self.end_cell()
            else:
                if self.within(("td", "th", "caption"), {"table", "template"}):
                    self.end_cell()
                self.pop_to(tag)
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in HEADINGS:
            if self.within(HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif tag in CLOSES_P or tag in ("button", "object", "applet", "marquee"):
            if self.within((tag,), SCOPES | {"ol", "ul"} if tag == "li" else SCOPES - {tag}):
                self.imply(tag)
                self.pop_to(tag)
                if tag in ("object", "applet", "marquee"):
                    self.forget()
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for node in reversed(self.open):
            if node.tag == tag:
                self.imply(tag)
                self.pop_to(tag)
                return
            if node.tag in SPECIAL:
                return

    def end_formatting(self, tag: str) -> None:
        """The end of a formatting element: if a block stands open in it, what the block holds keeps the formatting, and the
        block itself goes behind the element."""
        for _ in range(8):
            element = next((n for n in reversed(self.since_mark()) if n.tag == tag), None)
            if element is None:
                self.end_other(tag)
                return
            if element not in self.open or not self.within((tag,)):
                self.active.remove(element)
                if element not in self.open:
                    continue
                return
            at = len(self.open) - 1 - self.open[::-1].index(element)
            block = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                while self.pop() is not element:
                    pass
                self.active.remove(element)
                return
            # clones of the formatting between the element and the block hold what comes next; the rest is closed
            last, below = block, self.open.index(block)
            for node in reversed(self.open[at + 1 : below]):
                if node not in self.active:
                    self.open.remove(node)
                    self.count[node.tag] -= 1
                    continue
                clone = Node(node.tag, node.attrs)
                self.active[self.active.index(node)] = clone
                self.open[self.open.index(node)] = clone
                clone.add(last)
                last = clone
            parent = self.open[at - 1]
            if parent.tag in PUSHES_OUT:
                table = next((n for n in reversed(self.open[:at]) if n.tag == "table"), None)
                (table.parent or parent).add(last, table if table.parent else None)
            else:
                parent.add(last)
            inner = Node(element.tag, element.attrs)
            for child in list(block.children):
                if isinstance(child, Node):
                    child.parent = inner
                inner.children.append(child)
            block.children = []
            block.add(inner)
            self.active[self.active.index(element)] = inner
            self.open.remove(element)
            self.open.insert(self.open.index(block) + 1, inner)

    def handle_data(self, data):
        if not self.in_body:
            if self.open[-1].tag != "head":
                self.open[-1].add(data)
                return
            if not data.strip(" \t\n\r\f"):
                return
            self.to_body()
            data = data.lstrip(" \t\n\r\f")
        if self.open[-1].tag in PUSHES_OUT and not data.strip(" \t\n\r\f"):
            self.open[-1].add(data)
            return
        self.reopen()
        self.place(data)


def body_of(html: str) -> Node:
    """The body of a page; one that has none has an empty one."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.body
