"""Siblings, patterns and facts of token streams, in NumPy columns over many files at once.

The same rules as the windows of syntax.py (siblings, matches, table_facts), which say them row by row: a test holds one against
the other. Texts are numbers of a dictionary here, partitions of windows are stretches of sorted rows, and a frame's last value
is a running maximum of places. Work and memory are linear in the tokens; a file's tokens are held whole, others are
worked on CHUNK at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are worked on at once, if a file has no more.
CHUNK = 100_000
CLASSES = "nksdipwc"  # the order of the classes' numbers
N, K, S, D, I, P, W, C = range(8)
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
FACTS = pa.schema([
    ("path", pa.string()), ("what", pa.string()), ("name", pa.string()), ("bare", pa.bool_()), ("kind", pa.string()), ("qualifier", pa.string()),
    ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_line", pa.int32()), ("end_line", pa.int32()),
])
DECLARING = ("def", "class", "fun", "func", "fn", "object", "trait", "interface", "val", "var", "import", "struct", "enum", "protocol", "let", "const", "return", "function")


def files_of(batches, columns: int, chunk: int) -> Iterator[list[pa.Array]]:
    """Columns of tokens (path of a file's first token, else null, first) in whole files, a chunk of tokens or one file at a time."""
    held: list[list[pa.Array]] = [[] for _ in range(columns)]
    n = 0
    for b in batches:
        starts = np.flatnonzero(b.column(0).is_valid().to_numpy(zero_copy_only=False))
        cut = int(starts[-1]) if len(starts) and n + starts[-1] >= chunk else 0
        if cut or (n >= chunk and len(starts)):
            yield [pa.concat_arrays([*h, b.column(k).slice(0, cut)]) for k, h in enumerate(held)]
            held, n, b = [[] for _ in range(columns)], 0, b.slice(cut)
        for k in range(columns):
            held[k].append(b.column(k))
        n += b.num_rows
    if n:
        yield [pa.concat_arrays(h) for h in held]


def running(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where start says the place of the stretch's first row."""
    total = np.cumsum(values, dtype=np.int64)
    return (total - (total - values)[start]).astype(np.int32)


def stretches(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first place of its stretch of equal keys, and the place after its last."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return first.astype(np.int32)[which], np.append(first[1:], n).astype(np.int32)[which]


def doubled(opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, with those that open or close twice, and their marks: the start (1) or the end (-1) of a level beside the row (0)."""
    closes = closes & ~opens
    times = 1 + (opens | closes)
    row = np.repeat(np.arange(len(opens), dtype=np.int32), times)
    second = np.zeros(len(row), np.int8)
    second[1:] = row[1:] == row[:-1]
    return row, np.where(opens[row], second, np.where(closes[row], second - np.int8(1), np.int8(0)))


class Matcher:
    """The registry's languages and patterns, as rows of syntax.load, and its forms (regular expressions of elements)."""

    def __init__(self, languages: list[tuple], patterns: list[tuple], forms: list[str]):
        self.chunk = CHUNK
        self.names = sorted({row[1] for row in languages})
        number = {n: k for k, n in enumerate(self.names)}
        self.rules = {number[row[1]]: row[7:] for row in languages}  # keywords, chain, always, first, close
        self.forms = {f: k for k, f in enumerate(forms)}
        self.patterns = patterns
        self.by_anchor: dict[int, dict[str, list[int]]] = {}
        for k, p in enumerate(patterns):
            if p[0] in number:
                self.by_anchor.setdefault(number[p[0]], {}).setdefault(p[1], []).append(k)
        self.rank = np.array([p[2] for p in patterns], np.int64)
        whats = ("definition", "call", "import")
        self.what = np.array([whats.index(p[3]) for p in patterns], np.int8)
        self.whats = pa.array(whats)
        kinds = sorted({p[4] for p in patterns if p[4] is not None}, key=lambda x: x.encode())
        self.kinds = pa.array([*kinds, None], pa.string())
        self.kind = np.array([-1 if p[4] is None else kinds.index(p[4]) for p in patterns], np.int64)
        self.name_at = np.array([p[6] for p in patterns], np.int64)
        bodies = ("{", "=", ";", "top", "end")
        self.body = np.array([bodies.index(p[7]) if p[7] in bodies else -1 for p in patterns], np.int8)
        self.block_at = np.array([p[8] for p in patterns], np.int64)
        self.leading = np.array([p[1][:1] in ("@", ":") for p in patterns], bool)

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        for columns in files_of(batches, 5 + len(self.forms), self.chunk):
            yield self.facts(*columns[:5], columns[5:])

    def facts(self, paths: pa.Array, languages: pa.Array, texts: pa.Array, classes: pa.Array, directed: pa.Array, forms: list[pa.Array]) -> pa.RecordBatch:
        """The facts of whole files, given their tokens in order."""
        t = Rows(self, paths, languages, texts, classes, forms)
        rows, which = self.met(t)
        return self.told(t, rows, which, directed)

    def met(self, t: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the patterns that begin at them."""
        rows, which = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        begins = t.mark != -1
        for language in np.unique(t.file_language).tolist():
            own = np.flatnonzero((t.language == language) & begins).astype(np.int32)
            code, cls = t.code[own], t.cls[own]
            for anchor, patterns in self.by_anchor.get(language, {}).items():
                if len(anchor) == 2 and anchor[0] == "@" and anchor[1] in CLASSES:
                    at = own[cls == CLASSES.index(anchor[1])]
                elif (number := t.number(anchor)) >= 0:
                    at = own[code == number]
                else:
                    continue
                for k in patterns if len(at) else ():
                    found = self.fitting(t, at, self.patterns[k])
                    rows.append(found)
                    which.append(np.full(len(found), k, np.int32))
        return np.concatenate(rows), np.concatenate(which)

    def fitting(self, t: Rows, at: np.ndarray, pattern: tuple) -> np.ndarray:
        elements, after, not_after, only_in, head, in_block, declares = pattern[5], *pattern[9:15]
        for j, (texts, _, form, near) in enumerate(elements):
            if j:  # the first is the anchor
                at = at[at + j < t.end[at]]
                q = at + j
                if form is not None:
                    fits = t.formed[self.forms[form]][q]
                else:
                    fits = (t.among(texts, q) & (t.cls[q] != S)) | t.of_class(texts, q)
                at = at[fits]
            if near:
                at = at[~t.first[at + j]]
            if not len(at):
                return at
        before = lambda names, at: ~t.leads[at] & (t.among(names, at - 1) | t.of_class(names, at - 1))
        if after is not None:
            at = at[before(after, at)]
        if not_after is not None:
            at = at[~before(not_after, at)]
        if only_in is not None:
            opened = t.opened[at]
            at = at[(opened >= 0) & t.among(only_in, opened, t.context)]
        if head:
            at = at[t.first[at] | t.leads[at] | ~(np.isin(t.cls[at - 1], (N, S, D)) | t.among((")", "]", "}", ".", "::", "&.", "->"), at - 1))]
        if declares is not None:
            eq = t.following("eq")[at]
            declared = t.first[at] & (t.indent[at] == 0) & (eq >= 0) & (t.line[eq] == t.line[at])
            at = at[declared == declares]
        if in_block:
            opened = t.opened[at]
            at = at[(opened >= 0) & t.among(("{",), opened, t.opener)]
        return at

    def told(self, t: Rows, rows: np.ndarray, which: np.ndarray, directed: pa.Array) -> pa.RecordBatch:
        body = np.where(self.what[which] == 0, self.body[which], -2)
        last = t.last_of_file[rows]
        end_byte, end_line = t.token_hi[last], t.token_end_line[last]
        there = body != -1  # a definition without a body has no end

        def put(mask, at, byte, line):
            """The end of those in mask whose place isn't -1; others end with the file."""
            mask = mask & (at >= 0)
            end_byte[mask], end_line[mask] = byte[at[mask]], line[at[mask]]

        stop = t.following("stop")[rows]
        block = (stop >= 0) & t.among(("{",), stop)
        there &= (body != 0) | block
        mate = np.where(block & (stop + 1 < t.end[rows]), stop + 1, -1)
        mate[~(t.among(CLOSE, mate) | (t.cls[mate] == K))] = -1
        put(body == 0, mate, t.hi, t.end_line)
        for k, name in ((1, "expression"), (2, "statement"), (3, "declaration")):
            if (body == k).any():
                put(body == k, t.following(name)[rows], t.prev_hi, t.prev_line)
        block_at = self.block_at[which]
        put((body == 4) & (block_at == 0), t.following("block_end")[rows], t.hi, t.end_line)
        at = rows + 1 + block_at
        put((body == 4) & (block_at != 0), np.where((block_at >= 0) & (at < t.end[rows]), at, -1), t.hi, t.end_line)
        rows, which, end_byte, end_line = rows[there], which[there], end_byte[there], end_line[there]

        what = self.what[which]
        defined = what == 0
        name = rows + self.name_at[which]
        whole = defined & (self.body[which] == 0) & self.leading[which]
        directive = t.cls[rows] == I
        name_lo, name_hi = t.lo[name].copy(), t.hi[name].copy()
        ways: dict[int, str] = {}
        for k in np.flatnonzero(directive).tolist():  # one token: the path is its first group, and stands last in it
            way = ways[k] = directed[int(t.raw[rows[k]])].as_py() or ""
            name_hi[k] = t.hi[rows[k]] - (len(t.text(rows[k]).rpartition(way)[2].encode()) if way else 0)
            name_lo[k] = name_hi[k] - len(way.encode())
        begin = t.begun[rows]
        start_byte = np.where(whole, t.lo[begin], np.where(defined, t.lo[rows], name_lo))
        start_line = np.where(whole, t.line[begin], np.where(defined, t.line[rows], np.where(directive, t.end_line[rows], t.line[name])))
        end_byte, end_line = np.where(defined, end_byte, name_hi), np.where(defined, end_line, t.end_line[name])
        # of patterns that meet in a name the first of its kind counts, and what is defined there isn't called
        file, kind = t.file[rows], self.kind[which]
        order = np.lexsort((kind, end_byte, start_byte, self.rank[which], what, name_lo, file))
        one, _ = stretches(file[order], name_lo[order], what[order])
        place, _ = stretches(file[order], name_lo[order])
        taken = (one == np.arange(len(order))) & ~((what[order] == 1) & (what[order][place] == 0))
        k = order[taken]
        rows, which, name, what = rows[k], which[k], name[k], what[k]

        chain = t.chained[rows]
        qualified = (what == 1) & (self.name_at[which] == 0) & ~t.leads[rows] & t.chains[rows - 1]
        qualified &= t.lo[chain] < t.lo[rows - 1]
        qualifiers: list[str | None] = [None] * len(rows)
        for j in np.flatnonzero(qualified).tolist():
            qualifiers[j] = t.between(chain[j], rows[j] - 1)
        names = t.words.take(pa.array(t.code[name])).cast(pa.string())
        if ways:
            named = names.to_pylist()
            for j, x in enumerate(k.tolist()):
                if x in ways:
                    named[j] = ways[x]
            names = pa.array(named, pa.string())
        kind = self.kind[which]
        columns = [
            t.paths.take(pa.array(t.file[rows])).cast(pa.string()), self.whats.take(pa.array(what)), names, pa.array((what == 2) & ~directive[k]),
            self.kinds.take(pa.array(np.where(kind < 0, len(self.kinds) - 1, kind))), pa.array(qualifiers, pa.string()), pa.array(start_byte[k].astype(np.int64)), pa.array(end_byte[k].astype(np.int64)),
            pa.array(start_line[k].astype(np.int32)), pa.array(end_line[k].astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=FACTS)


class Rows:
    """Tokens as rows of siblings: what syntax.siblings says of each, by number of the row. Rows -1 and beyond the last aren't read
    for what they say: where a place may be missing, the caller masks it."""

    def __init__(self, m: Matcher, paths: pa.Array, languages: pa.Array, texts: pa.Array, classes: pa.Array, forms: list[pa.Array]):
        starts = np.flatnonzero(paths.is_valid().to_numpy(zero_copy_only=False))
        self.paths, self.file_language = paths.take(pa.array(starts)), languages.take(pa.array(starts)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.source = texts.cast(pa.large_string())
        n = len(texts)
        bytes_ = np.frombuffer(self.source.buffers()[1], np.int64)[self.source.offset :][: n + 1]
        self.buffer, self.offsets = self.source.buffers()[2], bytes_
        file = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, n)))
        coded = self.source.dictionary_encode()
        self.words, code = coded.dictionary, coded.indices.to_numpy()
        self.size = len(self.words)
        self._numbers: dict[str, int] = {}
        # a file has fewer than 2**31 bytes, as a text of the JVM; so have its lines, tokens and levels
        lo = (bytes_[:-1] - bytes_[starts][file]).astype(np.int32)
        breaks = pc.count_substring(self.words, "\n").to_numpy().astype(np.int32)[code]
        line = running(breaks, starts[file]) - breaks + 1
        cls = classes.to_numpy(zero_copy_only=False).astype(np.int8)
        indent = np.where(np.arange(n) == starts[file], 0, self._indents()[np.roll(code, 1)])

        # tokens that count
        raw = np.flatnonzero(cls < W)
        file, code, cls, lo, line, indent, breaks = (x[raw] for x in (file, code, cls, lo, line, indent, breaks))
        hi, end_line = (lo + (bytes_[1:] - bytes_[:-1])[raw]).astype(np.int32), line + breaks
        own, after = stretches(file)
        leads = own == np.arange(len(raw))
        back = lambda x: np.where(leads, np.int32(-1), np.roll(x, 1))
        first = leads | (line > np.roll(end_line, 1))
        self.token_hi, self.token_end_line = hi, end_line
        before = back(code)
        language = self.file_language[file]
        said = lambda k: self._rule(m, k)[language * self.size + code]
        word, bracket = cls == K, cls == P
        loose = word & ~self._in((".", "::", ":", "&."), before)
        opens = (bracket & self._in(OPEN, code)) | (loose & (said(2) | (said(3) & (first | self._in(("=", "(", "return"), before)))))
        closes = (bracket & self._in(CLOSE, code)) | (loose & said(4))
        strong = word | self._in(("{", "}"), code)

        # Blocks first; brackets are counted within a block, so that what isn't closed there ends with it.
        so, sc = strong & opens, strong & closes & ~opens
        blocks = running(so.astype(np.int8) - sc.astype(np.int8), own)
        t, mark = doubled(so, sc)
        level = blocks[t] - so[t] + (mark != 0)
        order = self._sorted(file[t], level)
        t, mark, level = t[order], mark[order], level[order]
        group, _ = stretches(file[t], level)
        block = running((mark == 1).astype(np.int8), group)
        group, _ = stretches(file[t], level, block)
        weak = ~strong[t] & (mark == 0)
        wo, wc = weak & opens[t], weak & closes[t] & ~opens[t]
        depth = np.where(mark == 0, running(wo.astype(np.int8) - wc.astype(np.int8), group), 0)
        row, inner = doubled(wo, wc)
        level = depth[row] - wo[row] + (inner != 0)
        mark, t, group = mark[row] + inner, t[row], group[row]
        order = self._sorted(group, level)
        t, self.mark, group, level = t[order], mark[order], group[order], level[order]

        self.start, self.end = stretches(group, level)
        n = len(t)
        self.leads = self.start == np.arange(n, dtype=np.int32)
        end, start = self.size, self.size + 1  # numbers of what stands for the end and for the start of a level; words that start one follow
        self.code = np.where(self.mark == 0, code[t], np.where(self.mark == -1, end, np.where(word[t], start + 1 + code[t], start))).astype(np.int32)
        self.cls = np.where(self.mark == 0, cls[t], np.int8(P))
        self.chains = said(1)[t] & (self.mark == 0)
        self.file, self.language, self.raw = file[t], language[t].astype(np.int32), raw[t].astype(np.int32)
        self.lo, self.hi, self.line, self.end_line, self.first, self.indent = lo[t], hi[t], line[t], end_line[t], first[t], indent[t]
        self.prev_hi, self.prev_line = back(hi)[t], back(end_line)[t]
        self.last_of_file = (after - 1)[t]
        self.context, self.opener = before[t], code[t]
        self._close = closes[t]
        heads = self._in(("{", "}", ";", "⟨", "⟩"), None, pc.utf8_slice_codeunits(self.words, 0, 1))[code]
        self.formed = [(self.mark == 0) & ~heads[t] & f.to_numpy(zero_copy_only=False).astype(bool)[self.raw] for f in forms]
        self._said: dict[str, np.ndarray] = {}

        p = np.arange(-1, n - 1, dtype=np.int32)  # the row before: not read where a row leads
        prev = lambda texts: ~self.leads & self.among(texts, p)
        linked = (
            self.chains | (~self.leads & self.chains[p]) | self.among(CLOSE)
            | (self.among(("(", "[")) & ~self.first & ~self.leads & (np.isin(self.cls[p], (N, S)) | prev((")", "]"))))
        )
        begun = self.leads | prev((";", "}")) | (self.code[p] >= self.size) | (self.cls[p] == I)
        self.opened, self.chained, self.begun = (self._so_far(x) for x in (self.mark == 1, ~linked | self.leads, begun))

    def _indents(self) -> np.ndarray:
        """For each word the spaces behind its last line break if it is white space, else -1."""
        found = np.full(self.size + 1, -1, np.int32)
        for k in np.flatnonzero(pc.match_substring_regex(self.words, r"^[ \t\n\x0b\f\r]").to_numpy(zero_copy_only=False)).tolist():
            _, line, tail = self.words[k].as_py().rpartition("\n")
            found[k] = len(tail) if line and not tail.strip(" \t") else 0
        return found

    def _sorted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least = int(b.min()) if len(b) else 0
        return np.argsort(a.astype(np.int64) * (int(b.max()) - least + 1 if len(b) else 1) + b - least, kind="stable").astype(np.int32)

    def number(self, text: str) -> int:
        """The number of a text, or of what starts a level; -1 if it doesn't occur."""
        if text not in self._numbers:
            if text == "⟩":
                found = self.size
            elif text == "⟨":
                found = self.size + 1
            elif text[:1] == "⟨":
                found = self.number(text[1:])
                found += self.size + 2 if found >= 0 else 0
            else:
                found = pc.index(self.words, pa.scalar(text, pa.large_string())).as_py()
            self._numbers[text] = found
        return self._numbers[text]

    def _in(self, texts, codes: np.ndarray | None, of: pa.Array | None = None) -> np.ndarray:
        """Whether numbers are those of one of texts (-1: none); with `of`, for each word whether that text of it is."""
        if of is not None:
            return pc.is_in(of, pa.array(texts, of.type)).to_numpy(zero_copy_only=False)
        hit = np.zeros(len(codes), bool)
        for x in texts:
            if (number := self.number(x)) >= 0:
                hit |= codes == number
        return hit

    def among(self, texts, rows: np.ndarray | None = None, codes: np.ndarray | None = None) -> np.ndarray:
        codes = self.code if codes is None else codes
        return self._in(texts, codes if rows is None else codes[rows])

    def of_class(self, texts, rows: np.ndarray) -> np.ndarray:
        asked = [CLASSES.index(x[1]) for x in texts if len(x) == 2 and x[0] == "@" and x[1] in CLASSES]
        return np.isin(self.cls[rows], asked) if asked else np.zeros(len(rows), bool)

    def _rule(self, m: Matcher, k: int) -> np.ndarray:
        """For each language and word whether the language's list (1 chain, 2 always, 3 first, 4 close) has it."""
        hit = np.zeros(len(m.names) * self.size, bool)
        for language in np.unique(self.file_language).tolist():
            for x in m.rules[language][k]:
                if (number := self.number(x)) >= 0:
                    hit[language * self.size + number] = True
        return hit

    def _so_far(self, cond: np.ndarray) -> np.ndarray:
        """The last row of the level up to each row where cond holds, or -1."""
        at = np.maximum.accumulate(np.where(cond, np.arange(len(cond), dtype=np.int32), np.int32(-1)))
        return np.where(at >= self.start, at, -1)

    def following(self, what: str) -> np.ndarray:
        """The next row of the level after each row that ends something, or -1."""
        if what not in self._said:
            p = np.arange(-1, len(self.code) - 1, dtype=np.int32)
            ends = self.among((";",)) | (self.code == self.size)
            if what == "stop":
                cond = ends | self.among(("{", "}")) | (self.first & self.among(DECLARING))
            elif what == "expression":
                shut = self.among(CLOSE) | (self._close & (self.mark == 0))
                goes_on = self.among((".", "?.", "{", "(", "|", "||", "&&", "+", "=>", "=", "where")) | (~self.leads & self.among(("=", "=>", "->", ":", "&&", "||", "+", "(", "{"), p))
                cond = ends | self.among((",",)) | (self.first & ~shut & ~goes_on)
            elif what == "statement":
                cond = ends
            elif what == "declaration":
                cond = self.first & (self.indent == 0) & (self.mark == 0)
            elif what == "block_end":
                cond = self.code == self.size
            else:
                cond = self.among(("=", "|"))
            n = len(cond)
            at = np.minimum.accumulate(np.where(cond, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]
            at = np.append(at[1:], np.int32(n))
            self._said[what] = np.where(at < self.end, at, np.int32(-1))
        return self._said[what]

    def text(self, row: int) -> str:
        return self.words[int(self.code[row])].as_py()

    def between(self, a: int, b: int) -> str:
        """What the file has from the start of one row's token to the start of another's."""
        return self.buffer[int(self.offsets[self.raw[a]]) : int(self.offsets[self.raw[b]])].to_pybytes().decode()
