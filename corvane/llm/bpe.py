"""Byte-pair encoding and decoding by a compiled automaton over tokens.

The automaton has a state for each token, the one that the token's arcs lead to: what may follow it in a correct encoding.
It starts as one state with a loop for each byte, and the merges (u, v) are compiled in their order, each by a gadget: the
new token's state starts as a copy of v's, the new token may stand wherever u may stand, and u's state loses its arc to v.
Copies pass on the arcs lost so far, and later tokens follow where their left part may follow. With tokens numbered
along their left parts, later ones first, a gadget so takes one interval of arcs away from a range of states, and the
finished transition table holds for each state the intervals of arcs that it lacks, in order: 19 a state for a
vocabulary of 50,000 tokens, where a full table would have tokens squared entries.

Encoding a pre-split word runs the automaton over the word's tokens from left to right: every prefix has exactly one
encoding, so the state after each byte is found once, by the one arc that leads there, and nothing is taken back.
Decoding puts the arcs' labels together.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corvane.llm.common import pieces, prefix_hash, range_hash, release

#: The pre-split pattern of byte-level BPE vocabularies (a fixed value of the tokenizer format).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a worker between batches, and the longest that is; others are encoded again in each batch. Words run at once.
KEEP_WORDS, KEEP_CHARS, WORDS = 300_000, 64, 50_000
#: Words of more bytes are run one at a time: side by side they'd take a round of arrays for every byte and length. Answers kept.
LONG, KEEP_ANSWERS = 96, 1_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class TokenAutomaton:
    """Encoder and decoder compiled from a vocabulary file's merges."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label = {i: as_bytes(t) for t, i in ids.items() if t not in self.special}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        self.by_bytes: dict[bytes, int] = {}
        self.gadget: dict[int, tuple[int, int, int]] = {}  # token: (round in which it was added, u, v)
        self.cut: dict[tuple[int, int], int] = {}  # arc (u, v): the round in which it was removed
        for s, i in ids.items():
            if len(b := as_bytes(s)) == 1:
                self.by_bytes[b] = i
                self.gadget[i] = (-1, -1, -1)
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, w = ids[a], ids[b], ids[a + b]
            self.cut.setdefault((u, v), k)
            if w not in self.gadget:
                self.gadget[w] = (k, u, v)
                self.by_bytes[self.label[w]] = w
        self._compile()
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PRE_SPLIT)
        self.fence = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _compile(self) -> None:
        """Transition table: the intervals [lacks_from, lacks_to) of arcs that states lack, as state times wide plus arc, in order."""
        gadget = self.gadget

        def numbered(part: int):
            """Tokens numbered below their left (1) or right (2) parts, later tokens first, and the ends of the numbers below them."""
            below: dict[int, list[int]] = {}
            for t, g in gadget.items():
                if g[0] >= 0:
                    below.setdefault(g[part], []).append(t)
            number, end = {}, {}
            for b in [t for t, g in gadget.items() if g[0] < 0]:
                number[b] = len(number)
                stack = [(b, iter(sorted(below.get(b, ()), key=lambda t: -gadget[t][0])))]
                while stack:
                    t, rest = stack[-1]
                    x = next(rest, None)
                    if x is None:
                        end[t] = len(number)
                        stack.pop()
                    else:
                        number[x] = len(number)
                        stack.append((x, iter(sorted(below.get(x, ()), key=lambda t: -gadget[t][0]))))
            for x in below.values():
                x.sort(key=lambda t: -gadget[t][0])

            def since(t: int, now: int) -> tuple[int, int]:
                """t and what stands below it by parts that came in round now or later."""
                stop = number[t] + 1
                for x in below.get(t, ()):
                    if gadget[x][0] < now:
                        break
                    stop = end[x]
                return number[t], stop

            return number, since

        follow, arcs_of = numbered(1)
        state, states_of = numbered(2)
        # The gadget of round k: states that are copies of u's made later lack the arc to v, and to tokens put where v stands since.
        lost = np.array([(*states_of(u, k + 1), *arcs_of(v, k)) for (u, v), k in self.cut.items()], np.int64).reshape(-1, 4)
        size, self.wide = lost[:, 1] - lost[:, 0], len(gadget) + 1
        at = np.repeat(lost[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        start, stop = at * self.wide + np.repeat(lost[:, 2], size), at * self.wide + np.repeat(lost[:, 3], size)
        order = np.lexsort((-stop, start))
        start, stop = start[order], stop[order]
        # intervals of a state lie apart or within each other; the outer ones stay
        outer = np.concatenate(([True], start[1:] >= np.maximum.accumulate(stop)[:-1])) if len(start) else np.zeros(0, bool)
        self.lacks_from, self.lacks_to = start[outer], stop[outer]
        # Tokens by number: the first of the arcs of their states, and their place among a state's arcs.
        self.state, self.follow = np.zeros(max(gadget, default=0) + 1, np.int64), np.zeros(max(gadget, default=0) + 1, np.int64)
        for t in gadget:
            self.state[t], self.follow[t] = state[t] * self.wide, follow[t]
        # A token that its own merges don't rebuild can't be produced: it has no arcs.
        sound: dict[int, bool] = {}
        for t, (k, u, v) in gadget.items():  # parts come before what they make
            sound[t] = k < 0 or (sound[u] and sound[v] and self.stood(u, v, k))
        self.by_bytes = {b: t for b, t in self.by_bytes.items() if sound[t]}
        # Arc labels by length and hash, and the longest label for each two last bytes.
        ends = np.cumsum([len(b) for b in self.by_bytes], dtype=np.int64)
        starts = ends - [len(b) for b in self.by_bytes]
        h = range_hash(prefix_hash(np.frombuffer(b"".join(self.by_bytes), np.uint8)), starts, ends)
        order = np.argsort(h)
        self.label_hash, self.label_token = h[order], np.array(list(self.by_bytes.values()), np.int64)[order]
        self.reach = np.ones(1 << 16, np.int64)
        for b in self.by_bytes:
            if len(b) > 1:
                last = b[-2] << 8 | b[-1]
                self.reach[last] = max(len(b), self.reach[last])
        # the same for one word at a time: the lengths that labels with these last bytes have, longest first
        lengths: dict[bytes, set[int]] = {}
        for b in self.by_bytes:
            if len(b) > 1:
                lengths.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {last: sorted(n, reverse=True) for last, n in lengths.items()}
        self.lacking = array("q", self.lacks_from.tobytes()), array("q", self.lacks_to.tobytes())
        self.answers: dict[tuple[int, int], bool] = {}

    def follows(self, x, y):
        """Whether the states that tokens x lead to have the arcs y."""
        at = self.state[x] + self.follow[y]
        i = np.searchsorted(self.lacks_from, at, "right") - 1
        return (i < 0) | (at >= self.lacks_to[i])

    def paths(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-split words. All words run side by side: the state after each byte is found by the longest arc first,
        and only one leads there."""
        out = [b""] * len(words)
        order = sorted((k for k in range(len(words)) if words[k]), key=lambda k: -len(words[k]))
        if not order:
            return out
        n = np.array([len(words[k]) for k in order])
        begin = np.cumsum(n) - n
        data = np.frombuffer(b"".join([words[k] for k in order]), np.uint8)
        prefix = prefix_hash(data)
        longest = np.ones(len(data), np.int64)
        longest[1:] = self.reach[data[:-1].astype(np.int64) << 8 | data[1:]]
        last, size = np.full(len(data), -1), np.zeros(len(data), np.int64)  # token and its length, by the place of its last byte
        for i in range(1, n[0] + 1):
            left = begin[: np.searchsorted(-n, -i, "right")] + i
            room = np.minimum(longest[left - 1], i)
            for width in range(int(room.max()), 0, -1):
                some = np.flatnonzero(room >= width)
                at = left[some]
                h = range_hash(prefix, at - width, at)
                k = np.minimum(np.searchsorted(self.label_hash, h), len(self.label_hash) - 1)
                hit = np.flatnonzero(self.label_hash[k] == h)
                t, at = self.label_token[k[hit]], at[hit]
                if width < i:
                    ok = self.follows(last[at - width - 1], t)
                    hit, t, at = hit[ok], t[ok], at[ok]
                last[at - 1], size[at - 1] = t, width
                room[some[hit]] = 0
        # back from the last bytes
        at, word = begin + n - 1, np.arange(len(n))
        tokens, owners = [], []
        while len(at):
            tokens.append(last[at])
            owners.append(word)
            at = at - size[at]
            ok = at >= begin[word]
            at, word = at[ok], word[ok]
        turn = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        owner, token = np.concatenate(owners), np.concatenate(tokens).astype("<u4")
        by_word = np.lexsort((-turn, owner))
        ids, ends = token[by_word].tobytes(), np.cumsum(np.bincount(owner, minlength=len(n))).tolist()
        lo = 0
        for k, hi in zip(order, ends, strict=True):
            out[k] = ids[4 * lo : 4 * hi]
            lo = hi
        return out

    def arc(self, x: int, y: int) -> bool:
        """follows() of one pair."""
        known = self.answers.get((x, y))
        if known is None:
            at = int(self.state[x] + self.follow[y])
            i = bisect_right(self.lacking[0], at) - 1
            known = i < 0 or at >= self.lacking[1][i]
            if len(self.answers) > KEEP_ANSWERS:
                self.answers.clear()
            self.answers[x, y] = known
        return known

    def path(self, word: bytes) -> bytes:
        """Ids of one word, of any length: a table look-up for each byte and each length that a label with its last bytes has."""
        token, size = array("q", [-1]) * (len(word) + 1), array("q", [1]) * (len(word) + 1)
        by_bytes, lengths, arc = self.by_bytes, self.lengths, self.arc
        for i in range(1, len(word) + 1):
            for width in lengths.get(word[i - 2 : i], ()) if i > 1 else ():
                if width <= i and (t := by_bytes.get(word[i - width : i])) is not None and (width == i or arc(token[i - width], t)):
                    token[i], size[i] = t, width
                    break
            else:
                token[i] = by_bytes[word[i - 1 : i]]
        out, i = [], len(word)
        while i:
            out.append(token[i])
            i -= size[i]
        return np.array(out[::-1], "<u4").tobytes()

    def stood(self, a: int, b: int, now: int) -> bool:
        """Whether b was an arc of a's state just before round now: the gadgets walked back, used while compiling."""
        while True:
            if self.cut.get((a, b), now) < now:
                return False
            ra, rb = self.gadget[a][0], self.gadget[b][0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # a's state began as a copy of its right part's, before that round's cut
                now, a = ra, self.gadget[a][2]
            elif rb > ra:  # b was put wherever its left part stood after that round's cut
                now, b = rb + 1, self.gadget[b][1]
            else:
                now, a, b = ra, self.gadget[a][2], self.gadget[b][1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers. Special tokens' own strings in a text become those tokens."""
        parts = [[p for p in self.fence.split(t) if p] if self.fence and any(s in t for s in self.special) else [t] for t in texts]
        split = [[[p] if p in self.special else self.split.findall(p) for p in text] for text in parts]
        known = self.words
        if len(known) > KEEP_WORDS:
            known.clear()
        new = list({w for text in split for words in text for w in words if w not in known})
        long: dict[str, bytes] = {}
        for lo in range(0, len(new), WORDS):
            some = new[lo : lo + WORDS]
            coded = [w.encode() for w in some]
            short = [k for k, w in enumerate(coded) if len(w) <= LONG]
            for k, ids in zip(short, self.paths([coded[k] for k in short]), strict=True):
                (known if len(some[k]) <= KEEP_CHARS else long)[some[k]] = ids
            for w, b in zip(some, coded, strict=True):
                if len(b) > LONG:
                    long[w] = self.path(b)
        special = {s: np.uint32(i).astype("<u4").tobytes() for s, i in self.special.items()}
        out = []
        for text, words in zip(parts, split, strict=True):
            out.append(b"".join([special[p] if p in special else b"".join([known.get(w) or long[w] for w in some] if long else [known[w] for w in some]) for p, some in zip(text, words, strict=True)]))
        return out

    def decode(self, ids: bytes) -> str:
        """The arc labels put together; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_compiled: dict[str, TokenAutomaton] = {}


def automaton(vocabulary: str) -> TokenAutomaton:
    """The automaton of a vocabulary file's text, compiled once in a worker."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = TokenAutomaton(vocabulary)
    return _compiled[key]


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_decode(docs: DataFrame, vocabulary_path: str, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every row of docs (doc_id, text), or with digests their sha256 instead.

    The vocabulary file is read by the driver and sent with the task's code (its size is fixed). A null text
    counts as empty and has no ids. Texts and words of any length are worked on whole; rows that repeat repeat in the result.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        release()
        machine = automaton(vocabulary.value)
        for batch in pieces(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            coded = machine.encode([t or "" for t in texts])
            back = [machine.decode(c) if c else "" for c in coded]
            cols = [ids, pa.array([len(c) // 4 for c in coded], pa.int64())]
            if digests:
                cols += [pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])]
            else:
                cols += [pa.array(coded, pa.binary()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
