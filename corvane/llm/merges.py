"""Token ids of whole columns of text: byte-pair merges over arrays.

Texts are cut in front of spaces where no token of the vocabularies used here can span the cut, each different part of a
batch is encoded once, and a text's ids are gathered from its parts'. The merges of short words of ordinary letters run
over all words side by side; every other part goes to the tokenizers library, whose ids the arrays equal.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from corvane.llm.bpe import byte_letters

#: Longest part that is merged here, in bytes; words merged side by side.
SHORT, WORDS = 64, 40_000
_NONE = np.int64(1) << 62
#: Bytes of ordinary parts: ASCII, line feeds, and of longer characters those of two bytes up to U+00FF, which normal forms leave alone.
_PLAIN = np.zeros(256, bool)
_PLAIN[[10, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = True
_INK = np.zeros(256, bool)
_INK[0x21:0x7F] = True


class Parts:
    """The parts of a column of texts, each with a space in front: `different` ones, and `number` (which of these) for
    each in turn; text i has the parts from edge[i] to edge[i + 1]. Nulls count as empty."""

    def __init__(self, texts: pa.Array):
        spaced = pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), pc.fill_null(texts.cast(pa.large_binary()), b""), pa.scalar(b" ", pa.large_binary()))
        _, offs, data = spaced.buffers()
        offs = np.frombuffer(offs, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        data = np.frombuffer(data, np.uint8)[: offs[-1]] if len(texts) else np.zeros(0, np.uint8)
        at = np.flatnonzero(data == 0x20)
        before = data[at - 1]
        # A cut stands between a character that is surely no space and a space.
        sure = _INK[before] | ((before & 0xC0 == 0x80) & (data[at - 2] == 0xC3))
        begins = np.zeros(len(data), bool)
        begins[at[sure]] = True
        begins[offs[:-1]] = True
        starts = np.flatnonzero(begins)
        whole = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = whole.dictionary_encode()
        self.different: pa.Array = coded.dictionary
        self.number: np.ndarray = coded.indices.to_numpy()
        self.edge: np.ndarray = np.searchsorted(starts, offs)
        self.bytes: np.ndarray = np.diff(offs)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_binary column in a row, and the offsets of its rows."""
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if len(column) and data is not None else np.zeros(0, np.uint8)), offs - offs[0]


def gather(values: np.ndarray, edge: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[edge[r] : edge[r + 1]] of all rows r in a row, and how many each has."""
    n = edge[rows + 1] - edge[rows]
    ends = np.cumsum(n)
    return values[np.repeat(edge[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


def edges(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n, dtype=np.int64)))


class Merges:
    """Byte-pair encoding of words by the merges of a vocabulary file, all words of a list side by side.

    A file with an end-of-word suffix has words whose last byte is another letter."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.byte, self.last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for letter, b in byte_letters().items():
            self.byte[b], self.last[b] = ids[letter], ids[letter + suffix]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.begins = np.zeros(max(ids.values()) + 1, bool)
        # Pairs by hash, in an open table; of a pair listed twice the first counts.
        self.bits = max(4, int(len(pairs)).bit_length() + 2)
        self.key, self.rank = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int64)
        for rank, (a, b) in enumerate(pairs):
            self.begins[ids[a]] = True
            key = ids[a] << 32 | ids[b]
            at = int(self._slot(np.array([key]))[0])
            while self.key[at] >= 0 and self.key[at] != key:
                at += 1
            if self.key[at] < 0:
                self.key[at], self.rank[at] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), _NONE)
        some = np.flatnonzero(self.begins[a])
        key = a[some] << 32 | b[some]
        at = self._slot(key)
        while len(some):
            there = self.key[at]
            hit = there == key
            out[some[hit]] = self.rank[at[hit]]
            go = ~hit & (there >= 0)
            some, key, at = some[go], key[go], at[go] + 1
        return out

    def encode(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of n bytes each, whose bytes stand in a row, and how many ids each has."""
        edge = edges(n)
        found = [self._some(data[edge[lo] : edge[min(lo + WORDS, len(n))]], n[lo : lo + WORDS]) for lo in range(0, len(n), WORDS)]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _some(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each round every word merges the first of its pairs of the least rank."""
        token = self.byte[data]
        ends = np.cumsum(n)
        token[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(n)), n)
        rank = np.full(len(token), _NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self._ranks(token[inside], token[inside + 1])
        tokens, words = [], []
        while len(token):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(np.where(rank < _NONE, rank << 32 | np.arange(len(token)), _NONE), start)
            going = least < _NONE
            stays = np.repeat(going, np.diff(np.append(start, len(token))))
            tokens.append(token[~stays])
            words.append(word[~stays])
            at = least[going] & 0xFFFFFFFF
            token[at] = self.made[rank[at]]
            final = np.append(word[1:] != word[:-1], True)[at + 1]
            stays[at + 1] = False
            keep = np.flatnonzero(stays)
            moved = np.searchsorted(keep, at)
            token, word, rank = token[keep], word[keep], rank[keep]
            rank[moved[final]] = _NONE
            right = moved[~final]
            rank[right] = self._ranks(token[right], token[right + 1])
            left = moved[moved > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[left] = self._ranks(token[left], token[left + 1])
        token, word = np.concatenate([token, *tokens]), np.concatenate([word, *words])
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(n))


class PartIds:
    """Ids of parts by a vocabulary file of the tokenizers library, without special tokens added.

    split: the file's pre-split pattern; spaced: whether a space belongs to the word after it (else it is dropped, and
    letters are made small); literal: special tokens' own strings in a text are ordinary text."""

    def __init__(self, vocabulary: str, split: str, spaced: bool, literal: bool = False):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = literal
        self.special = [] if literal else [t["content"] for t in spec.get("added_tokens", [])]
        self.merges, self.spaced = Merges(spec), spaced
        self.find = regex.compile(split if spaced else split + "| ").findall

    def of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts (large_binary, each with its space in front) in a row, and their edges."""
        data, offs = bytes_of(parts)
        size = np.diff(offs)
        plain = (size > 1) & (size <= SHORT)
        odd = np.flatnonzero(~_PLAIN[data])
        plain[np.searchsorted(offs, odd, "right") - 1] = False
        plain[np.searchsorted(offs, np.flatnonzero((data[1:] == 0x20) & (data[:-1] == 0x20)) + 1, "right") - 1] = False
        inner = np.flatnonzero(data == 0x20)
        inner = inner[~np.isin(inner, offs[:-1], assume_unique=True)]
        plain[np.searchsorted(offs, inner, "right") - 1] = False
        for s in self.special:
            plain &= ~pc.match_substring(parts.cast(pa.large_string()), s).to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        text = bytes_of(parts.filter(pa.array(plain)))[0].tobytes().decode()
        words = list(map(str.encode, self.find(text if self.spaced else text.lower())))
        n = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        first = letters[np.cumsum(n) - n] == 0x20
        part = np.cumsum(first) - 1
        if not self.spaced:
            letters, n, part = letters[np.repeat(~first, n)], n[~first], part[~first]
        ids, k = self.merges.encode(letters, n)
        owner, found = [np.repeat(at[part], k)], [ids]
        if len(rest):
            coded = self.library.encode_batch_fast([p.decode() for p in parts.take(pa.array(rest)).to_pylist()], add_special_tokens=False)
            owner.append(np.repeat(rest, [len(e.ids) for e in coded]))
            found.append(np.array([i for e in coded for i in e.ids], np.int64))
        who, ids = np.concatenate(owner), np.concatenate(found)
        return ids[np.argsort(who, kind="stable")], edges(np.bincount(who, minlength=len(parts)))
