"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

Every task packs the rows of its own partition, so nothing is shuffled and no task's work depends on another's: a bin is
open at a time, and of the examples that still fit, the one goes into it whose demands have the largest dot product with
what the bin has left, each limit weighed by how much of it the waiting examples ask for. Documents may be cut, so a
bin's last gap is filled with the beginning of a long one, and what the end of a partition leaves makes sequences as long
as powers of two. The composition of sequences so follows the input's partitions; the pieces of a row stay in one task.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import pieces, release
from corvane.llm.merges import PartIds, Parts, gather

#: Pre-split pattern of vocabularies with word ends (a fixed value of the tokenizer format).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Id put after each document, bytes of text encoded and examples waiting at once.
END, SLICE_TEXT, WAITING = 1, 16_000_000, 20_000


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    @property
    def all(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.int64)


class Bench:
    """Examples that wait, by their demands (tokens, segments, loss-bearing tokens); equal demands in the order they came."""

    def __init__(self, kinds: np.ndarray, limits: Limits):
        self.kinds, self.limits = kinds, limits.all
        self.share = kinds / self.limits
        self.waiting: list[deque] = [deque() for _ in range(len(kinds))]
        self.count = np.zeros(len(kinds), np.int64)

    def put(self, kind: int, example, first: bool = False) -> None:
        (self.waiting[kind].appendleft if first else self.waiting[kind].append)(example)
        self.count[kind] += 1

    def take(self, kind: int):
        self.count[kind] -= 1
        return self.waiting[kind].popleft()

    @property
    def tokens(self) -> int:
        return int(self.count @ self.kinds[:, 0])

    def best(self, left: np.ndarray) -> int:
        """The kind of the largest weighted dot product among those that fit; of equal ones the first; -1 if none fits."""
        some = np.flatnonzero(self.count)
        some = some[(self.kinds[some] <= left).all(axis=1)]
        if not len(some):
            return -1
        weight = self.count @ self.share
        return int(some[np.argmax(self.share[some] @ (weight * left / self.limits))])


def pack_whole(demands: np.ndarray, limits: Limits) -> list[list[int]]:
    """Bins of examples (rows of demands: tokens, segments, loss) that aren't cut; none may exceed a limit alone."""
    kinds, kind = np.unique(demands, axis=0, return_inverse=True)
    bench, bins = Bench(kinds[::-1], limits), []
    for i, k in enumerate(len(kinds) - 1 - kind.reshape(-1)):
        bench.put(int(k), i)
    while bench.count.any():
        left, bin_ = limits.all.copy(), []
        while (k := bench.best(left)) >= 0:
            left -= bench.kinds[k]
            bin_.append(bench.take(k))
        bins.append(bin_)
    return bins


class Cutter:
    """Bins of pieces of documents. A piece of n tokens bears loss on n - 1: nothing in it foretells its first."""

    def __init__(self, limits: Limits):
        if min(limits.tokens, limits.segments) < 1 or limits.loss < 0:
            raise ValueError("limits must leave room for a token")
        self.limits = limits
        # the longest piece that can stand alone
        self.most = min(limits.tokens, limits.loss + 1)
        n = np.arange(self.most, 0, -1)
        self.bench = Bench(np.column_stack([n, np.ones_like(n), n - 1]), limits)

    def put(self, document, start: int, n: int, first: bool = False) -> None:
        self.bench.put(self.most - n, (document, start, n), first)

    def fill(self, room: int) -> list[tuple]:
        """A bin of at most `room` tokens; full if the waiting pieces and the other limits allow it."""
        left, bin_ = self.bench.limits.copy(), []
        left[0] = room
        while left[0] and left[1]:
            k = self.bench.best(left)
            if k < 0:  # the beginning of the longest one that waits
                n = int(min(left[0], left[2] + 1))
                some = np.flatnonzero(self.bench.count)
                if not len(some) or self.most - some[0] <= n:
                    break
                document, start, whole = self.bench.take(int(some[0]))
                bin_.append((document, start, n))
                self.put(document, start + n, whole - n, first=True)
                left -= (n, 1, n - 1)
            else:
                bin_.append(self.bench.take(k))
                left -= self.bench.kinds[k]
        return bin_

    def closed(self, bin_: list[tuple]) -> list[tuple]:
        """The bin as it is if it is full, else its first tokens up to a power of two; the rest waits again."""
        size = sum(p[2] for p in bin_)
        over = 0 if size == self.limits.tokens else size - (1 << size.bit_length() - 1)
        while over:
            document, start, n = bin_.pop()
            back = min(n, over)
            self.put(document, start + n - back, back, first=True)
            if n > back:
                bin_.append((document, start, n - back))
            over -= back
        return bin_

    def bins(self, final: bool):
        """Bins of what waits: full ones, and at the end all the rest."""
        while (waiting := self.bench.tokens) >= self.limits.tokens or (final and waiting):
            yield self.closed(self.fill(self.limits.tokens))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, vocabulary_path: str, limits: Limits = Limits(), end: int = END, ids: bool = False) -> DataFrame:  # noqa: B008
    """Pieces of every row of docs (doc_id, text) and their places in sequences; with ids, the pieces' ids (32-bit little-endian).

    A document is its text's ids by the vocabulary file, and `end`; a null or empty text is `end` alone. Sequences are
    full, or as long as a power of two where another limit or the end of a partition closes them, so that none needs
    padding. sequence_id is the partition's number times 2**32 and a count from 0. Rows that repeat are packed each;
    null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = PIECES + ", ids binary" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        release()
        words = part_ids(vocabulary.value)
        cutter, serial = Cutter(limits), TaskContext.get().partitionId() << 32

        def rows(bins):
            nonlocal serial
            out = []
            for bin_ in bins:
                offset = 0
                for (doc_id, coded, before, total), start, n in bin_:
                    own = coded[start : start + n].tobytes()
                    out.append((doc_id, before + start, n, zlib.crc32(own), total, serial, offset, n - 1) + ((own,) if ids else ()))
                    offset += n
                serial += 1
            if out:
                kinds = [pa.int64()] * 8 + [pa.binary()] * ids
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in pieces(batches, most=SLICE_TEXT):
            parts = Parts(batch.column("text"))
            found, n = gather(*words.of(parts.different), parts.number)
            edge = np.concatenate(([0], np.cumsum(n)))[parts.edge]
            found = found.astype("<u4")
            full = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                coded = np.append(found[edge[i] : edge[i + 1]], np.uint32(end)).astype("<u4")
                total = len(coded)
                tail = total // cutter.most * cutter.most
                # pieces that leave no room beside them are sequences of their own, if they need no padding
                if cutter.most == limits.tokens:
                    full += [[((doc_id, coded, 0, total), at, cutter.most)] for at in range(0, tail, cutter.most)]
                else:
                    for at in range(0, tail, cutter.most):
                        cutter.put((doc_id, coded, 0, total), at, cutter.most)
                if total > tail:
                    cutter.put((doc_id, coded[tail:].copy(), tail, total), 0, total - tail)
                if len(full) > WAITING:
                    yield from rows(full)
                    full = []
            yield from rows(full)
            yield from rows(cutter.bins(final=False))
        yield from rows(cutter.bins(final=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """sequence_id and offset of every row of examples (key, tokens, segments, loss_tokens), which stay whole.

    Instruction data: an example has so many tokens, turns and tokens that the loss counts. One that exceeds a limit alone,
    or has a null or negative demand, gets no sequence (nulls). Rows wait for each other by WAITING of a partition.
    Rows that repeat are packed each; an empty table gives no rows; columns of other names are ignored.
    """
    kinds = dict(examples.dtypes)
    schema = f"key {kinds['key']}, tokens long, segments long, loss_tokens long, sequence_id long, offset long"

    def run(batches):
        serial, held = TaskContext.get().partitionId() << 32, []

        def packed(table):
            nonlocal serial
            demands = np.column_stack([table.column(c).fill_null(-1).to_numpy() for c in ("tokens", "segments", "loss_tokens")])
            good = np.flatnonzero(((demands >= 0) & (demands <= limits.all)).all(axis=1))
            sequence, offset = np.full(len(demands), -1, np.int64), np.zeros(len(demands), np.int64)
            for bin_ in pack_whole(demands[good], limits):
                own = good[bin_]
                sequence[own], offset[own] = serial, np.cumsum(demands[own, 0]) - demands[own, 0]
                serial += 1
            out = table.append_column("sequence_id", pa.array(sequence, mask=sequence < 0)).append_column("offset", pa.array(offset, mask=sequence < 0))
            yield from out.combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= WAITING:
                yield from packed(pa.Table.from_batches(held))
                held = []
        if held:
            yield from packed(pa.Table.from_batches(held))

    return examples.select("key", *[F.col(c).cast("long").alias(c) for c in ("tokens", "segments", "loss_tokens")]).mapInArrow(run, schema)


_made: dict[int, PartIds] = {}


def part_ids(vocabulary: str) -> PartIds:
    """The encoder of a word-end vocabulary file's text, made once in a worker."""
    key = zlib.crc32(vocabulary.encode()) << 32 | len(vocabulary)
    if key not in _made:
        _made.clear()
        _made[key] = PartIds(vocabulary, WORD_SPLIT, spaced=False)
    return _made[key]
