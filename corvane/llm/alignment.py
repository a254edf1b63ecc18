"""Cross-tokenizer alignment: which tokens of two vocabularies end together, counted over the corpus.

Tasks encode texts with both tokenizers, cut them where tokens of both end, and write the links of a slice of documents
by stripes of ids of the second vocabulary: a document's equal links are one entry with a number. Links are summed in
their task before they are shuffled, then in one dense block of counts for each stripe, whose row maxima are the best
partners. Counts and links meet by stripe again, a stripe's links in as many shares as there are slices for, and every
slice gets its documents' sums back. Nothing grows with the corpus in one task: a block has the size of the vocabularies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import PRE_SPLIT, byte_letters
from corvane.llm.common import pieces, release, written
from corvane.llm.merges import PartIds, Parts, bytes_of, edges, gather

#: Stripe of an id of the second vocabulary: its remainder. Bytes of text in a slice, slices to a share, lanes of first sums.
STRIPES, SLICE_TEXT, SLICES = 256, 5_000_000, 6
LANE_ROWS = 2_000
_SIDE = 16


class Aligner:
    """Both tokenizers, and what is to be known of each part of a text."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece

        self.a = PartIds(vocabulary, PRE_SPLIT, spaced=True, literal=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        by_id = sorted(self.a.library.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        labels = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, _ in by_id]
        if [i for _, i in by_id] != list(range(len(by_id))) or len(labels) > 1 << _SIDE:
            raise ValueError("ids of the first vocabulary aren't numbered from 0 to 65535 at most")
        self.a_bytes, self.a_edge = np.frombuffer(b"".join(labels), np.uint8), edges(np.array(list(map(len, labels))))
        self.space = [self.b.piece_to_id("▁")]
        n = self.b.get_piece_size()
        labels = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.b_bytes, self.b_edge = np.frombuffer(b"".join(labels), np.uint8), edges(np.array(list(map(len, labels))))
        # Decimal numbers followed by one of three marks, by id * 3 + mark.
        written_out = [b"%d%c" % (i, c) for i in range(max(n, len(self.a_edge) - 1)) for c in b",|;"]
        self.digits, self.digit_edge = np.frombuffer(b"".join(written_out), np.uint8), edges(np.array(list(map(len, written_out))))

    @staticmethod
    def _equal(bytes_: np.ndarray, label_edge: np.ndarray, ids: np.ndarray, id_edge: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether the ids' bytes put together are the part, for each part."""
        size = edges((label_edge[1:] - label_edge[:-1])[ids])
        good = size[id_edge[1:]] - size[id_edge[:-1]] == np.diff(offs)
        rows = np.flatnonzero(good)
        mine, n = gather(ids, id_edge, rows)
        got, _ = gather(bytes_, label_edge, mine)
        given, length = gather(data, offs, rows)
        good[rows[np.searchsorted(np.cumsum(length), np.flatnonzero(got != given), "right")]] = False
        return good

    def parts(self, parts: pa.Array):
        """For each part: whether both tokenizers keep its bytes, numbers of ids, its links and its groups in writing."""
        data, offs = bytes_of(parts)
        a, a_edge = self.a.of(parts)
        # the second tokenizer puts the space in front itself, but not in front of nothing
        coded = [x or self.space for x in self.b.encode([p[1:].decode() for p in parts.to_pylist()], num_threads=1)]
        b_edge = edges(np.fromiter(map(len, coded), np.int64, len(coded)))
        b = np.fromiter((i for x in coded for i in x), np.int64, b_edge[-1])
        good = self._equal(self.a_bytes, self.a_edge, a, a_edge, data, offs) & self._equal(self.b_bytes, self.b_edge, b, b_edge, data, offs)
        rows = np.flatnonzero(good)
        (a, n_a), (b, n_b) = gather(a, a_edge, rows), gather(b, b_edge, rows)
        a_end, b_end = (np.cumsum((e[1:] - e[:-1])[x]) for x, e in ((a, self.a_edge), (b, self.b_edge)))
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        last_a, last_b = np.searchsorted(a_end, both), np.searchsorted(b_end, both)
        length = np.zeros(len(parts), np.int64)
        length[rows] = np.diff(offs)[rows]
        ends = np.cumsum(length)
        links = np.zeros(len(parts), np.int64)
        links[rows] = np.searchsorted(both, ends[rows], "right") - np.searchsorted(both, ends[rows] - length[rows], "right")
        # groups in writing: the ids of a group's first side, then of its second, each with the mark that follows
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        group = np.concatenate((np.searchsorted(both, a_end), np.searchsorted(both, b_end)))
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        letters, size = gather(self.digits, self.digit_edge, np.concatenate((a * 3 + mark_a, b * 3 + mark_b))[order])
        size = edges(np.bincount(group[order], size, len(both)).astype(np.int64)) if len(both) else np.zeros(1, np.int64)
        out = {"good": good, "links": edges(links), "key": b[last_b] << _SIDE | a[last_a], "letters": letters}
        out["letter_edge"] = size[out["links"]]
        for name, n in (("n_a", n_a), ("n_b", n_b)):
            out[name] = np.zeros(len(parts), np.int64)
            out[name][rows] = n
        return out


_made: dict[str, Aligner] = {}


def _aligner(vocabulary: str, model: bytes) -> Aligner:
    key = hashlib.sha256(vocabulary.encode() + model).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Aligner(vocabulary, model)
    return _made[key]


LINKS = "slice long, stripe int, docs int, slot binary, key binary, n binary, doc_id array<long>, tokens binary, digest array<string>"


def _encode(vocabulary, model):
    names = [x.split()[0] for x in LINKS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())]

    def run(batches):
        release()
        aligner = _aligner(vocabulary.value, model.value)
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, most=SLICE_TEXT):
            texts = batch.column("text")
            parts = Parts(texts)
            at, edge = parts.number, parts.edge
            of = aligner.parts(parts.different)
            m = len(edge) - 1
            per_doc = lambda x: np.diff(edges(x[at])[edge])  # noqa: B023, E731
            live = (per_doc((~of["good"]).astype(np.int64)) == 0) & (parts.bytes > 1)
            tokens = np.stack([per_doc(of["n_a"]), per_doc(of["n_b"]), per_doc(np.diff(of["links"]))]) * live
            letters, size = gather(of["letters"], of["letter_edge"], at)
            ends = edges(size)[edge]
            letters = letters.tobytes()
            digest = [hashlib.sha256(letters[ends[i] : ends[i + 1] - 1]).hexdigest() if live[i] else "" for i in range(m)]
            key, n = gather(of["key"], of["links"], at)
            slot = np.repeat(np.repeat(np.arange(m), np.diff(edge)), n)
            key, slot = key[live[slot]], slot[live[slot]]
            # by stripe, then key, then document
            b = key >> _SIDE
            order = np.lexsort((slot, key, b % STRIPES))
            key, slot = key[order], slot[order]
            fresh = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])))) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(fresh, len(key)))
            key, slot = key[fresh], slot[fresh]
            cut = np.searchsorted((key >> _SIDE) % STRIPES, np.arange(STRIPES + 1))
            rows = [(number, -1, m, None, None, None, batch.column("doc_id").to_pylist(), tokens.astype(np.int64).tobytes(), digest)]
            for s in np.flatnonzero(np.diff(cut)):
                mine = slice(cut[s], cut[s + 1])
                rows.append((number, int(s), m, slot[mine].astype(np.int32).tobytes(), key[mine].astype(np.uint32).tobytes(), n[mine].astype(np.int32).tobytes(), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            number += 1

    return run


SUMS = "stripe int, lane int, key binary, n binary"


def _row(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c], kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _presum(lanes: int):
    """Sums of a task's links by stripe, sent on whenever a million have come together."""

    def flush(held, lane):
        for s, (keys, ns) in sorted(held.items()):
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, back, np.concatenate(ns))
            yield _row(SUMS, s, lane, key.tobytes(), n.tobytes())

    def run(batches):
        lane, held, size = TaskContext.get().partitionId() % lanes, {}, 0
        for b in batches:
            for s, key, n in zip(*(b.column(c).to_pylist() for c in ("stripe", "key", "n")), strict=True):
                keys, ns = held.setdefault(s, ([], []))
                keys.append(np.frombuffer(key, np.uint32))
                ns.append(np.frombuffer(n, np.int32).astype(np.int64))
                size += len(ns[-1])
            if size > 4_000_000:
                yield from flush(held, lane)
                held, size = {}, 0
        yield from flush(held, lane)

    return run


def _block(side_a: int, side_b: int, best: bool):
    """Sums of a stripe (and lane) in one dense block: a row for each of the stripe's ids, a column for each of the others.
    Rows come in order; with best, the row maxima are marked. Only cells that were added to are read and cleared again."""
    schema = "stripe int, key binary, n binary, best binary" if best else SUMS

    def run(batches):
        block, now, cells = np.zeros((-(-side_b // STRIPES), side_a), np.int64), None, []
        flat = block.reshape(-1)

        def done():
            at = np.unique(np.concatenate(cells))
            n, row = flat[at], at // side_a
            flat[at] = 0
            key = ((row * STRIPES + now[0]) << _SIDE | at % side_a).astype(np.uint32).tobytes()
            if not best:
                return _row(schema, *now, key, n.tobytes())
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(row))))
            return _row(schema, now[0], key, n.tobytes(), (n == most).tobytes())

        for batch in batches:
            for s, lane, key, n in zip(*(batch.column(c).to_pylist() for c in ("stripe", "lane", "key", "n")), strict=True):
                if (s, lane) != now:
                    if now:
                        yield done()
                    now, cells = (s, lane), []
                key = np.frombuffer(key, np.uint32).astype(np.int64)
                at = (key >> _SIDE) // STRIPES * side_a + (key & (1 << _SIDE) - 1)
                np.add.at(flat, at, np.frombuffer(n, np.int64))
                cells.append(at)
                if len(cells) > 64:
                    cells = [np.unique(np.concatenate(cells))]
        if now:
            yield done()

    return run, schema


def _score(batches):
    """Sums of each slice's documents over the links of a stripe; a stripe's counts come before its links."""
    counts = None
    for batch in batches:
        for row in batch.to_pylist():
            key = np.frombuffer(row["key"], np.uint32)
            if row["slice"] is None:
                counts = key, np.frombuffer(row["n"], np.int64), np.frombuffer(row["best"], bool)
                continue
            at = np.searchsorted(counts[0], key)
            slot, n = np.frombuffer(row["slot"], np.int32), np.frombuffer(row["n"], np.int32).astype(np.int64)
            sums = np.zeros((2, row["docs"]), np.int64)
            np.add.at(sums[0], slot, n * counts[2][at])
            np.add.at(sums[1], slot, n * counts[1][at])
            yield _row("slice long, sums binary", row["slice"], sums.tobytes())


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _documents(batches):
    """A slice's sums added up and put beside its documents; the row of the slice itself comes first."""
    held, sums = None, None

    def done():
        n = np.frombuffer(held["tokens"], np.int64).reshape(3, -1)
        columns = [pa.array(held["doc_id"], pa.int64()), *(pa.array(x) for x in (n[0], n[1], n[2], n[2], sums[0], sums[1])), pa.array(held["digest"], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if row["sums"] is None:
                if held:
                    yield done()
                held, sums = row, np.zeros((2, row["docs"]), np.int64)
            else:
                sums += np.frombuffer(row["sums"], np.int64).reshape(2, -1)
    if held:
        yield done()


def align(docs: DataFrame, vocabulary_path: str, model_path: str) -> DataFrame:
    """For every row of docs (doc_id, text): tokens by each vocabulary, groups, links, links whose pair is the most frequent
    of its second id in the corpus (ties included), the sum of the links' counts, and sha256 of the groups in writing.

    Both tokenizers get one space and the text. Null and empty texts, and texts of which a tokenizer doesn't keep all
    bytes, have zeros and ''. Rows that repeat count each and repeat in the result; null ids stay null; an empty table
    gives no rows; other columns are ignored. The two files are read by the driver (their sizes are fixed). A last token
    of a group ends where the other side's does, so a group has one link.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    made = _aligner(vocabulary.value, model.value)
    side_a, side_b = len(made.a_edge) - 1, len(made.b_edge) - 1
    links = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(vocabulary, model), LINKS), "links")
    slices = links.where("stripe < 0").count()
    lanes, shares = -(-max(1, slices) // LANE_ROWS), -(-max(1, slices) // SLICES)
    pairs = links.where("stripe >= 0")
    sums = pairs.select("stripe", "key", "n").mapInArrow(_presum(lanes), SUMS)
    if lanes > 1:
        run, schema = _block(side_a, side_b, best=False)
        sums = sums.repartition("stripe", "lane").sortWithinPartitions("stripe", "lane").mapInArrow(run, schema).withColumn("lane", F.lit(0))
    run, schema = _block(side_a, side_b, best=True)
    counts = written(sums.withColumn("lane", F.lit(0)).repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, schema), "counts")
    none = F.lit(None)
    asked = pairs.select("stripe", F.pmod(F.xxhash64("slice"), F.lit(shares)).cast("int").alias("share"), "slice", "docs", "slot", "key", "n", none.cast("binary").alias("best"))
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), none.cast("long").alias("slice"), none.cast("int").alias("docs"), none.cast("binary").alias("slot"), "key", "n", "best")
    met = known.unionByName(asked).repartition("stripe", "share").sortWithinPartitions("stripe", "share", F.col("slice").asc_nulls_first())
    scored = met.mapInArrow(_score, "slice long, sums binary")
    own = links.where("stripe < 0").select("slice", "docs", "doc_id", "tokens", "digest", none.cast("binary").alias("sums"))
    back = scored.select("slice", none.cast("int").alias("docs"), none.cast("array<long>").alias("doc_id"), none.cast("binary").alias("tokens"), none.cast("array<string>").alias("digest"), "sums")
    return own.unionByName(back).repartition("slice").sortWithinPartitions("slice", F.col("sums").isNotNull()).mapInArrow(_documents, RESULT)
