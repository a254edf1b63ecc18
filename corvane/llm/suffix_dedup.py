"""Removal of long byte strings that occur more than once, by column-wise suffix sorting of many documents.

1. Anchors. Every window of `length` bytes has an anchor, its smallest hashed K-gram; the windows that share an
   anchor form one segment. Equal windows have equal anchors at the same place in them, so only segments with the
   same anchor gram need to be compared, and only if the gram occurs twice.
2. Column-wise construction. The segments of an anchor gram stand as documents of one collection, their anchors in
   one column. Going from the last column to the first, one symbol of every document is inserted: the order of
   the suffixes that start in the column follows from the column before and the symbols in front of it, which are
   that column's slice of the Burrows-Wheeler transform, and the common prefixes of neighbours grow by one where
   the symbols agree. As equal windows start in the same column, slices of different columns are never merged.
   Neighbours with `length` bytes in common are repeated windows; a segment that stands for several occurrences
   repeats by itself. Columns are stored and passed through in sequence; a task holds a bounded number of segments.
3. The repeated windows go back to all occurrences of their segments, and documents drop the bytes these cover.
A gram in very many different segments is split further by the bytes that all windows of a range of columns share; if
they are too many even so, by single columns, where the bytes shared are the window and equal windows alone meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import dropped, pieces, prefix_hash, range_hash, release, slices, written

LENGTH, GRAM = 200, 32
#: Different segments of one gram that a task compares together; more are split by shared cores of RANGE columns, and more
#: than FAR_MORE by single windows.
MOST, FAR_MORE, RANGE = 4000, 64_000, 16
#: The crowded grams are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_GRAMS = 100_000
#: Segments that are sorted at once.
CHUNK = 12_000
#: Bytes of a document that are searched for anchors at once.
PIECE = 1_000_000
_POSITION = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, in linear time: block-wise running minima from both ends."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int = GRAM):
    """(row, first window, last window, anchor place, gram hash, digest) of each segment of the texts; places are in data."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = range_hash(prefix, at, at + gram)
    packed = (h & ~_POSITION) | at.astype(np.uint64)
    low = _sliding_min(packed, length - gram + 1)
    anchor = (low & _POSITION).astype(np.int64)  # of the window that starts at each place
    n = len(anchor)
    ok = np.zeros(n + 1, bool)
    row_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    ok[:n] = np.arange(n) + length <= offs[1:][row_of]
    edge = np.ones(n, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (row_of[1:] != row_of[:-1])
    first = np.flatnonzero(ok[:n] & edge)
    last = np.flatnonzero(ok[:n] & (np.concatenate((edge[1:], [True])) | ~ok[1:]))
    place = anchor[first]
    digest = range_hash(prefix, first, last + length) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return row_of[first], first, last, place, h[place], digest


def _find(length: int):
    def run(batches):
        release()
        for batch in batches:
            rk = batch.column("_rk").to_numpy()
            for i, _, data, offs in slices(batch.column("text"), PIECE):
                # a text longer than a piece is searched in pieces that overlap by a window
                many = len(offs) == 2 and len(data) > PIECE
                step = PIECE if many else max(1, len(data))
                for lo in range(0, max(1, len(data)), step):
                    part, o = (data[lo : lo + PIECE + length - 1], None) if many else (data, offs)
                    o = np.array([0, len(part)]) if o is None else o
                    row, first, last, place, gram, digest = anchors(part, o, length)
                    if len(row):
                        start = first - o[row] + lo
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rk[i + row]), pa.array(gram.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(start.astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array((place - first).astype(np.int32))],
                            names=["_rk", "gram", "digest", "start", "more", "rel"],
                        )

    return run


def _cut(length: int):
    """The bytes of the segments asked of each text; those of crowded grams in ranges of columns, keyed by their cores."""

    def run(batches):
        release()
        for batch in pieces(batches):
            segs = batch.column("segs")
            if isinstance(segs, pa.ChunkedArray):
                segs = segs.combine_chunks()
            flat = segs.flatten()
            start, more, rel, gram, digest, times, crowded = (flat.field(k).to_pylist() for k in range(7))
            owner = np.repeat(np.arange(len(segs)), np.diff(segs.offsets.to_numpy()))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out: list[list] = [[], [], [], [], [], [], []]
            size = 0
            for k, o in enumerate(owner.tolist()):
                a, text = start[k], texts[o]
                ranges = [(0, more[k], gram[k])]
                if crowded[k]:
                    ranges, w, wide = [], 0, RANGE if crowded[k] == 1 else 1
                    while w <= more[k]:  # windows by their column, counted back from the anchor
                        column = rel[k] - w
                        z = min(more[k], w + column % wide)
                        lo = column - column % wide
                        # every window of these columns holds the bytes from column lo + wide - 1 on down; the core is what all share
                        core = text[a + rel[k] - lo : a + rel[k] - (lo + wide - 1) + length]
                        key = int.from_bytes(hashlib.blake2b(core + lo.to_bytes(4, "little") + gram[k].to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                        ranges.append((w, z, key))
                        w = z + 1
                for w, z, key in ranges:
                    # the key of a single window tells all its bytes
                    piece = text[a + w : a + z + length] if crowded[k] < 2 else b""
                    for col, v in zip(out, (key, gram[k], digest[k], w, rel[k] - w, times[k], piece), strict=True):
                        col.append(v)
                    size += len(piece)
                if size > 8_000_000:
                    yield _pieces(out)
                    out, size = [[], [], [], [], [], [], []], 0
            if out[0]:
                yield _pieces(out)

    return run


def _pieces(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["key", "gram", "digest", "base", "rel", "times", "bytes"])


def repeated_windows(group: np.ndarray, rel: np.ndarray, times: np.ndarray, data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window) of each run of repeated windows; windows are counted from the document's start.

    Documents of a group (group is sorted) are compared; rel is the place of a document's aligned column, times
    its number of occurrences."""
    m, size = len(group), np.diff(offs)
    left, right = int(rel.max()), int((size - rel).max())
    columns = np.full((left + right, m), -1, np.int16)
    doc = np.repeat(np.arange(m), size)
    columns[np.arange(len(data)) - offs[doc] - rel[doc] + left, doc] = data
    order = np.arange(m)
    fresh = np.concatenate(([True], group[1:] != group[:-1]))  # order stays sorted by group, so groups keep their places
    rank = np.cumsum(fresh).astype(np.int64) * 512
    common = np.zeros(m + 1, np.int16)
    repeats = np.zeros((left + right + 1, m), bool)
    for c in range(left + right - 1, -1, -1):
        bwt = columns[c][order]  # the symbols in front of the last round's suffixes, in their order
        key = rank + bwt
        if (key[1:] < key[:-1]).any():
            perm = np.argsort(key, kind="stable")
            a, b = perm[:-1], perm[1:]
            low = common[b].copy()
            far = np.flatnonzero(b != a + 1)
            far = far[b[far] > a[far]]
            if len(far):
                pairs = np.empty(2 * len(far), np.int64)
                pairs[::2], pairs[1::2] = a[far] + 1, b[far] + 1
                low[far] = np.minimum.reduceat(common, pairs)[::2]
            order, key = order[perm], key[perm]
        else:
            low = common[1:m].copy()
        same = (key[1:] == key[:-1]) & (columns[c][order[1:]] >= 0)
        common[1:m] = np.where(same, low + 1, 0)
        common[0] = 0
        long = common >= length
        if long.any():
            repeats[c, order[long[:m] | long[1:]]] = True
    # several occurrences: every window repeats
    for d in np.flatnonzero(times > 1):
        repeats[left - rel[d] : left - rel[d] + size[d] - length + 1, d] = True
    step = np.diff(np.vstack([np.zeros((1, m), np.int8), repeats.astype(np.int8)]), axis=0).T
    d, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return d, first - left + rel[d], after - 1 - left + rel[d]


def _sort(length: int):
    def work(t: pa.Table):
        single = pc.binary_length(t.column("bytes")).to_numpy() == 0
        out = []
        if single.any():
            # one column, whose windows are equal: each has the whole length in common with its neighbours
            s = t.filter(pa.array(single))
            key = s.column("key").to_numpy()
            equal = key[1:] == key[:-1]
            s = s.filter(pa.array(np.concatenate(([False], equal)) | np.concatenate((equal, [False])) | (s.column("times").to_numpy() > 1)))
            base = s.column("base").to_numpy()
            out.append(pa.RecordBatch.from_arrays([pa.array(s.column("gram").to_numpy()), pa.array(s.column("digest").to_numpy()), pa.array(base), pa.array(base + np.int32(length))], names=["gram", "digest", "lo", "hi"]))
        if not single.all():
            out.append(sort(t.filter(pa.array(~single))))
        return out

    def sort(t: pa.Table):
        key, gram, digest = (t.column(c).to_numpy() for c in ("key", "gram", "digest"))
        # a segment that several pieces of one key stand for counts once, with all its occurrences
        order = np.lexsort((digest, key))
        key, gram, digest = key[order], gram[order], digest[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
        at = order[new]
        times = np.add.reduceat(t.column("times").to_numpy()[order], np.flatnonzero(new))
        t = t.take(pa.array(at))
        raw = t.column("bytes").combine_chunks().cast(pa.large_binary())
        offs = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        base = t.column("base").to_numpy()
        d, first, last = repeated_windows(key[new], t.column("rel").to_numpy().astype(np.int64), times, data, offs - offs[0], length)
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[new][d]), pa.array(digest[new][d]), pa.array((base[d] + first).astype(np.int32)), pa.array((base[d] + last + length).astype(np.int32))], names=["gram", "digest", "lo", "hi"]
        )

    def run(batches):
        release()
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            done = 0
            while len(cuts) and cuts[-1] > done:  # whole keys, about CHUNK segments at a time
                k = min(np.searchsorted(cuts, done + CHUNK), len(cuts) - 1)
                yield from work(t.slice(done, cuts[k] - done))
                done = cuts[k]
            t = t.slice(done)
            if t.num_rows >= CHUNK and not len(t.column("bytes")[0].as_py()):
                # equal windows without end: all but the last go, which from here on counts as one that has a neighbour
                yield from work(t.slice(0, t.num_rows - 1))
                t = t.slice(t.num_rows - 1).set_column(t.schema.get_field_index("times"), "times", pa.array([2], pa.int64()))
            held = t.combine_chunks().to_batches()
            n = t.num_rows
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _remove(length: int, texts: bool):
    def run(batches):
        release()
        for batch in pieces(batches, "_cv_text"):
            found = batch.column("_cv_cuts")
            out: list[list] = [[], [], [], [], []]
            for text, cuts in zip(batch.column("_cv_text").cast(pa.binary()).to_pylist(), found, strict=True):
                text = text or b""
                kept, at, gone, n = [], 0, 0, 0
                if cuts.is_valid and len(cuts):
                    flat = cuts.values
                    lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.concatenate(([True], lo[1:] > hi[:-1]))
                    first = np.flatnonzero(new)
                    ends = np.concatenate((first[1:], [len(lo)])) - 1
                    for a, b in zip(lo[first].tolist(), hi[ends].tolist(), strict=True):
                        kept.append(text[at:a])
                        at, gone, n = b, gone + b - a, n + 1
                kept.append(text[at:])
                left = b"".join(kept)
                for col, v in zip(out, (len(text), gone, n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if texts else None), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [c for c in batch.schema.names if c not in ("_cv_text", "_cv_cuts")]
            rest = [batch.column(c) for c in names]
            names = names + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays(rest + [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    return run


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_rk, cuts), a written table: for each row key (hash of doc_id and text) with repeated bytes, its pieces as lists of
    (lo, hi). Null and short texts, and an empty table, give no rows; repeated rows share one, whose texts repeat each other."""
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("_rk")).where(F.octet_length("text") >= length)
    segments = written(keyed.mapInArrow(_find(length), "_rk long, gram long, digest long, start int, more int, rel int"), "segments")
    twice = segments.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    # Written, so that both sides of the join are plain shuffles, whose crowded partitions Spark can split.
    twice = written(twice, "twice")
    found = written(segments.join(twice, "gram", "left_semi"), "candidates")
    dropped(segments)
    dropped(twice)
    unique = found.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("_rk", "start", "more", "rel")).alias("x"))
    unique = written(unique.select("gram", "digest", "times", "x.*"), "unique")
    crowd = unique.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST)
    crowd = written(crowd.select("gram", F.when(F.col("n") > FAR_MORE, 2).otherwise(1).alias("crowded")), "crowd")
    told = unique.join(F.broadcast(crowd) if crowd.count() <= BROADCAST_GRAMS else crowd, "gram", "left")
    asked = told.groupBy("_rk").agg(F.collect_list(F.struct("start", "more", "rel", "gram", "digest", "times", F.coalesce("crowded", F.lit(0)).alias("crowded"))).alias("segs"))
    one = keyed.join(asked, "_rk").select("_rk", "text", "segs")
    cut = one.mapInArrow(_cut(length), "key long, gram long, digest long, base int, rel int, times long, bytes binary")
    runs = written(cut.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(length), "gram long, digest long, lo int, hi int"), "runs")
    dropped(unique)
    dropped(crowd)
    spans = found.join(runs, ["gram", "digest"]).select("_rk", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    # A row that is there several times gives its pieces several times; sets are bounded by the text.
    cuts = written(spans.groupBy("_rk").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")), "cuts")
    dropped(found)
    dropped(runs)
    return cuts


def remove(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """Every row of docs (doc_id, text, and any others) with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    A byte goes if it lies in a string of `length` UTF-8 bytes that also starts at another place of any row, the
    same one included; places overlap, and all are judged on the input. Null texts count as empty, texts shorter
    than `length` stay whole, null ids are ids like others, repeated rows are copies of each other, an empty table gives no
    rows. Columns of docs with the names of the new ones give way to them. kept_text puts the rest together; where a
    cut splits a character its bytes become U+FFFD. texts=False leaves kept_text null.
    """
    cuts = repeats(docs, length).select(F.col("_rk").alias("_cv_rk"), F.col("cuts").alias("_cv_cuts"))
    joined = docs.withColumn("_cv_rk", F.xxhash64("doc_id", "text")).join(cuts, "_cv_rk", "left")
    extra = [T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))]
    rest = [c for c in docs.columns if c != "text" and c not in {f.name for f in extra}]
    joined = joined.select(*[F.col(f"`{c}`") for c in rest], F.col("text").alias("_cv_text"), "_cv_cuts")
    return joined.mapInArrow(_remove(length, texts), T.StructType([f for f in joined.schema if f.name not in ("_cv_text", "_cv_cuts")] + extra))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with every text freed of its repeated bytes; all columns stay, whatever their names, and n_chars, if
    there, follows the text. A row that had words and has none left goes; rows that lose nothing stay as they are."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_cv_row"))
    cut = remove(packed, length)
    blank = F.regexp_count(F.col("kept_text"), F.lit(r"[^\x20\x09-\x0D]")) == 0
    cut = cut.where(~((F.col("n_removed") > 0) & blank))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_cv_row.text"))
    out = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("_cv_row.n_chars").cast("long")) if "n_chars" in docs.columns else None}
    return cut.select(*[out[c].alias(c) if c in out else F.col(f"_cv_row.`{c}`").alias(c) for c in docs.columns])
