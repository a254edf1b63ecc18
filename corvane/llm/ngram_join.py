"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every text becomes its set of word n-grams and 128 MinHash values; equal sets are one node from here on.
2. Nodes that share one of 32 bands of 4 values are candidates. In a band's bucket, pairs are compared 16 values
   at a time; a pair goes as soon as the posterior probability that its Jaccard similarity reaches the threshold,
   given the values equal so far under a uniform prior, is below the tolerance.
3. Nodes connected by the pairs left over form provisional groups. Each group gets its texts once and verifies
   the similarity of its pairs exactly, by the sizes of their intersections.
Buckets and groups of any size are cut into tiles; a task sees two tiles and returns counts and a spanning forest,
never pairs.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lowered, mixed, prefix_hash, range_hash, release, slices, spans, written
from corvane.llm.graph import components

WIDTH, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Values compared at a time.
STEP = 16
#: Nodes of a bucket's tile, and of a group's.
BUCKET_TILE, GROUP_TILE = 512, 256

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = [np.uint64(x) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest equal values with which a pair stays.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), whose mass above t equals the
    probability of at most m successes in n + 1 trials of chance t."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams. A text of fewer words has one, of all its words; one without words has none."""
    out: list[np.ndarray] = []
    for i, j, data, offs in slices(texts):
        data = lowered(data)
        starts, ends, row = spans(data, offs)
        h = range_hash(prefix_hash(data), starts, ends)
        edge = np.searchsorted(row, np.arange(j - i + 1))
        n = len(h) - width + 1
        grams = np.zeros(max(0, n), np.uint64)
        for k in range(width if n > 0 else 0):
            grams += h[k : n + k] * _PLACES[k]
        grams = mixed(grams)
        for r in range(j - i):
            a, b = edge[r], edge[r + 1]
            if b - a >= width:
                g = np.sort(grams[a : b - width + 1])
                out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            elif b > a:
                out.append(mixed(np.array([sum(int(h[a + k]) * int(_PLACES[k]) for k in range(b - a)) & (1 << 64) - 1], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """16 bits of each of the MinHash values, as BANDS 64-bit band keys."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048]
        np.minimum(low, (part[None, :] * _FACTORS[:, None]).min(axis=1), out=low)
    return ((low >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int64)


def _signatures(width: int):
    def run(batches):
        release()
        for batch in batches:
            sets = shingle_sets(batch.column("text"), width)
            some = [len(s) > 0 for s in sets]
            node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1 if ok else None for s, ok in zip(sets, some, strict=True)]
            bands = [min_hashes(s) if ok else None for s, ok in zip(sets, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_rk"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "_rk", "node", "n_shingles", "bands"],
            )

    return run


def _groups(batches, key: list[str], most: int = 1 << 62):
    """Tables of whole groups from sorted batches, `key` equal within a group; many small groups come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        same = np.ones(t.num_rows - 1, bool)
        for k in key:
            v = t.column(k).to_numpy()
            same &= v[1:] == v[:-1]
        cuts = np.flatnonzero(~same)
        if len(cuts):
            yield t.slice(0, int(cuts[-1]) + 1)
            held = t.slice(int(cuts[-1]) + 1).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of 0 .. n-1 by the edges (a, b)."""
    r = np.arange(n)
    while True:
        before = r.copy()
        low = np.minimum(r[a], r[b])
        np.minimum.at(r, a, low)
        np.minimum.at(r, b, low)
        np.minimum.at(r, before[a], low)
        np.minimum.at(r, before[b], low)
        r = r[r]
        if (r == before).all():
            return r


def _prune(least: list[int]):
    """Candidate pairs of each bucket tile that survive, as a spanning forest (a, b)."""

    def run(batches):
        release()
        for t in _groups(batches, ["band", "key", "ti", "tj"]):
            node, mine, band = (t.column(c).to_numpy() for c in ("node", "mine", "band"))
            ti, tj = t.column("ti").to_numpy(), t.column("tj").to_numpy()
            sig = np.ascontiguousarray(t.column("bands").combine_chunks().flatten().to_numpy()).reshape(-1, BANDS)
            values = sig.view(np.uint16)
            same = np.ones(t.num_rows, bool)
            same[0] = False
            for c in ("band", "key", "ti", "tj"):
                v = t.column(c).to_numpy()
                same[1:] &= v[1:] == v[:-1]
            group = np.cumsum(~same) - 1
            a_all, b_all = [], []
            at, d = np.arange(t.num_rows), 0
            while True:
                d += 1
                at = at[at + d < t.num_rows]
                at = at[group[at] == group[at + d]]
                if not len(at):
                    break
                i, j = at, at + d
                # tiles meet other tiles, or themselves if they are the same
                ok = (ti[i] == tj[i]) | (mine[i] != mine[j])
                i, j = i[ok], j[ok]
                # a pair belongs to the first band that it shares
                for lo in range(0, len(i), 65536):
                    x, y = i[lo : lo + 65536], j[lo : lo + 65536]
                    first = (sig[x] == sig[y]).argmax(axis=1)
                    ok = first == band[x]
                    x, y = x[ok], y[ok]
                    m = np.zeros(len(x), np.int64)
                    for k, need in enumerate(least):
                        m += (values[x, k * STEP : (k + 1) * STEP] == values[y, k * STEP : (k + 1) * STEP]).sum(axis=1)
                        ok = m >= need
                        x, y, m = x[ok], y[ok], m[ok]
                    a_all.append(x)
                    b_all.append(y)
            if not a_all:
                continue
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            used = np.unique(np.concatenate((a, b)))
            r = used[roots(len(used), np.searchsorted(used, a), np.searchsorted(used, b))]
            ok = node[used] != node[r]
            yield pa.RecordBatch.from_arrays([pa.array(node[used][ok]), pa.array(node[r][ok])], names=["a", "b"])

    return run


def shared_counts(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of the sets, by products of 0/1 matrices over the shared members."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    member, inverse, count = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(member), -1)
    number[shared] = np.arange(len(shared))
    column = number[inverse]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float64)
    for lo in range(0, len(shared), columns):
        s, e = np.searchsorted(column, (lo, lo + columns))
        m = np.zeros((n, min(columns, len(shared) - lo)), np.float32)
        m[row[s:e], column[s:e] - lo] = 1
        out += m @ m.T
    return out


def _verify(threshold: float, width: int):
    """Links of each node within a group tile, and the root of its part of the spanning forest."""

    def run(batches):
        release()
        for t in _groups(batches, ["comp", "ti", "tj"]):
            comp, ti, tj = (t.column(c).to_numpy() for c in ("comp", "ti", "tj"))
            edge = np.concatenate(([0], np.flatnonzero((comp[1:] != comp[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])) + 1, [t.num_rows]))
            out_node, out_root, out_links = [], [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                part = t.slice(lo, hi - lo)
                node, at = np.unique(part.column("node").to_numpy(), return_index=True)
                if len(node) < 2:
                    continue
                part = part.take(pa.array(at))
                sets = shingle_sets(part.column("text"), width)
                n = np.array([len(s) for s in sets], np.float64)
                both = shared_counts(sets)
                linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
                mine = part.column("mine").to_numpy()
                if ti[lo] != tj[lo]:
                    linked &= mine[:, None] != mine[None, :]
                np.fill_diagonal(linked, False)
                links = linked @ part.column("copies").to_numpy()
                some = np.flatnonzero(links)
                if len(some):
                    a, b = np.nonzero(np.triu(linked))
                    r = roots(len(node), a, b)
                    out_node.append(node[some])
                    out_root.append(node[r[some]])
                    out_links.append(links[some])
            if out_node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_node, out_root, out_links)], names=["node", "root", "links"])

    return run


def _tiles(df: DataFrame, size: str, tile: int) -> DataFrame:
    """Each row once for every pair of tiles that holds its own: n / tile times."""
    n = F.ceil(F.col(size) / tile).cast("int")
    mine = F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    df = df.withColumn("_n", n).withColumn("mine", mine)
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return df.withColumn("ti", F.least("mine", "_o")).withColumn("tj", F.greatest("mine", "_o")).drop("_n", "_o")


def row_key(doc_id: str = "doc_id", text: str = "text"):
    return F.xxhash64(F.col(doc_id), F.col(text))


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for every row of docs (doc_id, text): doc_id, class_id, links, copies, n_shingles, row_key, keep_key.

    links counts the other rows whose set of word n-grams has a Jaccard similarity of `threshold` or more with
    this row's, copies those with the same set. class_id is the smallest doc_id of the row's class, the rows
    connected by links; keep_key is the row_key (a hash of id and text) of the class's row to keep.
    Words are runs without white space, A-Z in lower case; a text of fewer words than n has one n-gram, all its
    words. Null, empty and white texts link with nothing and are classes of their own, as are rows of an empty
    similarity; null ids are rows like others, after all ids. Repeated rows are copies. Texts are read whole.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_rk", row_key())
    rows = written(keyed.mapInArrow(_signatures(width), "doc_id long, _rk long, node long, n_shingles long, bands array<long>"), "signatures")
    some = rows.where("node is not null")
    # Rows of a node have equal sets, so equal bands: any of them serves.
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_rk"))
    info = some.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("_f"), F.min("_rk").alias("_rk"))
    nodes = written(info.select("node", "copies", F.col("_f.doc_id").alias("least_id"), F.col("_f._rk").alias("keep_key"), "_rk"), "nodes")
    bands = some.join(nodes.select("_rk", "node"), ["_rk", "node"], "left_semi").dropDuplicates(["node"]).select("node", "bands")
    bands = written(bands, "bands")
    buckets = bands.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = _tiles(buckets.join(sizes, ["band", "key"]), "size", BUCKET_TILE).drop("size").join(bands, "node")
    tiles = ["band", "key", "ti", "tj"]
    pruned = shared.repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(_prune(least_matches(threshold, tolerance)), "a long, b long")
    groups = components(pruned)
    sized = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").withColumnRenamed("root", "comp")
    wanted = sized.join(nodes.select("node", "copies", "_rk"), "node")
    texts = _tiles(wanted.join(keyed.select("_rk", "text"), "_rk"), "size", GROUP_TILE).select("comp", "ti", "tj", "mine", "node", "copies", "text")
    tiles = ["comp", "ti", "tj"]
    verified = written(texts.repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(_verify(threshold, width), "node long, root long, links long"), "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("_links"))
    final = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    full = nodes.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pick = F.struct(F.col("least_id").isNull(), F.col("least_id"), F.col("keep_key"))
    heads = full.groupBy("root").agg(F.min(pick).alias("_h"))
    full = full.join(heads, "root").join(links, "node", "left").select("node", "copies", F.col("_h.least_id").alias("class_id"), F.col("_h.keep_key").alias("keep_key"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    with_words = some.select("doc_id", "_rk", "node", "n_shingles").join(full, "node").select("doc_id", "class_id", "links", "copies", "n_shingles", F.col("_rk").alias("row_key"), "keep_key")
    without = rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(1).cast("long").alias("copies"), "n_shingles", F.col("_rk").alias("row_key"), F.col("_rk").alias("keep_key"))
    return with_words.union(without)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The rows of docs that stay when each class keeps its row of the smallest doc_id, with all their columns.
    Rows whose text has no words all stay."""
    found = classes(docs, threshold, width)
    gone = found.where("row_key <> keep_key").select(F.col("row_key").alias("_cv_rk")).distinct()
    again = found.where("copies > 1 and row_key = keep_key").groupBy(F.col("row_key").alias("_cv_rk")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_cv_rk")
    keyed = docs.withColumn("_cv_rk", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    # `gone` and `again` are hash tables of row keys; rows repeated in full are rare and dealt with apart.
    repeated = keyed.join(again, "_cv_rk", "left_semi").dropDuplicates(["_cv_rk"])
    once = keyed.join(gone.union(again), "_cv_rk", "left_anti")
    return once.unionByName(repeated).drop("_cv_rk")
