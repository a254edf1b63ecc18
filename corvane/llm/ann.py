"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

The driver fits centroids and codebooks on a bounded sample; every vector gets the list of its nearest centroid,
its part along the centroid as a number, the code of what remains of its residual, and the length of that code's error.
A query opens the lists whose centroids promise the largest inner products, ranks their members by asymmetric distance
tables, and reranks by the exact inner product in double precision the best, and all whose estimate lies within MARGIN
standard errors of the k-th best of these. How many lists are opened is measured on sampled rows that the centroids were
not fitted on, so it follows the table.
Lists are packed into groups of bounded size (large lists are cut by hash), so that tasks hold a bounded number
of vectors and a query returns its nearest once a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.ngram_join import _groups

#: Rows that centroids and codebooks are fitted on: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
MOST_LISTS, ROUNDS = 4096, 8
#: Dimensions of a code's part, centroids of a codebook, candidates reranked in a group at least, standard errors of an
#: estimate within which others are reranked too.
PART, CODES, RERANK, MARGIN = 4, 256, 100, 3.0
#: Lists are opened until they hold this share of the nearest of rows kept back from the fit: one of HELD_BACK, ASKED of which ask.
LIST_RECALL, HELD_BACK, ASKED = 0.975, 5, 1_000
GROUP_ROWS, QUERY_ROWS = 16_384, 2_048
#: Queries whose lists are opened at once: what this takes grows with the lists, and their copies go on in small batches.
OPEN_ROWS = 256
#: A query opens lists until they hold so many vectors more than it returns; its own rows may be among them.
SPARE = 100


def usable(v: Column) -> Column:
    """Not null, not zero, and every component finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def k_means(x: np.ndarray, k: int, seed: int = 5, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], len(c))
            c[n > 0, d] = s[n > 0] / n[n > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(axis=1) / 2
    step = max(64, 2_000_000 // len(c))  # bounds the temporary
    for lo in range(0, len(x), step):
        out[lo : lo + step] = (x[lo : lo + step] @ c.T - half).argmax(axis=1)
    return out


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # a codebook for each part
    edges: list[int]
    spread: np.ndarray | None = None  # share of the codes' squared error in each dimension
    share: float = 1.0  # of the lists, that are opened

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, parts along the lists' directions, and lengths of the codes' errors."""
        lists = nearest(x, self.centroids)
        way = directions(self.centroids)[lists]
        r = across(x - self.centroids[lists], way)
        pieces = list(zip(self.edges[:-1], self.edges[1:], self.books, strict=True))
        codes = np.column_stack([nearest(r[:, a:b], book) for a, b, book in pieces])
        coded = np.column_stack([book[codes[:, p]] for p, (_, _, book) in enumerate(pieces)])
        # what a code has along the direction is known, so it is no error
        along = ((x - coded) * way).sum(axis=1)
        return lists, codes.astype(np.uint8), along, np.linalg.norm(r - across(coded, way), axis=1)


def directions(centroids: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(centroids, axis=1, keepdims=True)
    return centroids / np.where(length > 0, length, 1)


def across(x: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Rows of x without what they have along the directions of way."""
    return x - (x * way).sum(axis=1, keepdims=True) * way


def share_to_open(x: np.ndarray, c: np.ndarray, k: int, rows: int) -> float:
    """Share of the lists, in the order in which they are opened, that holds LIST_RECALL of the nearest of x's first rows among x.

    As many are nearest as the k of all rows make up of x: x is a sample, so its own k nearest lie farther away."""
    if len(x) < 64:
        return 1.0
    q = x[:ASKED]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, : max(1, min(len(x) - 1, round(k * len(x) / rows)))]
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)
    reached = np.take_along_axis(place, nearest(x, c)[best], axis=1)
    return float(np.quantile(reached, LIST_RECALL, method="higher") + 1) / len(c)


def fit(vectors: DataFrame, rows: int, k: int = 20) -> Index | None:
    """vectors (vec_id, v array<double>), all of one dimension, without nulls; repeated vectors count each. None if there are none."""
    got = vectors.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(FIT_ROWS).toArrow()
    if not got.num_rows:
        return None
    all_ = np.array(got.column("v").combine_chunks().flatten().to_numpy()).reshape(got.num_rows, -1)
    kept = len(all_) // HELD_BACK
    x = all_[kept:]
    c = k_means(x, max(1, min(MOST_LISTS, int(4 * np.sqrt(rows)), len(x) // 8)))
    lists = nearest(x, c)
    r = across(x - c[lists], directions(c)[lists])
    edges = [*range(0, x.shape[1], PART), x.shape[1]]
    books = [k_means(r[:, a:b], CODES, a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    error = np.concatenate([((r[:, a:b] - book[nearest(r[:, a:b], book)]) ** 2).mean(axis=0) for a, b, book in zip(edges[:-1], edges[1:], books, strict=True)])
    spread = error / error.sum() if error.sum() > 0 else np.full(len(error), 1 / len(error))
    return Index(c, books, edges, spread, share_to_open(all_[:kept], c, k, rows))


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _encode(sent):
    def run(batches):
        index = sent.value
        for b in batches:
            if b.num_rows:
                lists, codes, along, error = index.encode(_matrix(b.column("v"), index.dim))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(along), pa.array(error), b.column("v")],
                    names=["vec_id", "list", "code", "along", "error", "v"],
                )

    return run


def _open(sent, group_of: np.ndarray, cut: np.ndarray, sizes: np.ndarray, share: float, least: int):
    """Each query once for every group that holds a list it opens, with the lists: a share of all, and as many as it takes
    to hold `least` vectors."""

    def run(batches):
        index = sent.value
        n = max(1, min(len(index.centroids), int(np.ceil(len(index.centroids) * share))))
        for b in (whole.slice(lo, OPEN_ROWS) for whole in batches for lo in range(0, whole.num_rows, OPEN_ROWS)):
            q = _matrix(b.column("v"), index.dim)
            ids = b.column("vec_id").to_pylist()
            near = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
            held = np.cumsum(sizes[near], axis=1)
            best = [near[i, : max(n, int(np.searchsorted(held[i], least)) + 1)] for i in range(len(near))]
            rows, gs, cs, ls = [], [], [], []
            for i in range(len(ids)):
                g = group_of[best[i]]
                for one in np.unique(g):
                    mine = best[i][g == one].astype(np.int32)
                    for c in range(int(cut[mine].max())):
                        rows.append(i)
                        gs.append(one)
                        cs.append(c)
                        ls.append(mine.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(gs, pa.int32()), pa.array(cs, pa.int32()), pa.array([ids[i] for i in rows], pa.int64()), pa.array(ls, pa.binary()), b.column("v").take(pa.array(rows, pa.int64()))],
                names=["g", "c", "vec_id", "code", "v"],
            )

    return run


def _search(sent, k: int):
    def run(batches):
        index = sent.value
        way = directions(index.centroids)
        for t in _groups(batches, ["g", "c", "qb"]):
            key = np.column_stack([t.column(x).to_numpy() for x in ("g", "c", "qb")])
            edge = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [t.num_rows]))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                part = t.slice(lo, hi - lo)
                asks = part.column("query").to_numpy(zero_copy_only=False)
                rows, queries = part.filter(pa.array(~asks)), part.filter(pa.array(asks))
                if not rows.num_rows or not queries.num_rows:
                    continue
                ids, lists = rows.column("vec_id").to_numpy(), rows.column("list").to_numpy()
                order = np.lexsort((ids, lists))
                ids, lists = ids[order], lists[order]
                x = _matrix(rows.column("v"), index.dim)[order]
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                along, error = rows.column("along").to_numpy()[order], rows.column("error").to_numpy()[order]
                q = _matrix(queries.column("v"), index.dim)
                q_ids = queries.column("vec_id").to_pylist()
                out_q, out_v, out_s = [], [], []
                begin = np.searchsorted(lists, np.arange(len(index.centroids) + 1))
                for i, opened in enumerate(queries.column("code").to_pylist()):
                    opened = np.frombuffer(opened, np.int32)
                    n = begin[opened + 1] - begin[opened]
                    at = np.repeat(begin[opened] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    if not len(at):
                        continue
                    toward = way[opened] @ q[i]
                    near = np.repeat(toward, n) * along[at]
                    for p, book in enumerate(index.books):
                        near += (book @ q[i, index.edges[p] : index.edges[p + 1]])[codes[at, p]]
                    # the standard error of an estimate: of a code's error in a random direction, met by what q has across the list's
                    doubt = np.sqrt((q[i] - toward[:, None] * way[opened]) ** 2 @ index.spread)
                    most = near + MARGIN * np.repeat(doubt, n) * error[at]
                    if (other := ids[at] != q_ids[i]).sum() < len(at):
                        at, near, most = at[other], near[other], most[other]
                    # row by row in one order of additions, so that equal vectors have equal scores wherever they stand
                    score = lambda rows: (x[rows] * q[i]).sum(axis=1)  # noqa: B023, E731
                    if len(at) > max(RERANK, k):
                        first = np.argpartition(near, len(near) - max(RERANK, k))[len(near) - max(RERANK, k) :]
                        sure = np.zeros(len(at), bool)
                        sure[first] = True
                        exact = score(at[first])
                        sure |= most >= np.partition(exact, len(exact) - k)[len(exact) - k]
                        at = at[sure]
                    if not len(at):
                        continue
                    exact = score(at)
                    best = np.lexsort((ids[at], -exact))[:k]
                    out_q += [q_ids[i]] * len(best)
                    out_v.append(ids[at][best])
                    out_s.append(exact[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], names=["query_id", "vec_id", "score"])

    return run


def neighbours(table: DataFrame, queries: Column, k: int = 20, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row of table (vec_id, embedding)
    that `queries` picks, among all rows with another id; ties go to the smaller vec_id. `share` of the lists are opened; unless it
    is given, as many as rows kept back from the fit need.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of another
    dimension than most, nor null ids. A repeated id is several candidates, and asks once, with the least of its vectors. Fewer
    than k candidates: all that there are. An empty table gives no rows. Other columns are ignored.
    """
    spark = table.sparkSession
    good = table.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    result = "query_id long, vec_id long, score double"
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    good = good.where(F.size("v") == (dims["d"] if dims else 0))
    index = fit(good, dims["n"], k) if dims else None
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(index)  # bounded by MOST_LISTS and the codebooks
    coded = good.mapInArrow(_encode(sent), "vec_id long, list int, code binary, along double, error double, v array<double>")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["n"]
    # Neighbouring lists go together: along the direction in which centroids vary most.
    _, _, axes = np.linalg.svd(index.centroids - index.centroids.mean(axis=0), full_matrices=False)
    group_of, cut = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32)
    g, held = 0, 0
    for at in np.argsort(index.centroids @ axes[0], kind="stable"):
        if held and held + sizes[at] > GROUP_ROWS:
            g, held = g + 1, 0
        group_of[at], cut[at] = g, max(1, -(-int(sizes[at]) // GROUP_ROWS))
        held += sizes[at]
    places = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(group_of, cut, strict=True))], "list int, g int, cut int")
    rows = coded.join(F.broadcast(places), "list").select("g", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("cut").cast("long")).cast("int").alias("c"), "vec_id", "list", "code", "along", "error", "v")
    asking = good.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asks = asking.mapInArrow(_open(sent, group_of, cut, sizes, index.share if share is None else share, k + SPARE), "g int, c int, vec_id long, code binary, v array<double>")
    none = F.lit(None).cast("double")
    blocks = asks.groupBy("g", "c").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("_b"))
    asks = asks.join(blocks, ["g", "c"]).select("g", "c", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("_b").cast("long")).cast("int").alias("qb"), F.lit(True).alias("query"), "vec_id", F.lit(None).cast("int").alias("list"), "code", none.alias("along"), none.alias("error"), "v")
    rows = rows.join(blocks, ["g", "c"]).select("g", "c", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("qb"), F.lit(False).alias("query"), "vec_id", "list", "code", "along", "error", "v")
    keys = ["g", "c", "qb"]
    both = rows.unionByName(asks).repartition(*keys).sortWithinPartitions(*keys, "query", "vec_id")
    found = both.mapInArrow(_search(sent, k), result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
