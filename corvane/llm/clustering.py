"""Centroid clustering of integer vectors by Lloyd's rounds with Elkan's bounds.

Each vector carries an upper bound of the distance to its centroid and a lower bound for every centroid, in a table that
every round writes anew. A round moves the bounds by how far the centroids went, passes over vectors whose upper bound
is below half the way to the next centroid, and computes a distance only if the bounds and the ways between centroids
leave it open. Bounds are rounded outwards and a centroid is ruled out only if it is strictly farther, so ties fall as
without bounds; distances are exact integers. Tasks send one sum a centroid, so what moves doesn't grow with the vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import dropped, written

SCALE, DIMENSIONS, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Components beyond this have squared distances that a long can't hold.
LARGEST = 1 << 27
STATE = "vec_id long, v binary, own int, distance long, upper double, lower binary, computed int, members long, sums array<long>, inertia decimal(38,0)"


def scaled(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as longs; one out of range raises an error, as its distance is no long."""
    x = lambda c: F.floor(c.cast("double") * F.lit(float(scale)))
    return F.transform(v, lambda c: F.when(F.abs(c.cast("double")) * scale < LARGEST, x(c)).otherwise(F.raise_error(F.lit("a component is too large to cluster")).cast("long")))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def root_up(n: np.ndarray) -> np.ndarray:
    return up(np.sqrt(up(n.astype(np.float64))))


def root_down(n: np.ndarray) -> np.ndarray:
    return down(np.sqrt(down(n.astype(np.float64))))


class Centroids:
    """The centroids of a round, half the ways between them (rounded down), and how far each has come (rounded up)."""

    def __init__(self, rows: np.ndarray, before: np.ndarray | None = None):
        self.rows = rows
        n = squared(np.repeat(rows, len(rows), axis=0), np.tile(rows, (len(rows), 1))).reshape(len(rows), -1)
        self.half = down(root_down(n) / 2)
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1)
        self.moved = np.zeros(len(rows)) if before is None else np.where((rows == before).all(axis=1), 0.0, root_up(squared(rows, before)))


def assign(x: np.ndarray, c: Centroids, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """Nearest centroids (the smaller number of equals), exact squared distances, both kinds of bounds, and the number of
    distances computed for each vector. Without bounds every one is computed."""
    n, k = len(x), len(c.rows)
    if own is None:
        distance = np.stack([squared(x, row) for row in c.rows], axis=1)
        own = distance.argmin(axis=1)
        best = distance[np.arange(n), own]
        return own, best, root_up(best), root_down(distance), np.full(n, k)
    own, upper, lower = own.copy(), up(upper + c.moved[own]), down(lower - c.moved)
    computed = np.zeros(n, np.int64)
    # the way to its own centroid is needed anyway: the last round's distances are results
    best = squared(x, c.rows[own])
    computed += 1
    upper = np.minimum(upper, root_up(best))
    lower[np.arange(n), own] = root_down(best)
    open_ = np.flatnonzero(upper >= c.nearest[own])
    for j in range(k):
        some = open_[(own[open_] != j) & (lower[open_, j] <= upper[open_]) & (c.half[own[open_], j] <= upper[open_])]
        if not len(some):
            continue
        d = squared(x[some], c.rows[j])
        computed[some] += 1
        lower[some, j] = root_down(d)
        nearer = (d < best[some]) | ((d == best[some]) & (j < own[some]))
        at = some[nearer]
        own[at], best[at], upper[at] = j, d[nearer], root_up(d[nearer])
    return own, best, upper, lower, computed


def _round(sent, dimensions: int, last: bool):
    """A batch's vectors with new centroids and bounds, and after the batches of a task a row of sums for each centroid."""
    names = [f.split()[0] for f in STATE.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.decimal128(38, 0)]

    def run(batches):
        c: Centroids = sent.value
        k = len(c.rows)
        members, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), np.int32).reshape(-1, dimensions).astype(np.int64)
            bounds = (None, None, None)
            if b.column("own").null_count == 0:
                bounds = (b.column("own").to_numpy(), b.column("upper").to_numpy(), np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float64).reshape(-1, k))
            own, best, upper, lower, computed = assign(x, c, *bounds)
            members += np.bincount(own, minlength=k)
            np.add.at(sums, own, x)
            for j in range(k):
                inertia[j] += sum(best[own == j].tolist())
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.nulls(len(x), pa.binary()) if last else b.column("v"), pa.array(own.astype(np.int32)), pa.array(best), pa.array(upper),
                 pa.nulls(len(x), pa.binary()) if last else pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(computed.astype(np.int32)), none, pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.decimal128(38, 0))],
                names=names,
            )
        rows = [(None, None, j, None, None, None, None, int(members[j]), sums[j].tolist(), inertia[j]) for j in range(k) if members[j]]
        yield pa.RecordBatch.from_arrays([pa.array(list(col), kind) for col, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return run


def _packed(batches):
    """Vectors as 32-bit integers in a row."""
    for b in batches:
        v = b.column("v").flatten().to_numpy().astype(np.int32)
        width = len(v) // b.num_rows if b.num_rows else 0
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([v[i * width : (i + 1) * width].tobytes() for i in range(b.num_rows)], pa.binary())], names=["vec_id", "v"])


def _totals(state: DataFrame, k: int, dimensions: int) -> tuple[list[int], np.ndarray, list[int]]:
    """Members, sums and inertia of each centroid: k rows for each dimension come to the driver, already summed."""
    members, sums, inertia = [0] * k, np.zeros((k, dimensions), object), [0] * k
    each = state.where("sums IS NOT NULL").select("own", "members", "inertia", F.posexplode("sums").alias("i", "s"))
    for r in each.groupBy("own", "i").agg(F.sum("members").alias("m"), F.sum("inertia").alias("e"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        members[r["own"]], inertia[r["own"]], sums[r["own"], r["i"]] = r["m"], int(r["e"]), int(r["s"])
    return members, sums, inertia


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = 1, scale: int = SCALE) -> DataFrame:
    """Final centroid of each vector of `vectors` (vec_id, embedding) with exactly `dimensions` finite components.

    The centroids start as the k vectors with the smallest sha256 of `seed:vec_id` (of equal ids by components), fewer if
    there are fewer vectors. Empty centroids stay where they are. Null ids hash as the empty string and stay null; rows
    that repeat are vectors each; other vectors give no rows; an empty table gives none; other columns are ignored. A
    component of 2**27 / scale or more raises an error: squared distances wouldn't fit a long.

    Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and computed: distances of the last round.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & F.coalesce(finite, F.lit(False)))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = np.array([r["v"] for r in good.orderBy(order, "v").limit(k).collect()], np.int64)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed int"
    if not len(first):
        return spark.createDataFrame([], result)
    k = len(first)
    nulls = [F.lit(None).cast(t).alias(n) for n, t in (("own", "int"), ("upper", "double"), ("lower", "binary"))]
    state = good.mapInArrow(_packed, "vec_id long, v binary").select("vec_id", "v", *nulls)
    rows, before, old = first, None, None
    for turn in range(rounds + 1):
        sent = spark.sparkContext.broadcast(Centroids(rows, before))  # k rows
        state = written(state.mapInArrow(_round(sent, dimensions, turn == rounds), STATE), "clusters")
        if old is not None:
            dropped(old)
        old = state
        members, sums, inertia = _totals(state, k, dimensions)
        if turn < rounds:
            before, rows = rows, rows.copy()
            for j in range(k):
                if members[j]:
                    rows[j] = [s // members[j] for s in sums[j]]
            state = state.where("sums IS NULL").select("vec_id", "v", "own", "upper", "lower")
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows.tolist()]
    about = spark.createDataFrame([(j, int(inertia[j]), int(sum(inertia)), digests[j]) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    own = state.where("sums IS NULL").select("vec_id", F.col("own").alias("cluster"), "distance", "computed")
    return own.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")
