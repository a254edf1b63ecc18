"""Connected components of an edge table, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import dropped, written

#: A node with more than a HUBS-th of all rows is a hub; there are fewer than HUBS of them.
HUBS = 1000


def _told(edges: DataFrame, told: DataFrame, most: float) -> DataFrame:
    """edges (a, b) with m of their a from told (a, m, n). Hubs, the a with n above `most`, are broadcast: their edges stay where they are."""
    hubs = told.where(F.col("n") > most).select("a", F.col("m").alias("_m"))
    marked = edges.join(F.broadcast(hubs), "a", "left")
    rest = marked.where("_m is null").select("a", "b").join(told.where(F.col("n") <= most).select("a", "m"), "a")
    return marked.where("_m is not null").select("a", "b", F.col("_m").alias("m")).unionByName(rest.select("a", "b", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a long, b long): root is the smallest node it is connected with.

    Each round links, for every node, its larger neighbours and then its smaller ones to the smallest of
    them; only minima are gathered, and the few hubs' minima go to their edges instead of the edges to them, so a
    hub's neighbours never meet in one task. Rounds grow with the logarithm of the components' size. Loops and
    repeated edges don't matter; no edges give no rows.
    """
    ordered = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = written(edges.where("a <> b").select(*ordered).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        most = 2 * state[0] / HUBS
        turned = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = now.union(turned).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _told(turned, least, most).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _told(large, low, most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = written(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        dropped(now)
        now = then
    child = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return child.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
