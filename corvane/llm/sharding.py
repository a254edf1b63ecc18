"""Sharding by rendezvous hashing: stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import unit, written

#: Slots are numbered within this many hash ranges of each shard, so that no task sorts a whole shard.
RANGES = 1024


def shard_scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """One score per shard: -weight / ln(u), u drawn from the key and the shard's number. The largest wins."""
    return [F.lit(float(-w)) / F.log(unit(F.concat_ws(":", key, F.lit(str(i))))) for i, w in enumerate(weights)]


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Shards may be added or reweighted: a row moves only into a shard that grew
    or out of one that shrank. A null key counts as the empty string; weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = F.array(*shard_scores(F.coalesce(key.cast("string"), F.lit("")), weights))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def place(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """One row for every row of docs (doc_id, text): its shard, its slot there, and its shard under `grown`.

    Size is the UTF-8 length plus 1; a null text has length 0 and the crc32 of the empty string. Repeated
    rows are counted before the shuffle and given successive slots; rows with a null id share a shard (the
    id decides). An empty table gives no rows; other columns are ignored. Slots of a shard run from 0
    without gaps, in the order of md5(id:crc).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    )
    # Written, as counts and slots both read it: texts are read once.
    once = written(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n")), "keys")
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    once = once.select(
        "*",
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
        digest.alias("_h"),
        (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % RANGES).alias("_range"),
    )
    counts = once.groupBy("shard", "_range").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x RANGES rows, whatever the input.
    starts = counts.select("shard", "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_range").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("_base", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "_range"])
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("_start") + F.col("_base")).alias("_first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i"),
    ).select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_i")).cast("long").alias("slot"), "grown_shard")
