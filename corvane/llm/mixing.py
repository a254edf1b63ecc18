"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, row_hashes, unit, written

#: A size class of a source is numbered in this many parts, so that no task sorts a whole class.
PARTS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Integer classes that keep order: exact below 64, then 32 to each doubling."""
    bits = F.length(F.bin(size))
    return F.when(size < 64, size).otherwise(bits * 64 + F.call_function("shiftright", size, (bits - 6).cast("int"))).cast("long")


def targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """totals (_source, source_size) with target and _rate. Source k by code point, null last, has weight
    weights[k mod len]; the sources share `share` times all sizes by weight, none above `most` times its own
    size, the excess going to the others by weight. One row a source, already summed."""
    by_name = Window.orderBy("_source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.select("_source", "source_size", w.alias("_w"), (F.lit(float(most)) * F.col("source_size")).alias("_cap"))
    everything = Window.partitionBy()
    t = t.withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everything).cast("double"))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    t = t.withColumn("_capped", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_open", F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("_budget") - F.col("_capped")) / F.col("_open")
    # The water level: of the first source that stays below its cap; if none does, all stand at their caps.
    t = t.withColumn("_level", F.min(F.when(level * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_source"), level.alias("level")))).over(everything)["level"])
    t = t.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return t.select("_source", "source_size", "target", rate.alias("_rate"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11, key: str | None = None) -> DataFrame:
    """Copies that each row of docs (doc_id, text, source) gets in the mix.

    Within a source, rows stand in order of size class and md5(id); a row's expected copies are its source's
    rate, their prefix sums start at one random offset, and a row is taken once for each integer that its
    step crosses. So a source's share comes near its target in words, and the copies of a row differ from
    its rate by less than 1. Null texts have size 0; a null source is a source of its own; rows that repeat
    are counted before the shuffle and then stand next to each other; empty tables give no rows; other
    columns are ignored. Reruns agree, as every draw is a hash.

    Returns doc_id, source, size, source_size, target, copies, and the column `key` of docs if one is named, which
    then tells rows apart that are otherwise alike.
    """
    # 's' + name sorts by code point, and before the 'z' of null.
    own = [key] if key else []
    name = F.when(F.col("source").isNull(), "z").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = docs.select("doc_id", *own, name.alias("_source"), word_count(F.col("text")).alias("size"))
    # Written, as counts and ranks both read it: texts are read and counted once.
    once = written(rows.groupBy("doc_id", *own, "_source", "size").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    once = once.select("*", size_class(F.col("size")).alias("_class"), digest.alias("_h"), (F.conv(F.substring(digest, 1, 3), 16, 10).cast("int") % PARTS).alias("_part"))
    counts = once.groupBy("_source", "_class", "_part").agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.col("size")).alias("_words"))
    classes = counts.groupBy("_source", "_class").agg(F.sum("_m").alias("_k"), F.sum("_words").alias("_words"))
    totals = classes.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    plan = targets(totals, weights, share, most)
    upto = (Window.unboundedPreceding, -1)
    class_start = classes.select("_source", "_class", F.coalesce(F.sum("_k").over(Window.partitionBy("_source").orderBy("_class").rowsBetween(*upto)), F.lit(0)).alias("_c0"))
    part_start = counts.select("_source", "_class", "_part", F.coalesce(F.sum("_m").over(Window.partitionBy("_source", "_class").orderBy("_part").rowsBetween(*upto)), F.lit(0)).alias("_p0"))
    inside = Window.partitionBy("_source", "_class", "_part").orderBy("_h", "doc_id", "size", *own).rowsBetween(*upto)
    # The joined tables hold counts: at most classes x PARTS rows a source, one row a key.
    starts = part_start.join(class_start, ["_source", "_class"]).join(plan, "_source")
    ranked = once.withColumn("_base", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["_source", "_class", "_part"])
    each = ranked.select(
        "doc_id", *own, "_source", "size", "source_size", "target", "_rate", (F.col("_c0") + F.col("_p0") + F.col("_base")).alias("_first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i"),
    )
    offset = unit(F.concat_ws(":", F.lit(str(seed)), F.col("_source")))
    rank = (F.col("_first") + F.col("_i")).cast("double")
    copies = F.floor((rank + 1) * F.col("_rate") + offset) - F.floor(rank * F.col("_rate") + offset)
    return each.select(
        "doc_id", F.when(F.col("_source") != "z", F.substring(F.col("_source"), 2, 2147483647)).alias("source"), "size", "source_size",
        "target", F.least(copies, F.lit(int(most)).cast("long")).cast("long").alias("copies"), *own,
    )


def take(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """The mix itself: every row of docs as often as mix() takes it, with all its columns, whatever their names.

    Rows alike in all columns count as one that is there several times; null ids, texts and sources, repeated rows and
    empty tables are dealt with as in mix(). Rows are told apart by two 64-bit hashes of all columns."""
    keyed = docs.withColumn("_cv_rk", row_hashes(docs))
    counted = mix(keyed.select("doc_id", "source", "text", "_cv_rk"), weights, share, most, seed, "_cv_rk")
    copies = counted.groupBy("_cv_rk").agg(F.sum("copies").alias("_cv_copies"), F.count(F.lit(1)).alias("_cv_rows")).where("_cv_copies > 0")
    # Rows that are there several times go through one of them, with all their copies.
    joined = keyed.join(copies, "_cv_rk")
    alike = joined.where("_cv_rows > 1").dropDuplicates(["_cv_rk"])
    chosen = joined.where("_cv_rows = 1").unionByName(alike)
    return chosen.withColumn("_cv_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_cv_copies")))).drop("_cv_rk", "_cv_copies", "_cv_rows", "_cv_i")
