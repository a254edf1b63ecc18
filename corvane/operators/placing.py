"""Running totals in an order over a whole table, without a task that sees all rows: ranges are sorted apart, and a range begins
at the sum of those before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import checkpointed


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with, for each name in sums, the sum of that column over all rows before, in the order; rows of equal order are put
    in the order of their columns' hash. Rows are range-partitioned and checkpointed, so that reruns find the same ranges; nulls
    add nothing; an empty table stays empty. The totals of ranges, one row each, meet in one window."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.withColumns({k: c for k, c in zip(keys, order, strict=True)} | {"_tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])} | {f"_s_{k}": F.coalesce(c.cast("long"), F.lit(0)) for k, c in sums.items()})
    dealt = checkpointed(keyed.repartitionByRange(n, *keys, "_tie").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    starts = starts.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*keys, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range
    met = dealt.join(F.broadcast(starts), "_range")
    return met.withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_s_{k}").over(inside), F.lit(0)) for k in sums}).select(*df.columns, *sums)
