"""The incremental index: staleness, upsert, persistence behind a version gate, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.paths import extension, language_id, skipped_for_servers
from corvane.operators.graph import bin_of, binned

VERSION = 3


def stale(now: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of now (path, mtime, size) that old lacks or has with another mtime or size."""
    was = old.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_known"))
    joined = now.join(was, "path", "left")
    return joined.where(F.col("_known").isNull() | ~F.col("mtime").eqNullSafe(F.col("_m")) | ~F.col("size").eqNullSafe(F.col("_s"))).drop("_m", "_s", "_known")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and what of old has no row of new's key. Null keys are no keys: such rows of both stay; repeated rows stay; either
    table may be empty."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def save(index: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet under path, each row with the format's version. All are written beside it first and
    then take its place, so an index may be saved over the one that it was read from. The index before stands beside it
    until the new one is there, and load() brings it back if a save was broken off in between."""
    spark = next(iter(index.values())).sparkSession
    new = f"{path}.new"
    for name, df in index.items():
        df.withColumn("_version", F.lit(VERSION)).write.mode("overwrite").parquet(f"{new}/{name}")
    place, files = spark._jvm.org.apache.hadoop.fs.Path, _system(spark, path)
    old = place(f"{path}.old")
    if files.exists(place(path)):
        files.delete(old, True)
        if not files.rename(place(path), old):
            raise OSError(f"cannot rename {path}")
    if not files.rename(place(new), place(path)):
        raise OSError(f"cannot rename {new} to {path}")
    files.delete(old, True)


def clear(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def _system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def load(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The tables; empty ones where there is no index or it has another version."""
    out, place, files = {}, spark._jvm.org.apache.hadoop.fs.Path, _system(spark, path)
    if not files.exists(place(path)) and files.exists(place(f"{path}.old")):
        files.rename(place(f"{path}.old"), place(path))
    for name, schema in schemas.items():
        full = T.StructType([*schema.fields, T.StructField("_version", T.IntegerType())])
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            out[name] = spark.read.schema(full).parquet(f"{path}/{name}").where(F.col("_version") == VERSION).drop("_version")
        else:
            out[name] = spark.createDataFrame([], schema)
    return out


def location_outcomes(facts: DataFrame, defs: DataFrame, root: str) -> DataFrame:
    """facts (file, pos, callee, target, at) with server (the caller's extension), outcome and the first definition that contains the location."""
    known = defs.select(F.col("file").alias("target"), F.lit(True).alias("_indexed")).distinct()
    key = ["file", "pos", "callee", "target", "at"]
    # facts that are alike in all columns (calls that differ elsewhere) are one row with their number
    once = facts.groupBy(*key).agg(F.count(F.lit(1)).alias("_times")).withColumn("_bin", bin_of(F.col("at")))
    spans = binned(defs.select(F.col("file").alias("_t"), "start_byte", "end_byte", F.col("name").alias("_name"))).withColumnRenamed("_bin", "_b")
    inside = (F.col("target") == F.col("_t")) & (F.col("_bin") == F.col("_b")) & (F.col("start_byte") <= F.col("at")) & (F.col("at") < F.col("end_byte"))
    # The first in the file, not the innermost.
    hit = F.min(F.when(F.col("_t").isNotNull(), F.struct("start_byte", F.col("_name").alias("name")))).alias("_hit")
    both = once.join(spans, inside, "left").groupBy(*key, "_times").agg(hit).join(known, "target", "left")
    outcome = (
        F.when(F.col("target").isNull(), "no_definition")
        .when(~F.col("target").startswith(root), "external")
        .when(F.col("_indexed").isNull(), "not_indexed")
        .when(F.col("_hit").isNull(), "no_match")
        .otherwise("resolved")
    )
    return both.select("file", "pos", "callee", "at", "target", F.regexp_extract("file", r"\.([^.]*)$", 1).alias("server"), outcome.alias("outcome"), F.col("_hit.name").alias("name"), "_times")


def requests(calls: DataFrame) -> DataFrame:
    """calls with server, the language id of their file's extension, for those that a language server is asked for: not in
    a skipped folder, and of a known language. A group of requests is the rows of one server."""
    return calls.where(~skipped_for_servers(F.col("file"))).withColumn("server", language_id(extension(F.col("file")))).where("server <> 'text'")


def server_report(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes by server, in the order of their names."""
    names = ("resolved", "external", "no_definition", "not_indexed", "no_match")
    each = [F.sum(F.when(F.col("outcome") == n, F.col("_times")).otherwise(0)).alias(n) for n in names]
    return outcomes.groupBy("server").agg(F.sum("_times").alias("total"), *each).orderBy("server")
