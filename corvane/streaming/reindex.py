"""Incremental re-indexing as a stream (an extension): a log of facts by micro-batch, with snapshots that take its place.

    facts_path/log/v=N/files, .../facts        what batch N held: its files with their versions, and their facts
    facts_path/snapshots/N/files, .../facts    the latest version of each file after batch N; written beside, then renamed

A file's latest version is that of the largest mtime, and of equal ones that of the last batch: an older version that comes
later changes nothing. Readers take the last snapshot and the batches after it; folders that these don't need aren't touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.extract import SCHEMA, facts
from corvane.operators.index import _system

_FILES = "path string, mtime long, v long"
_FACTS = SCHEMA + ", v long"


def _latest(files: DataFrame) -> DataFrame:
    return files.groupBy("path").agg(F.max(F.struct("mtime", "v")).alias("_x")).select("path", F.col("_x.mtime").alias("mtime"), F.col("_x.v").alias("v"))


def append_batch(facts_path: str):
    """A foreachBatch function: the batch's files and their facts, in a folder named by the batch, so that a batch that runs
    again writes the same folder. A batch costs what it holds, whatever the index holds already. Of a path that is there
    twice the row of the largest mtime counts, of equal ones that of the largest content; null paths and contents have no facts."""

    def run(batch: DataFrame, batch_id: int) -> None:
        mtime = F.col("mtime").cast("long") if "mtime" in batch.columns else F.lit(None).cast("long")
        rows = batch.where("path IS NOT NULL").select("path", mtime.alias("mtime"), "content")
        once = rows.groupBy("path").agg(F.max(F.struct("mtime", "content")).alias("_x")).select("path", F.col("_x.mtime").alias("mtime"), F.col("_x.content").alias("content"))
        where = f"{facts_path}/log/v={batch_id}"
        facts(once).withColumn("v", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{where}/facts")
        # written last: a batch without its files isn't read
        once.select("path", "mtime", F.lit(batch_id).cast("long").alias("v")).write.mode("overwrite").parquet(f"{where}/files")

    return run


def _numbers(spark: SparkSession, folder: str, prefix: str, needs: str) -> list[int]:
    """Numbers of a folder's complete parts, in order."""
    files, place = _system(spark, folder), spark._jvm.org.apache.hadoop.fs.Path
    if not files.exists(place(folder)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place(folder))]
    found = [n.removeprefix(prefix) for n in names if n.startswith(prefix)]
    return sorted(int(n) for n in found if n.isdigit() and files.exists(place(f"{folder}/{prefix}{n}/{needs}")))


def live(spark: SparkSession, facts_path: str) -> tuple[int | None, list[int]]:
    """The last snapshot, and the batches after it."""
    snapshots = _numbers(spark, f"{facts_path}/snapshots", "", "files/_SUCCESS")
    last = snapshots[-1] if snapshots else None
    return last, [v for v in _numbers(spark, f"{facts_path}/log", "v=", "files/_SUCCESS") if last is None or v > last]


def _tables(spark: SparkSession, facts_path: str) -> tuple[DataFrame, DataFrame]:
    last, batches = live(spark, facts_path)
    folders = [f"{facts_path}/snapshots/{last}"] * (last is not None) + [f"{facts_path}/log/v={v}" for v in batches]
    if not folders:
        return spark.createDataFrame([], _FILES), spark.createDataFrame([], _FACTS)
    read = lambda what, schema: spark.read.schema(schema).parquet(*[f"{f}/{what}" for f in folders])
    return read("files", _FILES), read("facts", _FACTS)


def current(spark: SparkSession, facts_path: str) -> DataFrame:
    """The facts of every file's latest version; a file whose latest version holds nothing has none."""
    files, found = _tables(spark, facts_path)
    return found.join(_latest(files), ["path", "v"], "left_semi").drop("v").select(*T.StructType.fromDDL(SCHEMA).names)


def compact(spark: SparkSession, facts_path: str) -> int | None:
    """Writes the state after the last batch as a snapshot and removes what the snapshot before it, or it, stands for.

    Returns its number, or None if there is no batch after the last snapshot. The snapshot is there as a whole or not at
    all: its folder is renamed when it is complete. The snapshot before stays until the next call, for readers that use it."""
    last, batches = live(spark, facts_path)
    if not batches:
        return None
    files, found = _tables(spark, facts_path)
    latest = _latest(files)
    fs, place = _system(spark, facts_path), spark._jvm.org.apache.hadoop.fs.Path
    new, end = f"{facts_path}/new-{uuid.uuid4().hex}", f"{facts_path}/snapshots/{batches[-1]}"
    found.join(latest, ["path", "v"], "left_semi").select(*found.columns).write.parquet(f"{new}/facts")
    latest.write.parquet(f"{new}/files")
    fs.mkdirs(place(f"{facts_path}/snapshots"))
    if not fs.rename(place(new), place(end)):
        fs.delete(place(new), True)
        raise OSError(f"another snapshot took the place of {end}")
    for n in _numbers(spark, f"{facts_path}/snapshots", "", "files/_SUCCESS"):
        if last is not None and n < last:
            fs.delete(place(f"{facts_path}/snapshots/{n}"), True)
    for v in _numbers(spark, f"{facts_path}/log", "v=", "files/_SUCCESS"):
        if last is not None and v <= last:
            fs.delete(place(f"{facts_path}/log/v={v}"), True)
    return batches[-1]


def reindex(files: DataFrame, facts_path: str, checkpoint: str) -> StreamingQuery:
    """files: a stream of (path, content) or (path, content, mtime). Batches are numbered by the stream's checkpoint."""
    return files.writeStream.foreachBatch(append_batch(facts_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
