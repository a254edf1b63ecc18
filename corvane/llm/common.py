"""Shared helpers: durable tables, deterministic hashing columns and vectorised tokenising of Arrow text."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text worked on at once by the vectorised helpers; bounds their temporaries, never a text.
SLICE_BYTES = 2_000_000

_LUT = np.zeros(256, bool)
_LUT[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's spark.checkpoint.dir; in local mode one of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of this application's tables; they go when the driver ends.
_own: set[str] = set()


def _removed(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM is gone already
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        atexit.register(_removed, spark, own)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Shuffle files that nothing refers to any more go when the driver's JVM next collects its garbage.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives memory that a worker's earlier tasks have freed back to the system; workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unit(text: Column) -> Column:
    """A number in (0, 1) from md5 of text: 52 bits, the same in every engine."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def row_hashes(df: DataFrame) -> Column:
    """A struct of two 64-bit hashes of all columns: equal rows, equal hashes. Maps, which Spark doesn't hash, go as JSON."""
    cols = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    # A null leaves a hash as it was, so which columns are null is hashed too.
    nulls = F.concat_ws("", *[F.when(c.isNull(), "n").otherwise("v") for c in cols])
    return F.struct(F.xxhash64(nulls, *cols).alias("a"), F.xxhash64(F.lit(1), nulls, *cols).alias("b"))


def document_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def slices(arr: pa.Array, most: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) of pieces of a text column; nulls are empty; a text is never cut."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, len(arr))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def pieces(batches, text: str = "text", most: int = SLICE_BYTES):
    """The batches in parts of about `most` bytes of text, so that what a task makes of them stays small."""
    for batch in batches:
        n = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n, dtype=np.int64)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of every text."""
    solid = ~_LUT[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of (byte + 1) * base**i for s <= i < e, modulo 2**64."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: equal bytes, equal hash, wherever they stand."""
    _, q = powers(len(prefix))
    h = (prefix[ends] - prefix[starts]) * q[starts]
    return mixed(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
