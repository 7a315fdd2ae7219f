"""Pieces that several corpus operators share: input columns, scratch tables, byte-bounded slices."""

from __future__ import annotations

import ctypes
import functools
import struct
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquarry.llm.words import mixed
from lumenquarry.workers import bounded_batches

#: Where scratch tables go when the session names no shared folder: in local mode only (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of a row group in scratch tables: what a writer, or a reader of long values, holds at a time.
GROUP_BYTES = 16 << 20
#: Bits of a filter for each key, and at most (8 MB): beyond that more rows pass that need not.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 26
#: The C library's name of the size from which a block is its own mapping, and that size.
M_MMAP_THRESHOLD, LARGE_BYTES = -3, 1 << 20
#: Seconds between two calls to let Spark delete what finished jobs shuffled.
FREED_EVERY = 10.0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A generator that gives a worker's freed memory back to the machine: arrays of over LARGE_BYTES when they go, all else when it ends."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, LARGE_BYTES)  # fixed: else it rises to 32 MB, and holes in the heap stay
        except (AttributeError, OSError):
            pass  # another C library
        try:
            yield from f(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return run


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads; a null text becomes the empty text."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext.getCheckpointDir()
        root = found or LOCAL_CHECKPOINTS
        if not found:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lumenquarry-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "part", by: str | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends, and any executor can read it again. by: a column with a folder for each value."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    write = df.write.option("parquet.block.size", GROUP_BYTES)
    if by:
        with_writers(df.sparkSession, lambda: write.partitionBy(by).parquet(path))
    else:
        write.parquet(path)
    freed(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


_last_freed = 0.0


def freed(spark: SparkSession, every: float = FREED_EVERY) -> None:
    """Let Spark delete the shuffle files of jobs that are over.

    It does so when the driver's JVM collects their handles; with a large heap that may be half an hour
    later, and the files of all steps add up on the executors' disks.
    """
    global _last_freed
    if time.monotonic() - _last_freed >= every:
        spark._jvm.System.gc()
        _last_freed = time.monotonic()


class KeyFilter:
    """A Bloom filter of 64-bit keys: what it leaves out is not among them. Of others about one in 70 passes (more beyond MOST_FILTER_BITS)."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys.astype(np.int64).view(np.uint64))
        return tuple((x & np.uint64(bits - 1)).astype(np.int64) for x in (h, h >> np.uint64(32)))

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> KeyFilter:
        """Of a table's column without nulls, or'ed together in tasks; the table is read twice."""
        bits = 1 << 10
        while bits < min(MOST_FILTER_BITS, FILTER_BITS * keys.count()):
            bits *= 2

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(bits >> 6, np.uint64)
            for batch in batches:
                for p in cls.places(batch.column(0).to_numpy(), bits):
                    np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["place", "bits"])

        rows = keys.select(F.col(column).cast("long").alias("key")).mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys, len(self.words) << 6):
            out &= (self.words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out

    def column(self, spark: SparkSession) -> Callable[[Column], Column]:
        """A function of a column of integers without nulls: whether it may be among the keys."""
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def held(keys: pd.Series) -> pd.Series:
            return pd.Series(sent.value.holds(keys.to_numpy()))

        return held


def with_writers(spark: SparkSession, write: Callable[[], None], writers: int = 8) -> None:
    """Write with a file open for each of a few values at a time: else Spark sorts each task's rows by them first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, str(writers))
    try:
        write()
    finally:
        spark.conf.set(name, before)


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def dropped_kind(table: DataFrame, value: str, by: str = "kind") -> None:
    """Of a table saved by a column, delete the folder of a value that no later plan reads."""
    spark = table.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{table._scratch_path}/{by}={value}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def packed(a: np.ndarray) -> bytes:
    """Integers without a sign in as few bytes each as the largest needs, low bytes first, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * w)
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return struct.pack("<BQ", width, len(a)) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", b)
    planes = np.frombuffer(pa.decompress(pa.py_buffer(b)[9:], n * width, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def slices(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of `column`; a longer row stands alone."""
    start = size = 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        n = n or 0
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)
