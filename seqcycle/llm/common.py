"""What the operators of this subpackage share: the shared folder, written tables, word hashes, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_fallback() -> str:
    folder = tempfile.TemporaryDirectory(prefix="seqcycle-")
    atexit.register(folder.cleanup)
    return f"file://{folder.name}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a ``local[...]`` master, where both are one process, may leave it unset; then a temporary folder serves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))  # a path without scheme is one of the default file system
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_fallback()


@lru_cache(maxsize=8)
def _session_folder(base: str, application: str) -> str:
    """A folder of this application in the shared one; the file system deletes it when the driver ends."""
    from pyspark import SparkContext

    jvm, context = SparkContext._active_spark_context._jvm, SparkContext._active_spark_context
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/seqcycle-{application}")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return path.toString()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{_session_folder(shared_dir(spark), spark.sparkContext.applicationId)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet in the shared folder and returns the table that reads them.

    No marker file is left: to set its permissions, the driver would start processes that share its memory for a moment.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    options = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}  # the buffers of zstd are pooled on the heap
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], column: int = 0, *, rows: int = 1000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and about ``size`` bytes of a column of texts or bytes (a longer value is a part of its own).

    What a task derives from a part is then bounded, however large the session's batches are.
    """
    for batch in batches:
        if batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.maximum.accumulate(np.maximum((np.cumsum(lengths) - 1) // size, 0)) + np.arange(len(lengths)) // rows
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                yield batch.slice(start, end - start)


def by_row(values: pa.Array, function: Callable, kind: pa.DataType) -> pa.Array:
    """``function`` of each value, made Python's one at a time."""
    return pa.array((function(v.as_py()) for v in values), kind)


def hashed_sample(df: DataFrame, key: str, count: int, rows: int) -> DataFrame:
    """The ``rows`` rows of the smallest hashes of ``key``, in that order; ``count`` is the number of rows of ``df``.

    Rows far above the hash that so many are expected below are left out first, so that tasks send on about twice ``rows`` rows in all rather
    than ``rows`` each. Should fewer than ``rows`` pass, as one key of many rows may cause, the sample is that much smaller.
    """
    place = F.xxhash64(F.lit("sample"), key)
    if count > 2 * rows:
        df = df.where(place < int(-(2**63) + 2**64 * (2 * rows / count)))
    return df.orderBy(place, *df.columns).limit(rows)


def in_few(df: DataFrame, rows: int, a_file: int = 500_000) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in as many partitions as they fill, so that a small table is not written in as many files as there are shuffle partitions."""
    return df.coalesce(max(1, -(-rows // a_file)))


def remove(table: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read again."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets everything at ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 60_000):
        self.limit = limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list) -> np.ndarray:
        """Hashes of a text's words, computed anew: where most words are new, that takes a fourth of the time of looking them up."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int, dtype=np.uint64) -> np.ndarray:
    """``n`` fixed odd multipliers derived from ``seed``."""
    base = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (base | np.uint64(1)).astype(dtype)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each linked node with the smallest node that links reach from it.

    ``edges`` has two long columns ``a`` and ``b``. Alternates the large-star and small-star steps, each a grouped
    minimum and a join, until the edges stay as they are; they then form stars around the roots. Every round is
    written to the shared folder, so nothing is recomputed when an executor is lost, and nothing is collected.
    """
    stars = written(
        edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges"
    )
    state = _fingerprint(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u < v")
            .distinct()
        )
        after = written(in_few(small, state[0]), "edges")
        before, state = state, _fingerprint(after)
        remove(stars)
        stars = after
        if before == state:
            break
    return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
