"""Lengths and k-mer counts over reads that keep arriving; both are sums, so a running query updates them as a batch would compute them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import counts


def arriving(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    """Parquet tables of reads as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def length_histogram(reads: DataFrame) -> DataFrame:
    return counts.length_histogram(reads)


def kmer_counts(reads: DataFrame, k: int = 1) -> DataFrame:
    return counts.kmer_counts(reads, k)


def windowed_counts(events: DataFrame, *, time: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) of fixed windows of event time; rows later than ``late`` are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), key, "n")


def run_to_end(rows: DataFrame, name: str, checkpoint: str, *, mode: str = "complete") -> StreamingQuery:
    """Processes what has arrived, into a table in memory, and stops."""
    query = rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
