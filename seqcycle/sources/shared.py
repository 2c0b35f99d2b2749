"""New folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_fallback() -> str:
    folder = tempfile.TemporaryDirectory(prefix="seqcycle-")
    atexit.register(folder.cleanup)
    return f"file://{folder.name}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI: one without scheme is of the default file system, as Spark's own readers and writers take it, on the driver and on every executor."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path below ``spark.checkpoint.dir``; only a ``local[...]`` master, where all is one process, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{qualified(spark, base) if base else _local_fallback()}/seqcycle-{spark.sparkContext.applicationId}-files/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and returns the table that reads them: they are computed once, and a lost executor costs no more than a read."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not have been written yet; an empty one then."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder that this engine has written."""
    return sorted(spark.read.text(folder).inputFiles())


def text_lines(df: DataFrame, path: str, *, compression: str | None = None) -> None:
    writer = df.select("value").write
    (writer.option("compression", compression) if compression else writer).text(path)
