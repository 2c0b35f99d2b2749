"""Files that one task reads from start to end, whatever file system they are on."""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import is_blocked

BATCH = 4096


def located(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + unquote(path[len("file:") :]).lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """The bytes of a file; ``.gz`` and ``.bam`` (a sequence of gzip members) are decompressed."""
    system, name = located(path)
    raw = io.BufferedReader(system.open_input_stream(name, compression=None), 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if path.lower().endswith((".gz", ".bam")) else raw


def seekable(path: str) -> io.BufferedReader:
    """The bytes of a plain file, to seek in."""
    system, name = located(path)
    return io.BufferedReader(system.open_input_file(name), 1 << 20)


def _blocked(path: str) -> bool:
    with seekable(path) as stream:
        return is_blocked(stream)


def ranges(paths: list[str], size: int) -> list[str]:
    """Names of byte ranges, ``FIRST-END PATH``, in the order of the input: plain and block-compressed files in parts of ``size`` bytes, other compressed ones whole (``0-``)."""
    out = []
    for path in paths:
        system, name = located(path)
        if path.lower().endswith((".gz", ".bam")) and not _blocked(path):
            out.append(f"0- {path}")
        else:
            total = system.get_file_info(name).size or 0
            out += [f"{at}-{min(at + size, total)} {path}" for at in range(0, max(total, 1), size)]
    return out


def records(spark: SparkSession, paths: list[str], parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``parse`` yields for each path (or range of one), one task for each, in batches; nothing holds a whole file.

    Paths are URIs (``shared.qualified``), so that driver and executors mean the same file.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "map<string": pa.map_(pa.string(), pa.string())}
    types = [kinds[c.strip().split()[1]] for c in schema.replace("map<string,string>", "map<string").split(",")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[n.split("<")[0] for n in names][: len(types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for path in given.column(0).to_pylist():
                rows: list[tuple] = []
                for row in parse(path):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1))
    return files.mapInArrow(run, schema)
