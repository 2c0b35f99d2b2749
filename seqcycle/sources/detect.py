"""Formats and sample names of input paths."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import sequences
from .shared import qualified
from .streams import opened

#: Suffixes of formats, and of mates in the order in which they are tried.
_SUFFIXES = {"fastq": (".fastq", ".fq"), "fasta": (".fasta", ".fa", ".fna"), "bam": (".bam",), "sam": (".sam",), "cram": (".cram",)}
_MATES = ("_R1", "_R2", "_1", "_2", ".R1", ".R2", ".1", ".2")


def by_name(path: str) -> str | None:
    name = path.lower().removesuffix(".gz")
    return next((kind for kind, ends in _SUFFIXES.items() if name.endswith(ends)), None)


def by_content(path: str) -> str | None:
    """FASTA or FASTQ by the first character that is no white space."""
    with opened(path) as f:
        for line in f:
            if line.strip():
                return {b">": "fasta", b"@": "fastq"}.get(line.strip()[:1])
    return None


def kind(paths: list[str], forced: str = "auto") -> str:
    """The one format of all paths; an error if there is none or several."""
    if forced != "auto":
        return forced
    found = {p: by_name(p) or by_content(p) for p in paths}
    for path, k in found.items():
        if k is None:
            raise ValueError(f"the format of {path} is unknown")
    if len(set(found.values())) != 1:
        raise ValueError(f"inputs of several formats: {sorted(set(found.values()))}")
    return next(iter(found.values()))


def reads(spark: SparkSession, path: str, *, forced: str = "auto", which: str = "r1", **records: bool) -> DataFrame:
    """Reads of a path, of a comma-separated pair of FASTQ files, or of alignments in sequenced orientation (``records`` says which kinds of them, as ``as_reads`` does)."""
    paths = path.split(",")
    found = kind([qualified(spark, p) for p in paths], forced)
    if len(paths) == 2 and found == "fastq":
        return sequences.paired(spark, *paths, which)
    if found in ("sam", "bam", "cram"):
        return sequences.as_reads(sequences.sam(spark, paths) if found == "sam" else sequences.bam(spark, paths), **records)
    return sequences.fasta(spark, paths) if found == "fasta" else sequences.fastq(spark, paths)


def _stem(path: str, *, mates: bool) -> str:
    name = os.path.basename(path)
    end = next((e for ends in _SUFFIXES.values() for e in ends if name.lower().removesuffix(".gz").endswith(e)), "")
    if name.lower().endswith(".gz") and end:
        name = name[:-3]
    name = name[: len(name) - len(end)] if end else os.path.splitext(name)[0]
    if mates:
        for mate in _MATES:
            if name.endswith(mate):
                return name[: -len(mate)]
    return name


def sample_name(path: str) -> str:
    """A name from the path: without suffixes of format and mate; for a pair, what both have in common if that is 3 characters or more."""
    paths = path.split(",")
    names = [_stem(p, mates=by_name(p) not in ("bam", "sam", "cram", "fasta")) for p in paths]
    if len(names) == 1:
        return names[0]
    shared = os.path.commonprefix(names)
    return shared if len(shared) >= 3 else names[0]
