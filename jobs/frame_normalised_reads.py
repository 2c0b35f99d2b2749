"""Job 1: reads in codon frame. Alignments meet coding features; those that lie in one of their own strand are cut to whole codons, all others are kept with the reason why not.

    python -m jobs.frame_normalised_reads ALIGNMENTS FEATURES OUTPUT [--config FILE]

Inputs are tables of any columns; the configuration makes the job's columns of them by SQL expressions. The output is one Parquet table, partitioned by reason and contig,
so the corrected reads of a contig are ``reason=written/contig=...``. A rerun replaces the whole table and gives the same rows. A contig that
holds most reads is split over tasks, when it is joined (bins) and when it is written (a rebalance, which also spares small files).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcycle.operators import cds

from .common import columns, command, log

SCHEMA = "read_id string, flag int, ref_start long, ref_end long, cds_identifier string, cds_strand string, phase int, trim5 int, trim3 int, corrected string, reason string, contig string"


@dataclass(frozen=True)
class Config:
    """alignments: read_id, flag, mapq, contig, ref_start, ref_end, cigar, seq; features: contig, start, end, strand, phase, identifier."""

    alignments: dict[str, str] = field(default_factory=dict)
    features: dict[str, str] = field(default_factory=dict)
    min_mapq: int = cds.MIN_MAPQ
    include_duplicates: bool = False


def run(spark: SparkSession, alignments: str, features: str, output: str, config: Config) -> None:
    """Classifies all alignments of a table and writes them by reason and contig."""
    rows, annotated = columns(spark.read.parquet(alignments), config.alignments), columns(spark.read.parquet(features), config.features)
    found = cds.classified(rows, annotated, min_mapq=config.min_mapq, include_duplicates=config.include_duplicates)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    found.select(names).hint("rebalance", "reason", "contig").write.mode("overwrite").partitionBy("reason", "contig").parquet(output)
    seen = {r.reason: r.n for r in cds.funnel(written(spark, output)).collect()}  # one row for each reason
    log.info("read %d alignments of %s and features of %s", seen["records_seen"], alignments, features)
    for reason, n in seen.items():
        if n and reason != "records_seen":
            log.info("wrote %d rows to %s/reason=%s", n, output, reason)


def written(spark: SparkSession, output: str) -> DataFrame:
    """The job's table; names of contigs stay texts, whatever they look like."""
    return spark.read.schema(SCHEMA).parquet(output)


if __name__ == "__main__":
    command("frame_normalised_reads", Config, run, {"alignments": "a Parquet table of alignments", "features": "a Parquet table of coding features", "output": "the folder to write"})
