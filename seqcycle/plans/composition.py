"""The whole analysis of one library: lengths, k-mer tables, harmonic tests, and a record of the run."""

from __future__ import annotations

import datetime
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, counts, harmonic
from ..sources import detect, sinks
from ..sources.shared import written


@dataclass(frozen=True)
class Settings:
    """What a run was asked for."""

    input: str
    outdir: str = "composition"
    k: tuple[int, ...] = (1,)
    lengths: tuple[int, ...] = ()
    min_read_count: int = counts.MIN_READ_COUNT
    max_reads: int = 0
    which: str = "r1"
    exclude_duplicates: bool = False
    collapse_exact: bool = False
    test: bool = True
    start: int = harmonic.START
    end: int = harmonic.END
    alpha: float = harmonic.ALPHA
    permutations: int = harmonic.PERMUTATIONS
    seed: int = harmonic.SEED
    skip_existing: bool = False

    def __post_init__(self):
        if not set(self.k) <= {1, 2, 3} or self.min_read_count < 1 or self.max_reads < 0 or not 0 < self.alpha < 1 or self.permutations < 1 or self.end < self.start:
            raise ValueError("a setting is out of its domain")


@dataclass
class Plan:
    """The tables of a run, not yet computed but for the cells that all derive from, and the lengths that it takes."""

    settings: Settings
    sample: str
    cells: DataFrame
    observed: DataFrame
    lengths: DataFrame
    analyzed: DataFrame
    tables: dict[int, DataFrame] = field(default_factory=dict)
    fits: DataFrame | None = None

    def explained(self) -> str:
        """The plan's text, for a dry run."""
        jvm = self.cells.sparkSession._jvm
        mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return "\n".join(f"k={k}\n{t._jdf.queryExecution().explainString(mode)}" for k, t in self.tables.items())

    def counters(self) -> DataFrame:
        """One row: n_total, n_valid, n_invalid, n_duplicates and n_analyzed of the reads scanned, n_lengths taken and n_taken reads of those lengths.

        They are rows of the counting pass itself rather than metrics observed beside it: those of a stage that ran twice, as after the loss of an executor, would count twice.
        """
        taken = self.analyzed.agg(F.count(F.lit(1)).alias("n_lengths"), F.coalesce(F.sum("observed_read_count"), F.lit(0)).alias("n_taken"))
        both = counts.qc_in(self.cells).withColumn("one", F.lit(1)).join(taken.withColumn("one", F.lit(1)), "one")
        return both.drop("one")


def counted(reads: DataFrame, k: int, *, collapse_exact: bool = False) -> DataFrame:
    """``joint_cells`` of reads, written down: the one scan of the input that lengths, all k-mer tables and all counters come from."""
    rows = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("copies")) if collapse_exact else reads
    return written(counts.joint_cells(rows, k), "cells")


def planned(spark: SparkSession, settings: Settings, reads: DataFrame | None = None) -> Plan:
    """Scans the reads once and plans everything else from their cells."""
    reads = detect.reads(spark, settings.input, which=settings.which, duplicates=not settings.exclude_duplicates) if reads is None else reads
    cells = counted(counts.capped_scan(reads, settings.max_reads), max(settings.k), collapse_exact=settings.collapse_exact)
    both = counts.lengths_in(cells)
    observed = both.drop("analyzed_read_count")
    if settings.lengths:
        lengths, missing = counts.requested_lengths(observed, list(settings.lengths))
        absent = [r.length for r in missing.collect()]  # at most as many as were asked for
        if absent:
            raise ValueError(f"no valid reads of lengths {sorted(absent)}")
    else:
        lengths = counts.select_lengths(observed, settings.min_read_count)
        if lengths.limit(1).count() == 0:
            top = ", ".join(f"{r.length}: {r.observed_read_count}" for r in counts.top_lengths(observed).collect())
            raise ValueError(f"no length has {settings.min_read_count} valid reads; the most frequent: {top or 'none'}")
    analyzed = both.select("length", F.col("analyzed_read_count").alias("observed_read_count")).join(lengths.select("length"), "length", "left_semi")
    plan = Plan(settings, detect.sample_name(settings.input), cells, observed, lengths, analyzed)
    for k in settings.k:
        table = counts.dense(counts.kmers_in(cells, k).join(lengths.select("length"), "length", "left_semi"), lengths, k)
        plan.tables[k] = counts.fractions(table, analyzed, k)
        if k == 1 and settings.test:
            rows = harmonic.window(table, settings.start, settings.end).withColumnRenamed("kmer", "base")
            fits = harmonic.fit(rows.join(analyzed, "length"), ["length", "base"], scale=F.max("observed_read_count"))
            p = harmonic.permutation_p(rows, ["length", "base"], settings.permutations, settings.seed)
            tested = fits.join(p, ["length", "base"], "left").withColumn("p_value", F.when(F.col("status") == "ok", F.col("p_value")))
            plan.fits = harmonic.holm(tested, ["length"], alpha=settings.alpha)
    return plan


def run(spark: SparkSession, settings: Settings, reads: DataFrame | None = None) -> Plan:
    """Computes and writes everything below ``outdir/sample``; with ``skip_existing``, only the lengths that a table does not have yet."""
    plan = planned(spark, settings, reads)
    base = os.path.join(settings.outdir, plan.sample)

    def by_length(df: DataFrame, name: str, kind: str) -> None:
        sinks.by_length(df, plan.lengths.select("length"), f"{base}/{name}", f"{base}/written", kind=kind, skip_existing=settings.skip_existing)

    for k, table in plan.tables.items():
        by_length(table, f"csv/kmer/k{k}", "csv")
        by_length(charts.kmer_profile(table, k), f"charts/k{k}_profile", "csv")
    if plan.fits is not None:
        facts = {"sample": plan.sample, "alpha": settings.alpha, "permutations": settings.permutations}
        by_length(sinks.fit_json(plan.fits, ["length"], facts=facts).select("length", "value"), "stats/period3", "text")
    lengths = counts.length_table(plan.observed, plan.analyzed, settings.min_read_count)
    for name, kind in (("read_lengths", "csv"), ("read_lengths_json", "json")):
        sinks.table(lengths, f"{base}/stats/{name}", kind=kind, replace=settings.skip_existing)
    facts = {"sample": plan.sample, "finished": datetime.datetime.now(datetime.UTC).isoformat(), "settings": asdict(settings), "reads": plan.counters().first().asDict()}
    sinks.manifest(spark, facts | {"inputs": sinks.digest_all(spark, settings.input.split(","))}, f"{base}/manifest")
    return plan
