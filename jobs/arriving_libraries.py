"""Job 2: composition of libraries whose reads keep arriving. Each run takes only files that it has not seen, and brings all tables up to date.

    python -m jobs.arriving_libraries INPUT OUTPUT CHECKPOINT [--config FILE]

The input is a folder of Parquet files to which files are added; the configuration makes library and seq of its columns by SQL expressions, and cuts long sequences into reads
of ``tile`` symbols. A file stream with a checkpoint hands over what is new in micro-batches. Below OUTPUT stand

* ``deltas/batch=N/length=L``: the k-mer cells of a micro-batch, sums that merge. A batch that is run again, as after a failure, replaces its own partitions.
* ``cells/length=L``: the cells of all batches, and ``fits/length=L``: the period-3 fit of every library and base. Only lengths to which a batch has added are replaced; what each
  of them holds (``through``, the last batch in it) is the mark that tells, so a run that was cut off between the steps is finished by the next.
* ``libraries/category=C``: each library's best length and the range of its lengths.

OUTPUT and CHECKPOINT belong together: delete both or none. Reads are counted once and never stored; a library that holds most of them is summed in each task before a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcycle.functions.sequences import kmer_tokens
from seqcycle.operators import counts, harmonic, rollup
from seqcycle.sources.shared import existing

from .common import columns, command, log

BY = ("library",)
CELLS = "library string, cycle int, token string, n long, through long, length int"
DELTAS = "library string, cycle int, token string, n long, batch long, length int"
FITS = "library string, base string, reads long, n_cycles long, intercept double, amplitude double, phase_degrees double, r2 double, status string, length int"
LIBRARIES = (
    "sample string, best_length int, best_length_read_count long, max_r2 double, best_length_min_base_r2 double, best_length_max_base_r2 double, n_eligible_lengths long, "
    "min_eligible_length int, max_eligible_length int, median_mean_r2 double, mean_mean_r2_across_lengths double, n_total long, n_invalid long, category string"
)


@dataclass(frozen=True)
class Config:
    """columns: library and seq; k: the longest k-mer (1 to 3); files_per_batch: input files in a micro-batch; min_read_count: of a length to be fitted."""

    columns: dict[str, str] = field(default_factory=dict)
    tile: int = 60
    k: int = 3
    files_per_batch: int = 100
    min_read_count: int = counts.MIN_READ_COUNT
    start: int = harmonic.START
    end: int = harmonic.END

    def __post_init__(self):
        kmer_tokens(self.k)
        if self.tile < 1 or self.files_per_batch < 1 or self.min_read_count < 1 or self.end < self.start:
            raise ValueError("a setting is out of its domain")


def reads(rows: DataFrame, config: Config) -> DataFrame:
    """(library, seq): the sequences of the given rows, cut into reads of ``tile`` symbols (the last one shorter); empty and null sequences have none."""
    given = columns(rows, config.columns)
    # One pattern cuts a sequence in one pass, where a substring would count its way from the start for each read; and as nothing is filtered by seq, its expression is evaluated once.
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{config.tile}}}"), F.lit(0))
    return given.select(F.coalesce("library", F.lit("")).alias("library"), F.explode(cut).alias("seq"))


def _by_partition(df: DataFrame, path: str, *names: str) -> None:
    """Replaces those partitions of a table that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)


def take_new(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config) -> None:
    """Adds the cells of files that have not been taken yet, one batch of partitions for each micro-batch."""

    def add(batch: DataFrame, number: int) -> None:
        cells = counts.joint_cells(reads(batch, config), config.k, BY).withColumn("batch", F.lit(number).cast("long"))
        _by_partition(cells.repartition("length"), f"{output}/deltas", "batch", "length")

    schema = spark.read.parquet(source).schema
    folder, _, name = source.rstrip("/").rpartition("/")
    pattern = f"{folder}/{{{name}}}"  # a stream takes a folder or a pattern; as a pattern of one name, a single file will do as well
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(pattern)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        if p.numInputRows:
            log.info("batch %d: read %d rows of %s", p.batchId, p.numInputRows, source)


def bring_up_to_date(spark: SparkSession, output: str, config: Config) -> None:
    """Sums the cells of lengths to which batches have added since, and fits them anew; the cells, which carry the mark, are written last."""
    deltas, held = existing(spark, f"{output}/deltas", DELTAS), existing(spark, f"{output}/cells", CELLS)
    marks = held.groupBy("length").agg(F.max("through").alias("through"))
    behind = deltas.groupBy("length").agg(F.max("batch").alias("last")).join(marks, "length", "left").where("through is null or last > through").select("length", "last").collect()  # lengths of reads
    if behind:
        last = spark.createDataFrame(behind, "length int, through long")
        whole = deltas.join(last, "length").groupBy("library", "cycle", "token", "through", "length").agg(F.sum("n").alias("n"))
        _by_partition(fits(whole, config).hint("rebalance", "length"), f"{output}/fits", "length")
        _by_partition(whole.hint("rebalance", "length"), f"{output}/cells", "length")
    log.info("wrote %d lengths with new reads to %s/cells and %s/fits", len(behind), output, output)
    summary = libraries(existing(spark, f"{output}/cells", CELLS), existing(spark, f"{output}/fits", FITS))
    summary.hint("rebalance", "category").write.mode("overwrite").partitionBy("category").parquet(f"{output}/libraries")


def fits(cells: DataFrame, config: Config) -> DataFrame:
    """The period-3 fit of each library, length and base, for lengths of enough reads."""
    lengths = counts.select_lengths(counts.lengths_in(cells, BY), config.min_read_count).drop("analyzed_read_count")
    dense = harmonic.window(counts.dense(counts.kmers_in(cells, 1, BY), lengths, 1, BY), config.start, config.end).withColumnRenamed("kmer", "base")
    fit = harmonic.fit(dense.join(lengths, [*BY, "length"]), [*BY, "length", "base"], scale=F.max("observed_read_count"))
    return fit.join(lengths.withColumnRenamed("observed_read_count", "reads"), [*BY, "length"]).select([c.split()[0] for c in FITS.split(", ")])


def libraries(cells: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row for each library: counts of its reads, and the best of its lengths among those whose four bases are fitted (null if there is none)."""
    fine = fitted.where("status = 'ok'").groupBy(F.col("library").alias("sample"), F.col("length").alias("read_length"))
    r2 = fine.agg(F.max("reads").alias("read_count"), F.avg("r2").alias("mean_r2"), F.min("r2").alias("min_base_r2"), F.max("r2").alias("max_base_r2"), F.count("r2").alias("bases")).where("bases = 4")
    best = rollup.library_summary(r2.withColumns({"observed_read_count": F.col("read_count"), "category": rollup.category(F.col("sample"))})).drop("category")
    named = counts.qc_in(cells, BY).withColumnRenamed("library", "sample").withColumn("category", rollup.category(F.col("sample")))
    return named.join(best, "sample", "left").select([c.split()[0] for c in LIBRARIES.split(", ")])


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config) -> None:
    """Takes the files that have arrived and brings cells, fits and libraries up to date."""
    take_new(spark, source, output, checkpoint, config)
    bring_up_to_date(spark, output, config)


def written(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The job's tables."""
    return {name: existing(spark, f"{output}/{name}", schema) for name, schema in (("cells", CELLS), ("fits", FITS), ("libraries", LIBRARIES))}


if __name__ == "__main__":
    command("arriving_libraries", Config, run, {"source": "a folder to which Parquet files are added", "output": "the folder to write", "checkpoint": "a folder for the stream's checkpoint"})
