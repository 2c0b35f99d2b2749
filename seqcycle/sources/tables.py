"""Sources of tables: features, composition tables, result files, metadata, simulation results, contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import BASES
from ..operators.rollup import checked_simulations
from ..operators.validate import require, require_columns, require_unique
from .sequences import fasta

#: What the usual readers of such tables take for missing.
NA_STRINGS = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>", "-NaN", "-nan", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN", "#N/A N/A", "#NA")


def gff3(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(contig, start, end, strand, phase, identifier) of the CDS lines: 0-based, half-open; the identifier is ID, else Parent, else made from the place."""
    lines = spark.read.text([paths] if isinstance(paths, str) else paths).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = lines.select(f.alias("f")).where((F.size("f") == 9) & (F.get("f", F.lit(2)) == "CDS"))
    wrong = lambda text: F.raise_error(F.lit(text))
    strand = F.when(F.col("f")[6].isin("+", "-"), F.col("f")[6]).otherwise(wrong("a CDS has no strand").cast("string"))
    phase = F.when(F.col("f")[7] == ".", 0).when(F.col("f")[7].isin("0", "1", "2"), F.col("f")[7].cast("int")).otherwise(wrong("a CDS has no phase").cast("int"))
    start, end = F.col("f")[3].cast("long") - 1, F.col("f")[4].cast("long")

    def attribute(name: str) -> Column:
        """The last of the parts that begin with the name and ``=``, from the first ``=`` on."""
        parts = F.filter(F.transform(F.split(F.col("f")[8], ";", -1), lambda p: F.trim(p)), lambda p: p.startswith(f"{name}="))
        return F.substr(F.try_element_at(parts, F.lit(-1)), F.lit(len(name) + 2))

    made = F.concat_ws(":", F.col("f")[0], F.concat(start, F.lit("-"), end), F.col("f")[6])
    name = F.coalesce(F.nullif(attribute("ID"), F.lit("")), F.nullif(attribute("Parent"), F.lit("")), made)
    return rows.select(F.col("f")[0].alias("contig"), start.alias("start"), end.alias("end"), strand.alias("strand"), phase.alias("phase"), name.alias("identifier"))


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """(name, ordinal, seq) of a reference; empty or repeated names and empty sequences are errors."""
    rows = fasta(spark, path, keep_empty=True).select(F.col("read_id").alias("name"), "ordinal", "seq")
    require(rows, F.col("name") != "", "a contig has no name")
    require(rows, F.col("seq") != "", "a contig is empty")
    return require_unique(rows, ["name"], "the reference")


def one_mer_csv(spark: SparkSession, path: str) -> DataFrame:
    """(cycle, A, T, G, C) of a composition table, checked: columns, finite shares in [0, 1], no cycle twice."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, {"cycle", *BASES}, path)
    rows = raw.select(F.col("cycle").try_cast("int").alias("cycle"), *[F.col(b).try_cast("double").alias(b) for b in BASES])
    fine = F.col("cycle").isNotNull()
    for b in BASES:
        fine = fine & F.col(b).between(0.0, 1.0) & ~F.isnan(b)
    return require_unique(require(rows, fine, f"{path} has values that are no shares"), ["cycle"], path).orderBy("cycle")


def cells_of(table: DataFrame) -> DataFrame:
    """(cycle, base, x): a composition table in long form."""
    return table.select("cycle", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("x")) for b in BASES])).alias("c")).select("cycle", "c.base", "c.x")


def with_nulls(rows: DataFrame) -> DataFrame:
    """Text columns with the usual strings for missing values made null."""
    return rows.select(*[F.when(~F.col(f"`{c}`").isin(*NA_STRINGS), F.col(f"`{c}`")).alias(c) for c in rows.columns])


def metadata_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with all columns as text."""
    return with_nulls(spark.read.csv(path, sep="\t", header=True))


def library_csv(spark: SparkSession, path: str) -> DataFrame:
    return with_nulls(spark.read.csv(path, header=True)).withColumn("max_r2", F.col("max_r2").cast("double"))


def simulation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Simulation results, checked as ``checked_simulations`` does."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, {"genome", "bias_5prime", "bias_3prime", "replicate", "base", "r2"}, path)
    numbers = {c: F.col(c).try_cast("double") for c in ("bias_5prime", "bias_3prime", "r2")}
    return checked_simulations(raw.withColumns(numbers))


def result_files(spark: SparkSession, folder: str, pattern: str = "k1_*.json") -> DataFrame:
    """(path, content) of the result files below a folder."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.col("value").alias("content")).where(path.rlike(r"/stats/[^/]*/kmer/L[^/]*/[^/]*$"))


def result_lines(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """(content, and the columns ``by`` of the folders' names) of the results that ``sinks.tree`` has written, one for each line."""
    return spark.read.schema(f"content string, {by}").text(folder)
