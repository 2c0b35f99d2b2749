"""Results of many libraries: reading, best length, metadata, categories, simulation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import BASES
from ..functions.special import t_quantile
from .validate import require, require_columns, require_unique

EXTERNAL, INTERNAL, UNKNOWN, OTHER = "external_ancient", "internal_ancient", "Unknown", "Other"
#: Labels that say nothing.
MISSING_LABELS = ("unknown", "unspecified", "not specified", "not available", "na", "n/a", "null", "")
MIN_LIBRARIES, T_TABLE = 5, 200

FIT_JSON = "status string, read_length int, read_count long, observed_read_count long, fits array<struct<base:string,r2:double>>"


def category(sample: Column) -> Column:
    """Whether a sample is named by an archive's accession."""
    return F.when(sample.rlike("(?i)^(SRR|ERR|DRR|PRJ)"), EXTERNAL).otherwise(INTERNAL)


def parsed_results(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each usable result, rejects with ``error``) of (path, content) rows; results marked as skipped are neither.

    The sample is the folder above ``stats``, and a missing read length is that of the folder ``L<number>``.
    """
    # As a generator the parse runs once; as a column, once for every field that is read from it.
    rows = files.select("path", F.inline_outer(F.array(F.from_json("content", FIT_JSON))))
    sample = F.regexp_extract("path", r"([^/]+)/stats/[^/]*/[^/]*/L[^/]*/[^/]*$", 1)
    folder = F.regexp_extract("path", r"/L(\d+)/[^/]+$", 1)
    length = F.coalesce("read_length", F.when(folder != "", folder.cast("int")))
    by_base = [F.try_element_at(F.filter("fits", _is_base(b)), F.lit(-1))["r2"].alias(f"r2_{b}") for b in BASES]
    flat = rows.where(~F.coalesce(F.col("status") == "skipped", F.lit(False))).select(
        "path", sample.alias("sample"), length.alias("read_length"), "read_count", "observed_read_count",
        F.size("fits").alias("n_fits"), *by_base,
    )
    r2 = [F.col(f"r2_{b}") for b in BASES]
    fine = [x.between(0.0, 1.0 + 1e-12) & ~F.isnan(x) for x in r2]
    error = (
        F.when(F.coalesce(F.col("n_fits"), F.lit(-1)) <= 0, "no fits").when(F.col("read_length").isNull(), "no read length").when(F.greatest(*[x.isNull() for x in r2]), "a base is missing")
        .when(~F.least(*fine), "an r2 is out of range").when(F.col("sample") == "", "no sample in the path")
    )
    judged = flat.withColumn("error", error)
    good = judged.where("error is null").select(
        "sample", category(F.col("sample")).alias("category"), "read_length", "read_count", "observed_read_count", (sum(r2) / 4).alias("mean_r2"), F.least(*r2).alias("min_base_r2"),
        F.greatest(*r2).alias("max_base_r2"), F.lit(True).alias("all_four_bases_present"), F.col("path").alias("source_json"),
    )
    return good, judged.where("error is not null").select("path", "error")


def _is_base(base: str):
    return lambda f: (F.upper(f["base"]) == base) & f["r2"].isNotNull()


def best_lengths(rows: DataFrame) -> DataFrame:
    """The whole row of each sample's best length: largest mean_r2, then most reads (unknown last), then shortest."""
    order = Window.partitionBy("sample").orderBy(F.desc("mean_r2"), F.desc(F.coalesce("read_count", F.lit(-1))), "read_length")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def library_summary(rows: DataFrame) -> DataFrame:
    """One row for each sample: its best length, and the number, range, median and mean over its lengths."""
    rows = rows.where("sample is not null")
    per = rows.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_eligible_lengths"), F.min("read_length").alias("min_eligible_length"), F.max("read_length").alias("max_eligible_length"),
        F.median("mean_r2").alias("median_mean_r2"), F.avg("mean_r2").alias("mean_mean_r2_across_lengths"),
    )
    best = best_lengths(rows)
    extra = [F.col("source_json").alias("best_length_source_json")] if "source_json" in rows.columns else []
    return best.join(per, "sample", "left").select(
        "sample", "category", F.col("read_length").alias("best_length"), F.col("read_count").alias("best_length_read_count"), F.col("observed_read_count").alias("best_length_observed_read_count"),
        F.col("mean_r2").alias("max_r2"), F.col("min_base_r2").alias("best_length_min_base_r2"), F.col("max_base_r2").alias("best_length_max_base_r2"), "n_eligible_lengths",
        "min_eligible_length", "max_eligible_length", "median_mean_r2", "mean_mean_r2_across_lengths", *extra,
    )


def joined_metadata(libraries: DataFrame, metadata: DataFrame, *, internal_project: str | None = None, check: bool = True) -> DataFrame:
    """All libraries with their metadata: external ones by accession, internal ones by name; ``_metadata_merge`` is both or left_only.

    Metadata columns whose names clash get the suffix ``_metadata``. Keys are unique among those that are not null.
    """
    require_columns(libraries, {"sample", "category", "max_r2"}, "the table of libraries")
    require_columns(metadata, {"archive_data_accession"}, "the metadata")
    if check:
        require_unique(libraries, ["sample"], "the table of libraries", skip_null=True)
        for key in {"archive_data_accession", "library_name"} & set(metadata.columns):
            require_unique(metadata, [key], "the metadata", skip_null=True)
    clashing = {c: f"{c}_metadata" for c in metadata.columns if c in libraries.columns}
    known = metadata.withColumnsRenamed(clashing)

    def merged(kind: str, key: str) -> DataFrame:
        key = clashing.get(key, key)
        side = libraries.where(F.col("category") == kind)
        if key not in known.columns:
            return side.withColumn("_metadata_merge", F.lit("left_only"))
        marked = known.where(F.col(key).isNotNull()).withColumn("_found", F.lit(True))
        both = side.join(marked, side["sample"] == marked[key], "left")
        return both.withColumn("_metadata_merge", F.when(F.col("_found"), "both").otherwise("left_only")).drop("_found")

    internal = merged(INTERNAL, "library_name")
    if internal_project is not None:
        project = F.coalesce("project_name", F.lit(internal_project)) if "project_name" in internal.columns else F.lit(internal_project)
        internal = internal.withColumn("project_name", project)
    return merged(EXTERNAL, "archive_data_accession").unionByName(internal, allowMissingColumns=True)


def unmatched(joined: DataFrame) -> DataFrame:
    return joined.where("_metadata_merge <> 'both'").select("sample", "category", "_metadata_merge")


def normalized_label(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(value.isNull() | F.lower(text).isin(*MISSING_LABELS), UNKNOWN).otherwise(text)


def cleaned_categories(rows: DataFrame, column: str, min_count: int = MIN_LIBRARIES) -> DataFrame:
    """``rows`` with the column's labels normalised and those of fewer than ``min_count`` rows named Other."""
    labelled = rows.withColumn(column, normalized_label(F.col(column)))
    counts = labelled.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return labelled.join(counts, column).withColumn(column, F.when(F.col("_n") >= min_count, F.col(column)).otherwise(OTHER)).drop("_n")


def category_order(rows: DataFrame, column: str, value: str = "max_r2") -> DataFrame:
    """(column, n, median, place): categories by median, then name."""
    groups = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy("median", column)))  # as many rows as categories


def checked_simulations(rows: DataFrame) -> DataFrame:
    """``rows`` after checks of columns, domains, uniqueness, and that every replicate has the four bases."""
    keys = ["genome", "bias_5prime", "bias_3prime", "replicate"]
    require_columns(rows, {*keys, "base", "r2"}, "the simulation results")
    require(rows, F.col("base").isin(*BASES), "bases are A, T, G or C")
    require(rows, F.col("r2").between(0.0, 1.0) & F.col("bias_5prime").between(0.5, 1.0) & F.col("bias_3prime").between(0.5, 1.0), "r2 or a bias is out of range")
    require_unique(rows, [*keys, "base"], "the simulation results")
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    require(whole, F.col("n") == len(BASES), "a replicate does not have all four bases")
    return rows


def replicate_means(rows: DataFrame) -> DataFrame:
    keys = ["genome", "bias_5prime", "bias_3prime", "replicate"]
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.avg("r2").alias("mean_r2_across_bases"), F.stddev_samp("r2").alias("sd_r2_across_bases"))


def t_half_width(sem: Column, df: Column) -> Column:
    """The half width of a 95 % interval: quantiles up to T_TABLE from a table, beyond by the first terms of their expansion."""
    table = F.array(*[F.lit(t_quantile(k)) for k in range(1, T_TABLE + 1)])
    z = 1.959963984540054
    far = z + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (df * df)
    return sem * F.when(df <= T_TABLE, F.get(table, df.cast("int") - 1)).otherwise(far)


def condition_summary(replicates: DataFrame) -> DataFrame:
    """n_replicates, mean, deviation, standard error and 95 % interval within [0, 1] of each condition; width 0 for one replicate."""
    keys = ["genome", "bias_5prime", "bias_3prime"]
    x = "mean_r2_across_bases"
    g = replicates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_replicates"), F.avg(x).alias("mean_r2"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd_between_replicates"))
    g = g.withColumn("sem_between_replicates", F.col("sd_between_replicates") / F.sqrt("n_replicates"))
    half = F.when(F.col("n_replicates") > 1, t_half_width(F.col("sem_between_replicates"), F.col("n_replicates") - 1)).otherwise(0.0)
    return g.select("*", F.greatest(F.col("mean_r2") - half, F.lit(0.0)).alias("ci95_lower"), F.least(F.col("mean_r2") + half, F.lit(1.0)).alias("ci95_upper"))
