"""Alignments against coding features: containment, exclusion reasons, codon phase.

An alignment [ref_start, ref_end) matches features of its contig. Bins form levels, each ``STEP`` times as wide as the one before. A feature
stands on the lowest level whose bins are as wide as itself, so that it touches two of them at most, however long it is; an alignment looks into the bins
that it touches on those levels that any feature stands on. They meet by an equality join on contig, level and bin; a pair that shares two bins belongs to the first.
So one giant contig spreads over its bins, and nothing is broadcast unless the engine sees that it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import codon_corrected, is_simple_cigar, is_unambiguous, reverse_complement

MIN_MAPQ, BIN, STEP, LEVELS = 25, 4096, 8, 8
UNMAPPED, REVERSE, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x200, 0x400, 0x800
#: In the order in which an alignment is tried.
REASONS = (
    "unmapped", "non_primary_or_qcfail", "duplicate_flag_excluded", "low_mapq", "complex_cigar_excluded", "contig_without_cds", "no_cds_overlap",
    "not_fully_contained_or_antisense", "ambiguous_multiple_cds", "missing_sequence", "ambiguous_sequence", "too_short_after_trim", "written",
)


def has(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(mask) != 0


def codon_phase(ref_start: Column, ref_end: Column, start: Column, end: Column, strand: Column, phase: Column) -> Column:
    """The codon phase of an alignment's first sequenced base in a feature that contains it."""
    plus = F.pmod(ref_start - (start + phase), F.lit(3))
    minus = F.pmod((end - 1 - phase) - (ref_end - 1), F.lit(3))
    return F.when(strand == "+", plus).otherwise(minus).cast("int")


def _width(level: Column, bin_size: int) -> Column:
    return F.lit(bin_size).cast("long") * F.element_at(F.array(*[F.lit(STEP**i) for i in range(LEVELS)]), level + 1)


def binned(rows: DataFrame, start: str, end: str, level: Column, bin_size: int = BIN) -> DataFrame:
    """A row for each bin of its level that [start, end) touches, with ``level``, ``bin`` and the bins' ``width``."""
    wide = rows.withColumn("level", level).withColumn("width", _width(F.col("level"), bin_size))
    return wide.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("width")), F.floor((F.col(end) - 1) / F.col("width")))))


def feature_level(length: Column, bin_size: int = BIN) -> Column:
    """The lowest level whose bins are as wide as ``length``, at most the last."""
    return sum(((length > bin_size * STEP**i).cast("int") for i in range(LEVELS - 1)), F.lit(0))


def overlaps(alignments: DataFrame, features: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Each alignment with each feature of its contig that it overlaps (half-open); feature columns start with ``cds_``."""
    named = features.distinct().select("contig", *[F.col(c).alias(f"cds_{c}") for c in features.columns if c != "contig"])
    f = binned(named.where("cds_end > cds_start"), "cds_start", "cds_end", feature_level(F.col("cds_end") - F.col("cds_start"), bin_size), bin_size)
    levels = sorted(r[0] for r in features.where("end > start").select(feature_level(F.col("end") - F.col("start"), bin_size)).distinct().collect())  # at most LEVELS
    level = F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>"))
    a = binned(alignments.where("ref_end > ref_start"), "ref_start", "ref_end", level, bin_size).drop("width")
    meets = (F.col("ref_start") < F.col("cds_end")) & (F.col("ref_end") > F.col("cds_start"))
    once = F.col("bin") == F.floor(F.greatest("ref_start", "cds_start") / F.col("width"))
    return a.join(f, ["contig", "level", "bin"]).where(meets & once).drop("level", "bin", "width")


def classified(alignments: DataFrame, features: DataFrame, *, min_mapq: int = MIN_MAPQ, include_duplicates: bool = False) -> DataFrame:
    """Each alignment (a record, whatever its name) with ``reason``, and for those written cds_identifier, cds_strand, phase, trim5, trim3, corrected."""
    flag = F.col("flag")
    early = (
        F.when(has(flag, UNMAPPED), "unmapped").when(has(flag, SECONDARY | QC_FAIL | SUPPLEMENTARY), "non_primary_or_qcfail")
        .when(has(flag, DUPLICATE) & F.lit(not include_duplicates), "duplicate_flag_excluded").when(F.col("mapq") < min_mapq, "low_mapq")
        .when(~is_simple_cigar(F.col("cigar")), "complex_cigar_excluded")
    )
    rows = alignments.withColumn("early", early).withColumn("reversed", has(flag, REVERSE))
    # What an alignment meets follows from its place and orientation alone: mates, or records of equal names, each have their own.
    place = ["contig", "ref_start", "ref_end", "reversed"]
    tried = rows.where("early is null")
    pairs = overlaps(tried.select(place).distinct(), features)
    inside = (F.col("ref_start") >= F.col("cds_start")) & (F.col("ref_end") <= F.col("cds_end")) & (F.col("reversed") == (F.col("cds_strand") == "-"))
    feature = F.struct("cds_start", "cds_end", "cds_strand", "cds_phase", "cds_identifier")
    # Pairs are distinct features, so a count and one of them say all; nothing is gathered.
    per = pairs.groupBy(place).agg(F.sum(inside.cast("int")).alias("inside"), F.min(F.when(inside, feature)).alias("cds"))
    contigs = features.select("contig").distinct().withColumn("annotated", F.lit(True))
    joined = tried.join(per, place, "left").join(contigs, "contig", "left")
    seq = F.when(F.col("inside") == 1, F.upper(F.when(has(flag, REVERSE), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))))
    phase = codon_phase(F.col("ref_start"), F.col("ref_end"), F.col("cds.cds_start"), F.col("cds.cds_end"), F.col("cds.cds_strand"), F.col("cds.cds_phase"))
    placed = joined.withColumn("read", seq).withColumn("phase", phase)
    corrected, five, three = codon_corrected(F.col("read"), F.col("phase"))
    late = (
        F.when(F.col("annotated").isNull(), "contig_without_cds").when(F.col("inside").isNull(), "no_cds_overlap").when(F.col("inside") == 0, "not_fully_contained_or_antisense")
        .when(F.col("inside") > 1, "ambiguous_multiple_cds").when(F.col("read").isNull(), "missing_sequence").when(~is_unambiguous(F.col("read")), "ambiguous_sequence")
        .when(F.length(corrected) < 3, "too_short_after_trim").otherwise("written")
    )
    out = placed.withColumn("reason", late)
    only = lambda c: F.when(F.col("reason") == "written", c)
    met = out.select(
        *alignments.columns, "reason", only(F.col("cds.cds_identifier")).alias("cds_identifier"), only(F.col("cds.cds_strand")).alias("cds_strand"), only(F.col("phase")).alias("phase"),
        only(five).cast("int").alias("trim5"), only(three).cast("int").alias("trim3"), only(corrected).alias("corrected"),
    )
    # The others need neither a feature nor their sequence: they are not sent to meet any, and those of no place make no crowd.
    return met.unionByName(rows.where("early is not null").select(*alignments.columns, F.col("early").alias("reason")), allowMissingColumns=True)


def funnel(rows: DataFrame) -> DataFrame:
    """(reason, n): every reason, 0 if no alignment has it, and ``records_seen``, from one scan."""
    counts = [F.coalesce(F.sum((F.col("reason") == r).cast("long")), F.lit(0)).alias(r) for r in REASONS]
    sums = rows.agg(F.count(F.lit(1)).alias("records_seen"), *counts)
    return sums.select(F.inline(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in ("records_seen", *REASONS)])))


def fasta_header(rows: DataFrame) -> Column:
    return F.format_string("%s|phase=%d|trim5=%d|trim3=%d|cds=%s|cds_strand=%s", "read_id", "phase", "trim5", "trim3", "cds_identifier", "cds_strand")
