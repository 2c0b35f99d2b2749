"""Lengths, k-mer counts by cycle, and fractions.

``reads`` tables have a column ``seq``; operators that keep a first copy or a first few also need ``ordinal``, the place of a read in its
input, and where an input has several files or parts, ``file`` and ``span`` (``input_order``).
Cycles count from 1; a k-mer stands at the cycle of its first symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import BASES, dedup_key, is_unambiguous, kmer_tokens, trimmed

MIN_READ_COUNT, PARTS, FEW = 40_000, 64, 100_000


def valid_reads(reads: DataFrame) -> DataFrame:
    return reads.where(is_unambiguous(F.col("seq")))


def input_order(rows: DataFrame) -> list[str]:
    """The columns that say where a row stood in its input: the rank of its file, where its part of the file begins, its place in that; tables of one source have ``ordinal`` alone."""
    return [c for c in ("file", "span", "ordinal") if c in rows.columns]


def _nth(rows: DataFrame, column: str, n: int, buckets: int) -> tuple[int, int]:
    """(the value of ``column`` in the ``n``-th row in its order, how many rows of that value the first ``n`` take), by counting rows in narrowing ranges."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = -(-(high - low + 1) // buckets)
        place = F.floor((F.col(column) - low) / width)
        found = rows.where(F.col(column).between(low, high)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(found.collect()):  # at most ``buckets`` rows
            if r.n >= n:
                low, high = low + r.b * width, min(high, low + (r.b + 1) * width - 1)
                break
            n -= r.n
    return low, n


def first_rows(reads: DataFrame, n: int, *, few: int = FEW, buckets: int = 4096) -> DataFrame:
    """The ``n`` first rows in input order, over all files of the input (any of those that tie for the last place).

    Up to ``few`` rows, one task can merge what the others send. Beyond, each column of the order in turn tells by counts in ranges where the n-th row stands:
    whole files before it are taken, then whole parts of its file, then places, so that no task ever sorts or holds the rows themselves.
    """
    order = input_order(reads)
    if n <= few:
        return reads.orderBy(*order).limit(n)
    if reads.count() <= n:
        return reads
    taken, same = F.lit(False), F.lit(True)
    for c in order:
        value, n = _nth(reads.where(same), c, n, buckets)
        taken, same = taken | (same & (F.col(c) < value)), same & (F.col(c) == value)
    rest = reads.where(same)
    return reads.where(taken).unionByName(rest.limit(n))


def capped_scan(reads: DataFrame, max_reads: int) -> DataFrame:
    """The first ``max_reads`` records in input order, valid or not; all of them if 0."""
    return first_rows(reads, max_reads) if max_reads else reads


def read_qc(reads: DataFrame) -> DataFrame:
    """One row: n_total, n_valid, n_invalid."""
    valid = is_unambiguous(F.col("seq")).cast("int")
    return reads.agg(
        F.count(F.lit(1)).alias("n_total"), F.coalesce(F.sum(valid), F.lit(0)).cast("long").alias("n_valid"),
        F.coalesce(F.sum(1 - valid), F.lit(0)).cast("long").alias("n_invalid"),
    )


def length_histogram(reads: DataFrame) -> DataFrame:
    """(length, observed_read_count) of the valid reads."""
    return valid_reads(reads).groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("observed_read_count"))


def select_lengths(histogram: DataFrame, min_count: int = MIN_READ_COUNT) -> DataFrame:
    return histogram.where(F.col("observed_read_count") >= min_count)


def top_lengths(histogram: DataFrame, n: int = 10) -> DataFrame:
    return histogram.orderBy(F.desc("observed_read_count"), "length").limit(n)


def requested_lengths(histogram: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """(rows of the requested lengths that occur, requested lengths that do not)."""
    wanted = histogram.sparkSession.createDataFrame([(x,) for x in sorted(set(lengths))], "length int")
    return histogram.join(wanted, "length", "left_semi"), wanted.join(histogram, "length", "left_anti")


def collapse(reads: DataFrame, mode: str = "sequence") -> DataFrame:
    """One read of each group of copies, the first in input order, with ``copies``; a partial minimum in each task keeps hot sequences small."""
    key = F.struct(F.length("seq"), dedup_key(F.col("seq"), mode))
    order = input_order(reads)
    first = F.min(F.struct(*order, *[c for c in reads.columns if c not in order])).alias("r")
    return reads.groupBy(key.alias("k")).agg(first, F.count(F.lit(1)).alias("copies")).select(*[f"r.{c}" for c in reads.columns], "copies")


def capped_unique(reads: DataFrame, mode: str, per_length: int) -> DataFrame:
    """The first ``per_length`` distinct reads of every length, in input order.

    Lengths are few, so each is ranked in ``PARTS`` parts first, and then what those leave.
    """
    order = input_order(reads)
    rows = collapse(reads, mode).withColumn("part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    for keys in ([F.length("seq"), F.col("part")], [F.length("seq")]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= per_length)
    return rows.drop("rank", "part")


def kmer_counts(reads: DataFrame, k: int = 1) -> DataFrame:
    """(length, cycle, kmer, n): one exploded row for each k-mer, summed in each task before the shuffle."""
    kmer_tokens(k)
    rows = valid_reads(reads).where(F.length("seq") >= k)
    if k == 1:
        cells = rows.select(F.length("seq").alias("length"), F.posexplode(F.split("seq", "")).alias("at", "kmer")).select("length", (F.col("at") + 1).alias("cycle"), "kmer")
    else:
        starts = F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("cycle")
        cells = rows.select("seq", F.length("seq").alias("length"), starts).select("length", "cycle", F.substr("seq", F.col("cycle"), F.lit(k)).alias("kmer"))
    return cells.groupBy("length", "cycle", "kmer").agg(F.count(F.lit(1)).alias("n"))


#: Tokens at cycle 0 of ``joint_cells``: a valid read, and one that is not.
VALID, INVALID = "+", "-"


def joint_cells(reads: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, length, cycle, token, n): how often each symbol, with the up to ``k - 1`` that follow it, begins at a cycle of the valid reads of a length.

    At cycle 0 the tokens count the reads themselves, valid and not. So one scan, and one shuffle of at most length x 4^k cells for each length and task, give all
    that ``qc_in``, ``lengths_in`` and ``kmers_in`` derive from the small result. Tokens at a read's last cycles are shorter.
    Where a row stands for several equal reads (``copies``), ``reads`` counts those and ``n`` the rows.
    """
    kmer_tokens(k)
    fine = is_unambiguous(F.col("seq"))
    cycles = F.when(fine, F.sequence(F.lit(0), F.length("seq"))).otherwise(F.array(F.lit(0)))
    copies = ["copies"] if "copies" in reads.columns else []
    rows = reads.select(*by, *copies, "seq", F.length("seq").alias("length"), fine.alias("fine"), F.explode(cycles).alias("cycle"))
    token = F.when(F.col("cycle") > 0, F.substr("seq", F.col("cycle"), F.lit(k))).otherwise(F.when(F.col("fine"), VALID).otherwise(INVALID))
    return rows.groupBy(*by, "length", "cycle", token.alias("token")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias("reads") for c in copies])


def _reads_of(cells: DataFrame) -> Column:
    return F.col("reads" if "reads" in cells.columns else "n")


def qc_in(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``read_qc`` of the reads that ``joint_cells`` has counted, for each group of ``by``, with n_duplicates (copies beyond the first) and n_analyzed."""
    count = lambda c, x=_reads_of(cells): F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    valid, invalid = F.col("token") == VALID, F.col("token") == INVALID
    sums = [
        count(valid | invalid).alias("n_total"), count(valid).alias("n_valid"), count(invalid).alias("n_invalid"), (count(valid) - count(valid, F.col("n"))).alias("n_duplicates"),
        count(valid, F.col("n")).alias("n_analyzed"),
    ]
    return cells.where("cycle = 0").groupBy(*by).agg(*sums)


def lengths_in(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``length_histogram`` of the reads that ``joint_cells`` has counted; ``analyzed_read_count`` counts equal reads once if it was given them once."""
    whole = cells.where((F.col("cycle") == 0) & (F.col("token") == VALID)).groupBy(*by, "length")
    return whole.agg(F.sum(_reads_of(cells)).alias("observed_read_count"), F.sum("n").alias("analyzed_read_count"))


def kmers_in(cells: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``kmer_counts`` of the reads that ``joint_cells`` has counted, for a ``k`` up to its own."""
    kmers = cells.where((F.col("cycle") > 0) & (F.length("token") >= k))
    return kmers.groupBy(*by, "length", "cycle", F.substring("token", 1, k).alias("kmer")).agg(F.sum("n").alias("n"))


def dense(counts: DataFrame, lengths: DataFrame, k: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, length, cycle, kmer, n) with a row for every cycle and k-mer of the given lengths, 0 where none was seen."""
    tokens = F.explode(F.array(*[F.lit(t) for t in kmer_tokens(k)])).alias("kmer")
    cells = lengths.where(F.col("length") >= k).select(*by, "length", F.explode(F.sequence(F.lit(1), F.col("length") - k + 1)).alias("cycle")).select(*by, "length", "cycle", tokens)
    return cells.join(counts, [*by, "length", "cycle", "kmer"], "left").select(*by, "length", "cycle", "kmer", F.coalesce("n", F.lit(0)).alias("n"))


def fractions(cells: DataFrame, lengths: DataFrame, k: int = 1) -> DataFrame:
    """(length, cycle, one column for each k-mer): counts over the reads of that length."""
    reads = lengths.select("length", F.col("observed_read_count").alias("reads"))
    wide = cells.groupBy("length", "cycle").pivot("kmer", kmer_tokens(k)).agg(F.sum("n"))
    checked = F.when(F.col("reads") > 0, F.col("reads")).otherwise(F.raise_error(F.lit("a length has no reads")).cast("long"))
    return wide.join(reads, "length").select("length", "cycle", *[(F.coalesce(t, F.lit(0)) / checked).alias(t) for t in kmer_tokens(k)])


def length_table(observed: DataFrame, analyzed: DataFrame, min_count: int = MIN_READ_COUNT) -> DataFrame:
    """length, observed_read_count, analyzed_read_count, processed, passed_min_read_count of every length of either side."""
    other = analyzed.select("length", F.col("observed_read_count").alias("analyzed_read_count"))
    both = observed.join(other, "length", "full_outer")
    seen, used = F.coalesce("observed_read_count", F.lit(0)), F.coalesce("analyzed_read_count", F.lit(0))
    return both.select(
        "length", seen.alias("observed_read_count"), used.alias("analyzed_read_count"), (used > 0).alias("processed"), (seen >= min_count).alias("passed_min_read_count")
    )


def trimmed_reads(reads: DataFrame, length: int, five: int, three: int) -> DataFrame:
    """Reads of one raw length, trimmed, with ``valid``: whether what is left is unambiguous."""
    part = trimmed(F.col("seq"), five, three)
    return reads.where(F.length("seq") == length).withColumn("seq", part).withColumn("valid", is_unambiguous(F.col("seq")))


def positional_frequencies(reads: DataFrame, length: int, five: int = 0, three: int = 0, *, collapse_exact: bool = False, max_reads: int = 0) -> DataFrame:
    """(cycle, A, T, G, C): counts by cycle of trimmed reads of one raw length; the cap is on the reads analysed."""
    rows = trimmed_reads(reads, length, five, three).where("valid")
    if collapse_exact:
        rows = collapse(rows)
    if max_reads:
        rows = first_rows(rows, max_reads)
    cells = rows.select(F.posexplode(F.split("seq", "")).alias("at", "base"))
    return cells.groupBy((F.col("at") + 1).alias("cycle")).agg(*[_sum_if(F.col("base") == b).alias(b) for b in BASES])


def _sum_if(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def trim_counters(reads: DataFrame, length: int, five: int = 0, three: int = 0, *, collapse_exact: bool = False) -> DataFrame:
    """One row: records_scanned, raw_length_matched, invalid_or_ambiguous, duplicates_collapsed, reads_analyzed, from one scan."""
    part = trimmed(F.col("seq"), five, three)
    here = F.length("seq") == length
    rows = reads.select(here.alias("here"), F.when(here & is_unambiguous(part), part).alias("part"))
    count = lambda c: F.coalesce(_sum_if(c), F.lit(0))
    used = F.count_distinct("part") if collapse_exact else F.count("part")
    sums = rows.agg(F.count(F.lit(1)).alias("records_scanned"), count(F.col("here")).alias("raw_length_matched"), F.count("part").alias("valid"), used.alias("reads_analyzed"))
    return sums.select(
        "records_scanned", "raw_length_matched", (F.col("raw_length_matched") - F.col("valid")).alias("invalid_or_ambiguous"),
        (F.col("valid") - F.col("reads_analyzed")).alias("duplicates_collapsed"), "reads_analyzed",
    )


def trim_run(reads: DataFrame, length: int, offset: Column) -> DataFrame:
    """(counter, n) of a two-symbol trim: records seen, of the raw length, left out as ambiguous, written, and written by ``offset``."""
    here = F.length("seq") == length
    fine = here & is_unambiguous(F.col("seq"))
    rows = reads.select(here.alias("here"), fine.alias("fine"), F.when(fine, offset).alias("offset"))
    tests = {"length_matched": F.col("here"), "ambiguous_excluded": F.col("here") & ~F.col("fine"), "records_written": F.col("fine")}
    tests |= {f"offset_{k}": F.coalesce(F.col("offset") == k, F.lit(False)) for k in range(3)}
    sums = rows.agg(F.count(F.lit(1)).alias("records_seen"), *[F.coalesce(_sum_if(c), F.lit(0)).alias(name) for name, c in tests.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("counter"), F.col(name).alias("n")) for name in ("records_seen", *tests)])).alias("c")).select("c.counter", "c.n")
