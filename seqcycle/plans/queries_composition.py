"""Queries over reads: lengths, k-mer counts, harmonics, spectra, trims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import BASES, hashed_offset, is_unambiguous, kmer_tokens, phase_trimmed, reverse_complement
from ..operators import charts, counts, harmonic, spectrum
from . import composition, demo

#: Lengths with fewer valid reads are left out; the fixtures are small.
MIN_READS = 5


def _selected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(valid reads, lengths that pass the threshold)."""
    reads = counts.valid_reads(demo.reads(spark, sf_dir))
    return reads, counts.select_lengths(counts.length_histogram(reads), MIN_READS)


def _cells(spark: SparkSession, sf_dir: str, k: int = 1) -> tuple[DataFrame, DataFrame]:
    reads, lengths = _selected(spark, sf_dir)
    return counts.dense(counts.kmer_counts(reads, k), lengths, k), lengths


def read_qc(spark, sf_dir):
    return counts.read_qc(demo.reads(spark, sf_dir))


def length_histogram(spark, sf_dir):
    return counts.length_histogram(demo.reads(spark, sf_dir)).select(F.col("length").cast("long").alias("length"), "observed_read_count")


def select_lengths(spark, sf_dir):
    return counts.select_lengths(length_histogram(spark, sf_dir), MIN_READS)


def top_lengths(spark, sf_dir):
    return counts.top_lengths(length_histogram(spark, sf_dir), 3)


def requested_lengths(spark, sf_dir):
    found, missing = counts.requested_lengths(counts.length_histogram(demo.reads(spark, sf_dir)), [59, 60, 75])
    return found.select("length", F.lit(True).alias("found")).unionByName(missing.select("length", F.lit(False).alias("found"))).select(F.col("length").cast("long").alias("length"), "found")


def length_table(spark, sf_dir):
    observed = counts.length_histogram(demo.reads(spark, sf_dir))
    analyzed = counts.length_histogram(counts.collapse(demo.reads(spark, sf_dir))).where("length <> 58")
    return counts.length_table(observed, analyzed, MIN_READS).withColumn("length", F.col("length").cast("long"))


def _kmers(k: int):
    def query(spark, sf_dir):
        return counts.kmer_counts(demo.reads(spark, sf_dir), k).select(F.col("length").cast("long").alias("length"), F.col("cycle").cast("long").alias("cycle"), "kmer", "n")

    return query


def one_scan_kmers(spark, sf_dir):
    """The k-mer tables for k = 1, 2, 3, all from the cells of one scan."""
    cells = composition.counted(demo.reads(spark, sf_dir), 3)
    parts = [counts.kmers_in(cells, k).select(F.lit(k).cast("long").alias("k"), *[F.col(c).cast("long").alias(c) for c in ("length", "cycle")], "kmer", "n") for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def run_counters(spark, sf_dir):
    """What the manifest of a run over all reads says of them, equal reads counted once."""
    rows = demo.reads(spark, sf_dir)
    twice = rows.unionByName(rows.where("ordinal % 5 = 0"))
    return composition.planned(spark, composition.Settings("reads", min_read_count=MIN_READS, collapse_exact=True, test=False), twice).counters()


def kmer_dense(spark, sf_dir):
    cells, _ = _cells(spark, sf_dir, 2)
    return cells.select(F.col("length").cast("long").alias("length"), F.col("cycle").cast("long").alias("cycle"), "kmer", "n")


def k1_fractions(spark, sf_dir):
    cells, lengths = _cells(spark, sf_dir)
    wide = counts.fractions(cells, lengths)
    return wide.select(F.col("length").cast("long").alias("length"), F.col("cycle").cast("long").alias("cycle"), *[F.round(b, 9).alias(b) for b in BASES])


def chart_kmer_profile(spark, sf_dir):
    cells, lengths = _cells(spark, sf_dir)
    rows = charts.kmer_profile(counts.fractions(cells, lengths), 1)
    return rows.select(F.col("length").cast("long").alias("length"), F.col("cycle").cast("long").alias("cycle"), "kmer", F.round("fraction", 9).alias("fraction"))


def _collapsed(mode: str):
    def query(spark, sf_dir):
        return counts.collapse(demo.reads(spark, sf_dir), mode).select("ordinal", "seq", "copies")

    return query


def dedup_capped(spark, sf_dir):
    return counts.capped_unique(counts.valid_reads(demo.reads(spark, sf_dir)), "sequence", 20).select("ordinal", "seq", "copies")


def revcomp(spark, sf_dir):
    return demo.reads(spark, sf_dir).select("read_id", reverse_complement(F.col("seq")).alias("seq"))


def fixed_trim(spark, sf_dir):
    rows = counts.trimmed_reads(demo.reads(spark, sf_dir), 60, 3, 4)
    return rows.select("read_id", "seq", "valid")


def trim_frequencies(spark, sf_dir):
    rows = counts.positional_frequencies(demo.reads(spark, sf_dir), 60, 2, 1)
    return rows.select(F.col("cycle").cast("long").alias("cycle"), *BASES)


def trim_counters(spark, sf_dir):
    return counts.trim_counters(demo.reads(spark, sf_dir), 60, 1, 0, collapse_exact=True)


def phase_redistribute_hash(spark, sf_dir):
    rows = demo.reads(spark, sf_dir).where((F.length("seq") == 60) & is_unambiguous(F.col("seq")))
    moved = rows.withColumn("trim5", hashed_offset(F.col("read_id"), 42))
    return moved.select("read_id", "trim5", (2 - F.col("trim5")).alias("trim3"), phase_trimmed(F.col("seq"), F.col("trim5")).alias("seq"))


def phase_means(spark, sf_dir):
    cells, _ = _cells(spark, sf_dir)
    rows = harmonic.phase_means(harmonic.window(cells), ["length", "kmer"])
    return rows.select(F.col("length").cast("long").alias("length"), F.col("kmer").alias("base"), F.col("phase").cast("long").alias("phase"), F.round("mean", 9).alias("mean"), "n_cycles")


def _fits(spark, sf_dir) -> DataFrame:
    cells, lengths = _cells(spark, sf_dir)
    rows = harmonic.window(cells).join(lengths, "length").withColumnRenamed("kmer", "base")
    return harmonic.fit(rows, ["length", "base"], scale=F.max("observed_read_count"))


def harmonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = ["length", "start", "end", "n_cycles"]
    numbers = ["intercept", "cos_coef", "sin_coef", "amplitude", "r2"]
    rows = _fits(spark, sf_dir)
    return rows.select("base", *[F.col(c).cast("long").alias(c) for c in whole], *[(F.round(c, 9) + 0.0).alias(c) for c in numbers], F.round("phase_degrees", 5).alias("phase_degrees"), "status")


def cycle_window_status(spark, sf_dir):
    cells, _ = _cells(spark, sf_dir)
    wide = harmonic.window_status(cells).withColumn("window_end", F.lit(40))
    narrow = harmonic.window_status(cells, 55, 62).withColumn("window_end", F.lit(62))
    return wide.unionByName(narrow).select(F.col("length").cast("long").alias("length"), F.col("window_end").cast("long").alias("window_end"), "n_cycles", "status")


_PERMUTATIONS = 99


def _tested(spark, sf_dir) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    rows = harmonic.window(cells).withColumnRenamed("kmer", "base")
    return harmonic.permutation_p(rows, ["length", "base"], _PERMUTATIONS)


def permutation_p(spark, sf_dir):
    return _tested(spark, sf_dir).select(F.col("length").cast("long").alias("length"), "base", "exceeding", F.round("p_value", 9).alias("p_value"))


def holm_adjusted(spark, sf_dir):
    rows = harmonic.holm(_tested(spark, sf_dir), ["length"])
    return rows.select(F.col("length").cast("long").alias("length"), "base", F.round("p_value_adjusted", 9).alias("p_value_adjusted"), "significant", "all_significant")


def profile_compare(spark, sf_dir):
    """Each length's profile against that of length 60."""
    cells, _ = _cells(spark, sf_dir)
    means = harmonic.phase_means(harmonic.window(cells), ["length", "kmer"]).withColumnRenamed("kmer", "base")
    other = means.where("length = 60").select("base", "phase", "mean")
    lengths = F.array_sort(F.collect_set("length"))  # a handful
    every = means.agg(lengths.alias("lengths")).withColumn("base", F.explode(F.array(*map(F.lit, BASES))))
    two = other.join(every, "base").select(F.explode("lengths").alias("length"), "base", "phase", "mean")
    rows = harmonic.compare(means, two, ["length"])
    columns = ["similarity_percent", *[f"similarity_{b}" for b in BASES]]
    return rows.select(F.col("length").cast("long").alias("length"), F.col("best_shift").cast("long").alias("best_shift"), *[F.round(c, 6).alias(c) for c in columns])


def chart_comparison(spark, sf_dir):
    """The phase means of two lengths beside each other."""
    cells, _ = _cells(spark, sf_dir)
    means = harmonic.phase_means(harmonic.window(cells), ["length", "kmer"]).withColumnRenamed("kmer", "base")
    rows = charts.comparison(means.where("length = 59"), means.where("length = 60"))
    return rows.select("profile", "base", F.col("phase").cast("long").alias("phase"), F.round("mean", 9).alias("mean"))


def _series(spark, sf_dir) -> DataFrame:
    cells, lengths = _cells(spark, sf_dir)
    return cells.join(lengths, "length").select("length", F.col("kmer").alias("base"), "cycle", (F.col("n") / F.col("observed_read_count")).alias("x"))


def dft_spectrum(spark, sf_dir):
    rows = spectrum.spectrum(_series(spark, sf_dir), ["length", "base"])
    return rows.select(F.col("length").cast("long").alias("length"), "base", F.col("bin").cast("long").alias("bin"), F.round("frequency", 9).alias("frequency"), F.round("magnitude", 9).alias("magnitude"))


def spectral_r2(spark, sf_dir):
    rows = spectrum.spectral_r2(_series(spark, sf_dir), ["length", "base"])
    return rows.select(F.col("length").cast("long").alias("length"), "base", F.round("magnitude", 9).alias("magnitude"), F.round("r2", 9).alias("r2"))


QUERIES = {
    "read_qc": read_qc, "length_histogram": length_histogram, "select_lengths": select_lengths, "top_lengths": top_lengths, "requested_lengths": requested_lengths,
    "length_table": length_table, "k1_counts": _kmers(1), "k2_counts": _kmers(2), "k3_counts": _kmers(3), "one_scan_kmers": one_scan_kmers, "run_counters": run_counters, "kmer_dense": kmer_dense, "k1_fractions": k1_fractions, "chart_kmer_profile": chart_kmer_profile,
    "collapse_exact": _collapsed("sequence"), "dedup_seq_rc": _collapsed("seq_rc"), "dedup_hash64": _collapsed("hash64"), "dedup_hash64_rc": _collapsed("hash64_rc"), "dedup_capped": dedup_capped,
    "revcomp": revcomp, "fixed_trim": fixed_trim, "trim_frequencies": trim_frequencies, "trim_counters": trim_counters, "phase_redistribute_hash": phase_redistribute_hash,
    "phase_means": phase_means, "harmonic_fit": harmonic_fit, "cycle_window_status": cycle_window_status, "permutation_p": permutation_p, "holm_adjusted": holm_adjusted,
    "profile_compare": profile_compare, "chart_comparison": chart_comparison, "dft_spectrum": dft_spectrum, "spectral_r2": spectral_r2,
}

# ---- the same in SQL

_VALID = f"reads AS ({demo.READS}), valid AS (SELECT * FROM reads WHERE regexp_full_match(seq, '[ACGT]+'))"
_LENGTHS = f"{_VALID}, lengths AS (SELECT length(seq)::BIGINT AS length, count(*) AS reads FROM valid GROUP BY ALL HAVING count(*) >= {MIN_READS})"


def _counts_sql(k: int) -> str:
    return f"SELECT length(seq)::BIGINT AS length, i::BIGINT AS cycle, substring(seq, i, {k}) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM valid) GROUP BY ALL"


def _dense_sql(k: int) -> str:
    tokens = ", ".join(f"('{t}')" for t in kmer_tokens(k))
    return f"""SELECT l.length, i::BIGINT AS cycle, kmer, coalesce(n, 0)::BIGINT AS n
  FROM (SELECT length, unnest(range(1, length - {k} + 2)) AS i FROM lengths) l CROSS JOIN (VALUES {tokens}) AS k(kmer)
  LEFT JOIN ({_counts_sql(k)}) c ON c.length = l.length AND c.cycle = i AND c.kmer = k.kmer"""


_CELLS = f"{_LENGTHS}, cells AS MATERIALIZED ({_dense_sql(1).replace('k.kmer', 'k.kmer').replace(', kmer, coalesce', ', k.kmer AS base, coalesce')})"
_WINDOWED = f"{_CELLS}, win AS (SELECT c.*, reads, cycle % 3 AS phase FROM cells c JOIN lengths USING (length) WHERE cycle BETWEEN 10 AND 40)"


def _copies_sql(key: str) -> str:
    return f"SELECT min(ordinal) AS ordinal, arg_min(seq, ordinal) AS seq, count(*) AS copies FROM reads GROUP BY {key}"


_RC = "reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan'))"
_FIT = """SELECT base, length, min(cycle) AS "start", max(cycle) AS "end", count(*) AS n_cycles,
  avg(n) FILTER (phase = 0) / max(reads) AS m0, avg(n) FILTER (phase = 1) / max(reads) AS m1, avg(n) FILTER (phase = 2) / max(reads) AS m2,
  (sum(n) FILTER (phase = 0))::DOUBLE AS s0, (sum(n) FILTER (phase = 1))::DOUBLE AS s1, (sum(n) FILTER (phase = 2))::DOUBLE AS s2,
  count(*) FILTER (phase = 0) AS n0, count(*) FILTER (phase = 1) AS n1, count(*) FILTER (phase = 2) AS n2,
  (count(*) * sum(n * n) - sum(n) * sum(n))::DOUBLE AS spread, sum(n)::DOUBLE AS total
  FROM win GROUP BY base, length"""
_PERM = f"""base_sums AS (
  SELECT length, base, coalesce(sum(n) FILTER (phase = 0), 0)::HUGEINT AS s0, coalesce(sum(n) FILTER (phase = 1), 0)::HUGEINT AS s1, coalesce(sum(n) FILTER (phase = 2), 0)::HUGEINT AS s2,
    count(*) FILTER (phase = 0) AS n0, count(*) FILTER (phase = 1) AS n1, count(*) FILTER (phase = 2) AS n2 FROM win GROUP BY ALL
), slots AS (SELECT length, base, cycle, n, phase, row_number() OVER (PARTITION BY length, base ORDER BY cycle) AS slot FROM win),
dealt AS (
  SELECT length, base, perm, n, row_number() OVER (PARTITION BY length, base, perm ORDER BY md5('12345:' || perm || ':' || cycle), cycle) AS slot
  FROM slots, range(1, {_PERMUTATIONS + 1}) AS p(perm)
), moved AS (
  SELECT length, base, perm, coalesce(sum(d.n) FILTER (phase = 0), 0)::HUGEINT AS p0, coalesce(sum(d.n) FILTER (phase = 1), 0)::HUGEINT AS p1, coalesce(sum(d.n) FILTER (phase = 2), 0)::HUGEINT AS p2
  FROM dealt d JOIN slots USING (length, base, slot) GROUP BY ALL
), tested AS (
  SELECT length, base, (sum((p0*p0*n1*n2 + p1*p1*n2*n0 + p2*p2*n0*n1 >= s0*s0*n1*n2 + s1*s1*n2*n0 + s2*s2*n0*n1)::INTEGER))::BIGINT AS exceeding
  FROM moved JOIN base_sums USING (length, base) GROUP BY ALL
), p AS (SELECT *, (exceeding + 1) / {float(_PERMUTATIONS + 1)}::DOUBLE AS p_value FROM tested)"""
_SERIES = f"{_CELLS}, series AS (SELECT length, base, cycle, n / reads::DOUBLE AS x FROM cells JOIN lengths USING (length) WHERE cycle BETWEEN 10 AND 39)"
_SPECTRUM = """spectrum AS (
  SELECT length, base, b::BIGINT AS bin, sqrt(power(sum(x * cos(2 * pi() / 30 * (((cycle - 10) * b) % 30))), 2) + power(sum(x * sin(2 * pi() / 30 * (((cycle - 10) * b) % 30))), 2)) / 30 AS magnitude
  FROM series, range(0, 16) AS t(b) GROUP BY ALL)"""
_COMPARE = f"""means AS (SELECT length, base, phase, avg(n) AS mean FROM win GROUP BY ALL),
centred AS (SELECT *, mean - avg(mean) OVER (PARTITION BY length, base) AS c FROM means),
z AS (SELECT length, base, phase, CASE WHEN norm > 1e-12 THEN c / norm ELSE 0 END AS z FROM (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY length, base)) AS norm FROM centred)),
pairs AS (SELECT a.length, a.base, s.shift, sum(a.z * b.z) AS ab, sum(a.z * a.z) AS aa, sum(b.z * b.z) AS bb
  FROM z a CROSS JOIN (VALUES (0), (1), (2)) AS s(shift) JOIN z b ON b.length = 60 AND b.base = a.base AND (b.phase + s.shift) % 3 = a.phase GROUP BY ALL),
shifts AS (SELECT length, shift, CASE WHEN sum(aa) > 0 AND sum(bb) > 0 THEN sum(ab) / sqrt(sum(aa) * sum(bb)) ELSE 0 END AS r FROM pairs GROUP BY ALL),
best AS (SELECT * FROM shifts QUALIFY row_number() OVER (PARTITION BY length ORDER BY round(r, 12) DESC, shift) = 1)"""

_BY_BASE = ", ".join(
    f"round(100 * power(greatest(max(CASE WHEN base = '{b}' THEN CASE WHEN aa > 0 AND bb > 0 THEN ab / sqrt(aa * bb) ELSE 0 END END), 0), 2), 6) AS similarity_{b}" for b in BASES
)

ORACLE_SQL = {
    "read_qc": f"WITH {_VALID} SELECT (SELECT count(*) FROM reads) AS n_total, (SELECT count(*) FROM valid) AS n_valid, (SELECT count(*) FROM reads) - (SELECT count(*) FROM valid) AS n_invalid",
    "length_histogram": f"WITH {_VALID} SELECT length(seq)::BIGINT AS length, count(*) AS observed_read_count FROM valid GROUP BY ALL",
    "select_lengths": f"WITH {_LENGTHS} SELECT length, reads AS observed_read_count FROM lengths",
    "top_lengths": f"WITH {_VALID} SELECT length(seq)::BIGINT AS length, count(*) AS observed_read_count FROM valid GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 3",
    "requested_lengths": f"WITH {_VALID} SELECT l::BIGINT AS length, l IN (SELECT length(seq) FROM valid) AS found FROM (VALUES (59), (60), (75)) AS v(l)",
    "length_table": f"""WITH {_VALID}, o AS (SELECT length(seq)::BIGINT AS length, count(*) AS n FROM valid GROUP BY ALL),
a AS (SELECT length(seq)::BIGINT AS length, count(DISTINCT seq) AS m FROM valid WHERE length(seq) <> 58 GROUP BY ALL)
SELECT length, coalesce(n, 0) AS observed_read_count, coalesce(m, 0) AS analyzed_read_count, coalesce(m, 0) > 0 AS processed, coalesce(n, 0) >= {MIN_READS} AS passed_min_read_count FROM o FULL JOIN a USING (length)""",
    **{f"k{k}_counts": f"WITH {_VALID} {_counts_sql(k)}" for k in (1, 2, 3)},
    "one_scan_kmers": f"WITH {_VALID} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, * FROM ({_counts_sql(k)})" for k in (1, 2, 3)),
    "run_counters": f"""WITH {_VALID}, t AS (SELECT * FROM reads UNION ALL SELECT * FROM reads WHERE ordinal % 5 = 0), v AS (SELECT * FROM t WHERE regexp_full_match(seq, '[ACGT]+')),
l AS (SELECT length(seq) AS length, count(DISTINCT seq) AS n FROM v GROUP BY ALL HAVING count(*) >= {MIN_READS})
SELECT (SELECT count(*) FROM t) AS n_total, count(*) AS n_valid, (SELECT count(*) FROM t) - count(*) AS n_invalid, count(*) - count(DISTINCT seq) AS n_duplicates, count(DISTINCT seq) AS n_analyzed,
  (SELECT count(*) FROM l) AS n_lengths, (SELECT sum(n) FROM l)::BIGINT AS n_taken FROM v""",
    "kmer_dense": f"WITH {_LENGTHS} {_dense_sql(2).replace(', kmer, coalesce', ', k.kmer, coalesce')}",
    "chart_kmer_profile": f"WITH {_CELLS} SELECT length, cycle, base AS kmer, round(sum(n) / max(reads)::DOUBLE, 9) AS fraction FROM cells JOIN lengths USING (length) GROUP BY length, cycle, base",
    "k1_fractions": f"WITH {_CELLS} SELECT length, cycle, " + ", ".join(f"round(sum(n) FILTER (base = '{b}') / max(reads)::DOUBLE, 9) AS {b}" for b in BASES) + " FROM cells JOIN lengths USING (length) GROUP BY length, cycle",
    "collapse_exact": f"WITH {_VALID} {_copies_sql('reads.seq')}",
    "dedup_seq_rc": f"WITH {_VALID} {_copies_sql(f'least(seq, {_RC})')}",
    "dedup_hash64": f"WITH {_VALID} {_copies_sql('reads.seq')}",
    "dedup_hash64_rc": f"WITH {_VALID} {_copies_sql(f'least(seq, {_RC})')}",
    "dedup_capped": f"WITH {_VALID}, u AS (SELECT min(ordinal) AS ordinal, seq, count(*) AS copies FROM valid GROUP BY seq) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY length(seq) ORDER BY ordinal) <= 20",
    "revcomp": f"WITH {_VALID} SELECT read_id, {_RC} AS seq FROM reads",
    "fixed_trim": f"WITH {_VALID} SELECT read_id, substring(seq, 4, 53) AS seq, regexp_full_match(substring(seq, 4, 53), '[ACGT]+') AS valid FROM reads WHERE length(seq) = 60",
    "trim_frequencies": f"WITH {_VALID}, t AS (SELECT substring(seq, 3, 57) AS s FROM reads WHERE length(seq) = 60) SELECT i::BIGINT AS cycle, "
    + ", ".join(f"count(*) FILTER (substring(s, i, 1) = '{b}') AS {b}" for b in BASES) + " FROM t, range(1, 58) AS r(i) WHERE regexp_full_match(s, '[ACGT]+') GROUP BY i",
    "trim_counters": f"""WITH {_VALID}, t AS (SELECT substring(seq, 2, 59) AS s, regexp_full_match(substring(seq, 2, 59), '[ACGT]+') AS ok FROM reads WHERE length(seq) = 60)
SELECT (SELECT count(*) FROM reads) AS records_scanned, count(*) AS raw_length_matched, count(*) FILTER (NOT ok) AS invalid_or_ambiguous,
  count(*) FILTER (ok) - count(DISTINCT CASE WHEN ok THEN s END) AS duplicates_collapsed, count(DISTINCT CASE WHEN ok THEN s END) AS reads_analyzed FROM t""",
    "phase_redistribute_hash": f"""WITH {_VALID}, t AS (SELECT read_id, seq, floor({demo.UNIFORM.format("'42:' || read_id")} * 3)::INTEGER AS f FROM valid WHERE length(seq) = 60)
SELECT read_id, f AS trim5, 2 - f AS trim3, substring(seq, f + 1, 58) AS seq FROM t""",
    "phase_means": f"WITH {_WINDOWED} SELECT length, base, phase, round(avg(n), 9) AS mean, count(*) AS n_cycles FROM win GROUP BY ALL",
    "harmonic_fit": f"""WITH {_WINDOWED}, f AS ({_FIT}), g AS (SELECT *, 2.0/3 * (m0 + m1 * cos(2*pi()/3) + m2 * cos(4*pi()/3)) AS c, 2.0/3 * (m1 * sin(2*pi()/3) + m2 * sin(4*pi()/3)) AS s FROM f)
SELECT base, length, "start", "end", n_cycles, round((m0 + m1 + m2) / 3, 9) + 0.0 AS intercept, round(c, 9) + 0.0 AS cos_coef, round(s, 9) + 0.0 AS sin_coef, round(sqrt(c*c + s*s), 9) + 0.0 AS amplitude,
  CASE WHEN spread <= 0 THEN 0.0 ELSE round(least(greatest((n_cycles * (s0*s0/n0 + s1*s1/n1 + s2*s2/n2) - total * total) / spread, 0), 1), 9) + 0.0 END AS r2,
  round(degrees(atan2(s, c)) - 360 * floor(degrees(atan2(s, c)) / 360), 5) AS phase_degrees, CASE WHEN n_cycles < 9 THEN 'skipped' ELSE 'ok' END AS status FROM g""",
    "cycle_window_status": f"""WITH {_CELLS} SELECT length, e::BIGINT AS window_end, count(DISTINCT CASE WHEN cycle BETWEEN s AND e THEN cycle END) AS n_cycles,
  CASE WHEN count(DISTINCT CASE WHEN cycle BETWEEN s AND e THEN cycle END) < 9 THEN 'skipped' ELSE 'ok' END AS status FROM cells, (VALUES (10, 40), (55, 62)) AS w(s, e) GROUP BY length, e""",
    "permutation_p": f"WITH {_WINDOWED}, {_PERM} SELECT length, base, exceeding, round(p_value, 9) AS p_value FROM p",
    "holm_adjusted": f"""WITH {_WINDOWED}, {_PERM}, r AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY p_value, instr('ATGC', base)) AS k FROM p),
h AS (SELECT *, max(least((5 - k) * p_value, 1.0)) OVER (PARTITION BY length ORDER BY k ROWS UNBOUNDED PRECEDING) AS a FROM r)
SELECT length, base, round(a, 9) AS p_value_adjusted, a < 0.05 AS significant, bool_and(a < 0.05) OVER (PARTITION BY length) AS all_significant FROM h""",
    "chart_comparison": f"""WITH {_WINDOWED} SELECT CASE length WHEN 59 THEN 'one' ELSE 'two' END AS profile, base, phase::BIGINT AS phase, round(avg(n), 9) AS mean FROM win WHERE length IN (59, 60) GROUP BY ALL""",
    "profile_compare": f"""WITH {_WINDOWED}, {_COMPARE}
SELECT length, any_value(b.shift)::BIGINT AS best_shift, round(100 * power(greatest(any_value(r), 0), 2), 6) AS similarity_percent, {_BY_BASE} FROM best b JOIN pairs USING (length, shift) GROUP BY length""",
    "dft_spectrum": f"WITH {_SERIES}, {_SPECTRUM} SELECT length, base, bin, round(bin / 30.0::DOUBLE, 9) AS frequency, round(magnitude, 9) AS magnitude FROM spectrum",
    "spectral_r2": f"""WITH {_SERIES}, {_SPECTRUM}, v AS (SELECT length, base, var_pop(x) AS v FROM series GROUP BY ALL)
SELECT length, base, round(magnitude, 9) AS magnitude, round(CASE WHEN v <= 1e-28 THEN 0 ELSE least(2 * magnitude * magnitude / v, 1) END, 9) AS r2 FROM spectrum JOIN v USING (length, base) WHERE bin = 10""",
}
