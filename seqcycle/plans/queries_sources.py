"""Queries that write the test tables in each file format to a shared folder, read them back, and return what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import hashed_offset, is_unambiguous, phase_trimmed
from ..operators import counts
from ..sources import sequences, sinks, tables
from ..sources.shared import new_folder, part_files, text_lines
from . import demo
from .queries_composition import ORACLE_SQL as COMPOSED

LENGTH, SEED = 60, 42


def _qualities():
    return F.translate("seq", "ACGTN", "IJ@+#")


def _reads(spark, sf_dir) -> DataFrame:
    return demo.reads(spark, sf_dir)


def fasta_file(spark, sf_dir):
    """Sequences on two lines, in lower case, behind a header of two words."""
    folder = new_folder(spark, "fasta")
    rows = _reads(spark, sf_dir).withColumn("seq", F.lower(F.concat(F.substring("seq", 1, 30), F.lit("\n"), F.substring("seq", 31, 100))))
    sinks.fasta(rows, folder, F.concat("read_id", F.lit(" more words")))
    return sequences.fasta(spark, folder).select("read_id", "seq", "description")


def fastq_file(spark, sf_dir, compression=None):
    folder = new_folder(spark, "fastq")
    lines = sinks.fastq_lines(_reads(spark, sf_dir).withColumn("qual", _qualities()), F.concat("read_id", F.lit(" x")))
    text_lines(lines, folder, compression=compression)
    return sequences.fastq(spark, part_files(spark, folder)).select("read_id", "seq", "qual")


def fastq_gzip_file(spark, sf_dir):
    return fastq_file(spark, sf_dir, "gzip")


def _mates(spark, sf_dir) -> list[list[str]]:
    """Both mates in files of their own, the second ones reversed; the files of a mate follow each other in the order of the reads."""
    reads = _reads(spark, sf_dir).withColumn("qual", _qualities()).orderBy("ordinal")
    paths = []
    for mate, rows in ((1, reads), (2, reads.withColumn("seq", F.reverse("seq")).withColumn("qual", F.reverse("qual")))):
        folder = new_folder(spark, f"mate{mate}")
        sinks.fastq(rows, folder, F.col("read_id"))
        paths.append(part_files(spark, folder))
    return paths


def paired_files(spark, sf_dir):
    """Both mates of pairs of files."""
    return sequences.paired(spark, *_mates(spark, sf_dir), which="both").select("read_id", "mate", "seq")


def _capped(spark, sf_dir, reads: DataFrame) -> DataFrame:
    """The first three quarters of all records, by counting in ranges rather than by sorting."""
    return counts.first_rows(reads, reads.count() * 3 // 4, few=0)


def capped_mates(spark, sf_dir):
    """Records in input order under a cap: all of the first mates before any of the second."""
    return _capped(spark, sf_dir, sequences.paired(spark, *_mates(spark, sf_dir), which="both")).select("read_id", "mate", "seq")


def capped_files(spark, sf_dir):
    """The same over two folders of FASTA files in the order given."""
    folders = []
    for odd in (1, 0):
        folders.append(new_folder(spark, "half"))
        sinks.fasta(_reads(spark, sf_dir).where(F.col("ordinal") % 2 == odd).orderBy("ordinal"), folders[-1], F.col("read_id"))
    return _capped(spark, sf_dir, sequences.fasta(spark, folders)).select("read_id", "seq")


def sam_file(spark, sf_dir):
    folder = new_folder(spark, "sam")
    rows = demo.alignments(spark, sf_dir)
    fields = [F.col("read_id"), F.col("flag"), F.col("contig"), F.col("ref_start") + 1, F.col("mapq"), F.col("cigar"), F.lit("*"), F.lit(0), F.lit(0), F.coalesce("seq", F.lit("*")), F.lit("*"), F.lit("RG:Z:a:b")]
    text_lines(rows.select(F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value")), folder)
    got = sequences.sam(spark, folder)
    return got.select("read_id", "flag", "mapq", "contig", "ref_start", "ref_end", "cigar", "seq", F.element_at("tags", "RG").alias("rg"))


def sam_reads(spark, sf_dir):
    """Alignments as reads in sequenced orientation, without secondary, supplementary, failed and sequence-less records."""
    return sequences.as_reads(demo.alignments(spark, sf_dir).withColumn("qual", F.lit(None).cast("string"))).select("read_id", "flag", "seq")


def gff3_file(spark, sf_dir):
    folder = new_folder(spark, "gff")
    rows = demo.features(spark, sf_dir)
    attributes = F.when(F.col("phase") == 0, F.concat(F.lit("ID="), "identifier")).when(F.col("phase") == 1, F.concat(F.lit("Note=x; Parent="), "identifier")).otherwise(F.lit("Note=y"))
    fields = ["contig", F.lit("x"), F.lit("CDS"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.col("phase").cast("string"), attributes]
    lines = rows.select(F.concat_ws("\t", *fields).alias("value")).unionByName(spark.createDataFrame([("##gff-version 3",), ("c0\tx\tgene\t1\t9\t.\t+\t.\tID=g",)], "value string"))
    text_lines(lines, folder)
    return tables.gff3(spark, folder)


def one_mer_file(spark, sf_dir):
    """The composition of reads of one length, by way of its table in CSV."""
    folder = new_folder(spark, "onemer")
    valid = _reads(spark, sf_dir).where(is_unambiguous(F.col("seq")) & (F.length("seq") == LENGTH))
    cells = counts.kmer_counts(valid, 1).withColumn("cycle", F.col("cycle").cast("int"))
    total = valid.count()
    wide = cells.groupBy("cycle").pivot("kmer", list("ATGC")).agg(F.sum("n")).select("cycle", *[F.round(F.coalesce(b, F.lit(0)) / total, 9).alias(b) for b in "ATGC"])
    sinks.table(wide, folder, kind="csv")
    return tables.one_mer_csv(spark, folder).select(F.col("cycle").cast("long").alias("cycle"), *"ATGC")


def metadata_file(spark, sf_dir):
    """Metadata in a tab-separated file; the usual strings for missing values come back as nulls."""
    folder = new_folder(spark, "metadata")
    rows = demo.metadata(spark, sf_dir)
    sinks.table(rows.select(*[F.coalesce(c, F.lit("NA")).alias(c) for c in rows.columns]), folder, kind="tsv")
    return tables.metadata_tsv(spark, folder)


def simulation_file(spark, sf_dir):
    folder = new_folder(spark, "simulations")
    sinks.table(demo.simulations(spark, sf_dir), folder, kind="csv")
    got = tables.simulation_csv(spark, folder)
    return got.select("genome", "bias_5prime", "bias_3prime", F.col("replicate").cast("int").alias("replicate"), "base", F.round("r2", 9).alias("r2"))


def json_tree(spark, sf_dir):
    """Results in a tree of folders: a folder for each length, in which files of JSON lines hold the fits of many samples, found and parsed again."""
    folder = new_folder(spark, "tree")
    rows = demo.lengths(spark, sf_dir)
    fits = F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.struct(b.alias("base"), F.col("mean_r2").alias("r2")))
    content = F.to_json(F.struct(F.lit("fits").alias("kind"), "sample", fits.alias("fits")))
    sinks.tree(rows.select("read_length", content.alias("value")), folder, "read_length")
    found = tables.result_lines(spark, folder, "read_length long")
    parsed = F.from_json("content", "sample string, fits array<struct<base:string,r2:double>>")
    lines = found.select("read_length", parsed.alias("p"))
    return lines.select("p.sample", "read_length", F.explode("p.fits").alias("f")).select("sample", "read_length", "f.base", F.round("f.r2", 9).alias("r2"))


def _trimmed(spark, sf_dir) -> DataFrame:
    rows = _reads(spark, sf_dir).where((F.length("seq") == LENGTH) & is_unambiguous(F.col("seq"))).withColumn("qual", _qualities()).withColumn("description", F.concat("read_id", F.lit(" d")))
    moved = rows.withColumn("trim5", hashed_offset(F.col("read_id"), SEED)).withColumn("trim3", 2 - F.col("trim5"))
    return moved.withColumns({c: phase_trimmed(F.col(c), F.col("trim5")) for c in ("seq", "qual")})


def trimmed_fastq_file(spark, sf_dir):
    folder, rows = new_folder(spark, "trimmed"), _trimmed(spark, sf_dir)
    sinks.fastq(rows, folder, sinks.trimmed_header(rows))
    return sequences.fastq(spark, part_files(spark, folder)).select("read_id", "seq", "qual", "description")


def trimmed_sam_file(spark, sf_dir):
    """Trimmed reads as unmapped records with kept tags and the trim in a tag of its own."""
    folder = new_folder(spark, "trimmedsam")
    rows = _trimmed(spark, sf_dir).withColumn("flag", F.when(F.col("ordinal") % 2 == 0, 0x51).otherwise(0x200)).withColumn("tags", F.create_map(F.lit("RG"), F.lit("Z:g"), F.lit("XX"), F.lit("i:1")))
    text_lines(sinks.sam_lines(rows, ["RG", "NM"]), folder)
    got = sequences.sam(spark, folder)
    return got.select("read_id", "flag", "mapq", "contig", "seq", "qual", F.element_at("tags", "RG").alias("rg"), F.element_at("tags", "ZT").alias("zt"), F.map_contains_key("tags", "XX").alias("other"))


def trimmed_bam_file(spark, sf_dir):
    """The same in binary files."""
    rows = _trimmed(spark, sf_dir).withColumn("flag", F.when(F.col("ordinal") % 2 == 0, 0x51).otherwise(0x200)).withColumn("tags", F.create_map(F.lit("RG"), F.lit("Z:g"), F.lit("NM"), F.lit("i:3"), F.lit("XX"), F.lit("i:1")))
    got = sequences.bam(spark, sinks.bam(rows, new_folder(spark, "trimmedbam"), ["RG", "NM"]))
    return got.select("read_id", "flag", "mapq", "contig", "seq", "qual", F.element_at("tags", "RG").alias("rg"), F.element_at("tags", "NM").alias("nm"), F.element_at("tags", "ZT").alias("zt"), F.map_contains_key("tags", "XX").alias("other"))


def trim_run_counters(spark, sf_dir):
    return counts.trim_run(_reads(spark, sf_dir), LENGTH, hashed_offset(F.col("read_id"), SEED))


QUERIES = {
    "fasta_file": fasta_file, "fastq_file": fastq_file, "fastq_gzip_file": fastq_gzip_file, "paired_files": paired_files, "capped_mates": capped_mates, "capped_files": capped_files, "sam_file": sam_file, "sam_reads": sam_reads, "gff3_file": gff3_file, "one_mer_file": one_mer_file,
    "metadata_file": metadata_file, "simulation_file": simulation_file, "json_tree": json_tree, "trimmed_fastq_file": trimmed_fastq_file, "trimmed_sam_file": trimmed_sam_file, "trimmed_bam_file": trimmed_bam_file, "trim_run_counters": trim_run_counters,
}

# ---- the same in SQL

_TRIM = COMPOSED["phase_redistribute_hash"]
_Q = "translate({0}, 'ACGTN', 'IJ@+#')"
_MISSING = ", ".join("'" + s.replace("'", "''") + "'" for s in tables.NA_STRINGS)
_FASTQ = f"WITH r AS ({demo.READS}) SELECT read_id, seq, {_Q.format('seq')} AS qual FROM r"

ORACLE_SQL = {
    "fasta_file": f"WITH r AS ({demo.READS}) SELECT read_id, seq, read_id || ' more words' AS description FROM r",
    "fastq_file": _FASTQ,
    "fastq_gzip_file": _FASTQ,
    "paired_files": f"WITH r AS ({demo.READS}) SELECT read_id, 1 AS mate, seq FROM r UNION ALL SELECT read_id, 2, reverse(seq) FROM r",
    "capped_mates": f"""WITH r AS ({demo.READS}), m AS (SELECT read_id, 1 AS mate, seq, ordinal FROM r UNION ALL SELECT read_id, 2, reverse(seq), ordinal FROM r)
SELECT read_id, mate, seq FROM m QUALIFY row_number() OVER (ORDER BY mate, ordinal) <= (SELECT count(*) * 3 // 4 FROM m)""",
    "capped_files": f"WITH r AS ({demo.READS}) SELECT read_id, seq FROM r QUALIFY row_number() OVER (ORDER BY ordinal % 2 DESC, ordinal) <= (SELECT count(*) * 3 // 4 FROM r)",
    "sam_file": f"WITH a AS ({demo.ALIGNMENTS}) SELECT read_id, flag, mapq, contig, ref_start, ref_start + regexp_extract(cigar, '^([0-9]+)M', 1)::BIGINT + CASE WHEN cigar LIKE '%I%' THEN 2 ELSE 0 END AS ref_end, cigar, seq, 'Z:a:b' AS rg FROM a",
    "sam_reads": f"WITH a AS ({demo.ALIGNMENTS}) SELECT read_id, flag, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGTN', 'TGCAN')) ELSE seq END AS seq FROM a WHERE flag & 2816 = 0 AND seq IS NOT NULL",
    "gff3_file": f"""WITH f AS ({demo.FEATURES}) SELECT contig, start, "end", strand, phase, CASE WHEN phase < 2 THEN identifier ELSE contig || ':' || start || '-' || "end" || ':' || strand END AS identifier FROM f""",
    "one_mer_file": f"""WITH v AS (SELECT seq FROM ({demo.READS}) WHERE regexp_full_match(seq, '[ACGT]+') AND length(seq) = {LENGTH}), c AS (SELECT unnest(range(1, {LENGTH} + 1)) AS i, seq FROM v)
SELECT i AS cycle, """ + ", ".join(f"round(count(*) FILTER (substring(seq, i, 1) = '{b}') / (SELECT count(*) FROM v)::DOUBLE, 9) AS {b}" for b in "ATGC") + " FROM c GROUP BY i",
    "metadata_file": f"WITH m AS ({demo.METADATA}) SELECT " + ", ".join(f"CASE WHEN {c} NOT IN ({_MISSING}) THEN {c} END AS {c}" for c in ("archive_data_accession", "library_name", "project_name", "material", "region")) + " FROM m",
    "simulation_file": f"SELECT genome, bias_5prime, bias_3prime, replicate, base, round(r2, 9) AS r2 FROM ({demo.SIMULATIONS})",
    "json_tree": f"SELECT sample, read_length::BIGINT AS read_length, base, round(mean_r2, 9) AS r2 FROM ({demo.LENGTHS}), (VALUES ('A'), ('C'), ('G'), ('T')) AS b(base)",
    "trimmed_fastq_file": f"SELECT read_id, seq, {_Q.format('seq')} AS qual, read_id || ' d phase_trim5=' || trim5 || ' trim3=' || trim3 AS description FROM ({_TRIM})",
    "trimmed_sam_file": f"""SELECT read_id, CASE WHEN substring(read_id, 2)::BIGINT % 2 = 0 THEN 77 ELSE 516 END AS flag, 0 AS mapq, NULL::VARCHAR AS contig, seq, {_Q.format('seq')} AS qual,
  'Z:g' AS rg, 'Z:' || trim5 || ',' || trim3 AS zt, false AS other FROM ({_TRIM})""",
    "trimmed_bam_file": f"""SELECT read_id, CASE WHEN substring(read_id, 2)::BIGINT % 2 = 0 THEN 77 ELSE 516 END AS flag, 0 AS mapq, NULL::VARCHAR AS contig, seq, {_Q.format('seq')} AS qual,
  'Z:g' AS rg, 'i:3' AS nm, 'Z:' || trim5 || ',' || trim3 AS zt, false AS other FROM ({_TRIM})""",
    "trim_run_counters": f"""WITH r AS ({demo.READS}), t AS (SELECT trim5 FROM ({_TRIM})), n AS (
  SELECT 'records_seen' AS counter, count(*) AS n FROM r UNION ALL SELECT 'length_matched', count(*) FROM r WHERE length(seq) = {LENGTH}
  UNION ALL SELECT 'ambiguous_excluded', count(*) FROM r WHERE length(seq) = {LENGTH} AND NOT regexp_full_match(seq, '[ACGT]+') UNION ALL SELECT 'records_written', count(*) FROM t
  UNION ALL SELECT 'offset_' || o, count(*) FILTER (trim5 = o) FROM t, (VALUES (0), (1), (2)) AS v(o) GROUP BY o
) SELECT * FROM n""",
}
