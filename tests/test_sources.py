import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from seqcycle.operators import cds, counts, rollup
from seqcycle.sources import detect, sequences, sinks, streams, tables


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_bytes(b">r1 first\r\nACG\r\ntt\r\n\r\n>r2\n\n>r3\nNNA\n")
    rows = sequences.fasta(spark, str(p)).orderBy("ordinal").collect()
    assert [(r.read_id, r.seq, r.description) for r in rows] == [("r1", "ACGTT", "r1 first"), ("r3", "NNA", "r3")]
    with pytest.raises(ValueError):
        sequences.fasta(spark, str(_headerless(tmp_path)))
    assert sequences.fasta(spark, str(tmp_path / "c.fa"), allow_headerless=True).count() == 1


def _headerless(tmp_path):
    p = tmp_path / "c.fa"
    p.write_text("ACGT\nACGT\n")
    return p


def test_fastq_plain_gzip_and_errors(spark, tmp_path):
    text = b"@a x\r\nACGTACGTACGT\r\n+\r\n@@@@@@@@@@@@\r\n@b\nacgtacgtacgt\n+\nIIIIIIIIIIII\n@c\nACGTACGTACGN\n+\nIIIIIIIIIIII\n"
    (tmp_path / "x_R1.fastq").write_bytes(text)
    with gzip.open(tmp_path / "x_R2.fastq.gz", "wb") as f:
        f.write(text)
    rows = sequences.fastq(spark, str(tmp_path / "x_R1.fastq")).orderBy("ordinal").collect()
    assert [r.seq for r in rows] == ["ACGTACGTACGT", "ACGTACGTACGT", "ACGTACGTACGN"] and rows[0].qual == "@" * 12
    pair = f"{tmp_path}/x_R1.fastq,{tmp_path}/x_R2.fastq.gz"
    assert detect.reads(spark, pair, which="both").count() == 6 and detect.reads(spark, pair).count() == 3
    assert detect.sample_name(pair) == "x"
    assert counts.read_qc(sequences.fastq(spark, str(tmp_path / "x_R1.fastq"))).first().n_invalid == 1
    (tmp_path / "bad.fq").write_bytes(b"@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="malformed"):
        sequences.fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_parts_of_a_fastq_file_give_each_record_once(spark, tmp_path):
    import random

    draw = random.Random(2)
    rows = []
    for i in range(120):
        n = draw.randrange(0, 30)
        rows.append((f"r{i}", "".join(draw.choice("ACGTN") for _ in range(n)), "".join(draw.choice("@+I!A") for _ in range(n))))
    for end in ("\n", "\r\n"):
        text = end.join(f"@{name} d{end}{seq}{end}+{name if i % 3 else ''}{end}{qual}" for i, (name, seq, qual) in enumerate(rows)) + (end if end == "\n" else "")
        path = tmp_path / f"parts{len(end)}.fastq"
        path.write_bytes(text.encode())
        for size in (7, 50, 333, 10**6):
            got = sequences.fastq(spark, str(path), split_bytes=size).orderBy("ordinal").collect() if size > 40 else [t for p in streams.ranges([str(path)], size) for t in sequences._fastq(p)]
            assert [(r[1], r[3], r[4]) for r in got] == [r for r in rows if r[1]]
    (tmp_path / "bad.fastq").write_text("@a\nACGT\n+\nIIII\n" * 5 + "junk\n" * 30)
    with pytest.raises(Exception, match="malformed"):
        sequences.fastq(spark, str(tmp_path / "bad.fastq"), split_bytes=60).collect()
    assert sequences.fastq(spark, str(path), split_bytes=333).rdd.getNumPartitions() > 3


def test_formats(tmp_path):
    (tmp_path / "u").write_text("\n\n>x\nA\n")
    assert detect.kind([str(tmp_path / "u")]) == "fasta" and detect.kind(["a.fq.gz"]) == "fastq" and detect.kind(["x"], "bam") == "bam"
    with pytest.raises(ValueError):
        detect.kind(["a.fq", "b.fa"])
    assert detect.sample_name("/d/lib.fasta.gz") == "lib" and detect.sample_name("/d/lib_1.fq") == "lib" and detect.sample_name("/d/lib.bam") == "lib"


SAM = "@HD\tVN:1.6\nq1\t16\tc1\t101\t60\t4M\t*\t0\t0\tAACG\tABCD\tNM:i:1\tRG:Z:x\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*\nq3\t1024\tc1\t5\t9\t2M1D2M\t*\t0\t0\tACGT\tIIII\n"


def bam_bytes():
    def record(name, flag, contig, place, mapq, cigar, seq, qual, tags):
        codes = "=ACMGRSVTWYHKDBN"
        n = [codes.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(n[i] << 4 | n[i + 1] for i in range(0, len(n), 2))
        body = struct.pack("<iiBBHHHiiii", contig, place, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", c << 4 | "MIDNSHP=X".index(o)) for c, o in cigar) + packed + qual + tags
        return struct.pack("<i", len(body)) + body

    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    data += record("q1", 16, 0, 100, 60, [(4, "M")], "AACG", bytes(ord(c) - 33 for c in "ABCD"), b"NMC\1RGZx\0")
    data += record("q2", 4, -1, -1, 0, [], "ACGT", b"\xff" * 4, b"XBBs\2\0\0\0\1\0\2\0")
    data += record("q3", 1024, 0, 4, 9, [(2, "M"), (1, "D"), (2, "M")], "ACGT", b"\x28" * 4, b"")
    out = b""
    for part in (data[:50], data[50:], b""):  # blocks cut a record
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_sam_and_bam_agree(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.bam").write_bytes(bam_bytes())
    columns = ["read_id", "flag", "mapq", "contig", "cigar", "seq", "qual"]
    a, b = (sorted(map(tuple, f(spark, str(tmp_path / n)).select(*columns).collect())) for f, n in ((sequences.sam, "a.sam"), (sequences.bam, "a.bam")))
    assert [tuple(x or "" for x in r) for r in a] == [tuple(x or "" for x in r) for r in b]
    row = sequences.bam(spark, str(tmp_path / "a.bam")).where("read_id = 'q3'").first()
    assert (row.ref_start, row.ref_end) == (4, 9)
    assert sequences.bam(spark, str(tmp_path / "a.bam")).where("read_id = 'q1'").first().tags == {"NM": "i:1", "RG": "Z:x"}
    assert sequences.sam(spark, str(tmp_path / "a.sam")).where("read_id = 'q3'").first().ref_end == 9
    reads = {r.read_id: r for r in sequences.as_reads(sequences.bam(spark, str(tmp_path / "a.bam")), duplicates=False).collect()}
    assert set(reads) == {"q1", "q2"} and reads["q1"].seq == "CGTT" and reads["q1"].qual == "DCBA"
    with pytest.raises(ValueError):
        sequences.bam(spark, "x.cram")
    assert list(streams.opened(str(tmp_path / "a.bam")).read(4)) == list(b"BAM\1")


def test_gff_and_codon_phase(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g\nc\ts\tCDS\t101\t200\t.\t+\t1\tID=a;ID=b=c;Parent=p\nc\ts\tCDS\t101\t200\t.\t-\t1\tParent=m\nd\ts\tCDS\t1\t9\t.\t+\t.\tnote\n")
    rows = {r.identifier: r for r in tables.gff3(spark, str(tmp_path / "a.gff")).collect()}
    assert set(rows) == {"b=c", "m", "d:0-9:+"} and rows["b=c"].start == 100 and rows["b=c"].end == 200 and rows["d:0-9:+"].phase == 0
    places = [(101, 131, "+", 0), (102, 132, "+", 1), (169, 199, "-", 0), (168, 198, "-", 1)]
    df = spark.createDataFrame([(a, b, 100, 200, s, 1, want) for a, b, s, want in places], "a long, b long, s long, e long, strand string, p int, want int")
    assert df.where(cds.codon_phase(F.col("a"), F.col("b"), F.col("s"), F.col("e"), F.col("strand"), F.col("p")) != F.col("want")).count() == 0


def test_composition_table_checks(spark, tmp_path):
    (tmp_path / "k1.csv").write_text("cycle,A,T,G,C\n2,0.2,0.3,0.3,0.2\n1,0.25,0.25,0.25,0.25\n")
    assert [r.cycle for r in tables.one_mer_csv(spark, str(tmp_path / "k1.csv")).collect()] == [1, 2]
    for text in ("cycle,A,T,G\n1,0,0,1\n", "cycle,A,T,G,C\n1,2,0,0,0\n", "cycle,A,T,G,C\n1,x,0,0,0\n", "cycle,A,T,G,C\n1,1,0,0,0\n1,1,0,0,0\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ValueError):
            tables.one_mer_csv(spark, str(tmp_path / "bad.csv"))


def test_results_metadata_and_best_length(spark, tmp_path):
    import json

    for sample, length, r2, n in (("ERR1", 59, 0.9, None), ("ERR1", 60, 0.7, 1000), ("internal1", 59, 0.4, 500)):
        d = tmp_path / sample / "stats/period3/kmer" / f"L{length}"
        d.mkdir(parents=True)
        (d / "k1_period3.json").write_text(json.dumps({"read_count": n, "fits": [{"base": b, "r2": r2} for b in "ATGC"]}, indent=1))
    d = tmp_path / "ERR1/stats/period3/kmer/L61"
    d.mkdir()
    (d / "k1_period3.json").write_text("{broken")
    good, bad = rollup.parsed_results(tables.result_files(spark, str(tmp_path)))
    assert good.count() == 3 and bad.count() == 1
    best = {r.sample: r for r in rollup.library_summary(good).collect()}
    assert best["ERR1"].best_length == 59 and best["ERR1"].best_length_read_count is None and best["ERR1"].n_eligible_lengths == 2 and best["internal1"].category == "internal_ancient"
    (tmp_path / "m.tsv").write_text("archive_data_accession\tlibrary_name\tproject_name\nERR1\tNA\tP\nNA\tother\tQ\n")
    joined = rollup.joined_metadata(rollup.library_summary(good), tables.metadata_tsv(spark, str(tmp_path / "m.tsv")), internal_project="mine")
    rows = {r.sample: r for r in joined.collect()}
    assert rows["ERR1"]["_metadata_merge"] == "both" and rows["internal1"].project_name == "mine" and [r.sample for r in rollup.unmatched(joined).collect()] == ["internal1"]
    twice = spark.createDataFrame([("ERR1",), ("ERR1",)], "archive_data_accession string")
    with pytest.raises(ValueError):
        rollup.joined_metadata(rollup.library_summary(good), twice)


def test_a_tree_of_results_has_few_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 3 AS length", "concat('{\"n\":', id, '}') AS value")
    sinks.tree(rows, str(tmp_path / "tree"), "length")
    assert len(list((tmp_path / "tree").rglob("part-*"))) <= 12
    found = tables.result_lines(spark, str(tmp_path / "tree"), "length long")
    assert found.columns == ["content", "length"] and {(r.length, r.content) for r in found.collect()} == {(r.length, r.value) for r in rows.collect()}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "r1 x", 0x1 | 0x10 | 0x40, "ACGT", "IIII", {"NM": "i:1", "XX": "Z:a"}, 1, 1)], "read_id string, description string, flag int, seq string, qual string, tags map<string,string>, trim5 int, trim3 int")
    sinks.fasta(rows, str(tmp_path / "f"), sinks.trimmed_header(rows))
    assert "".join(p.read_text() for p in (tmp_path / "f").glob("part-*")) == ">r1 x phase_trim5=1 trim3=1\nACGT\n"
    assert sinks.sam_lines(rows, ["NM"]).first().value == "r1\t77\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\tNM:i:1\tZT:Z:1,1"
    sinks.table(rows.drop("tags"), str(tmp_path / "t"), kind="tsv")
    sinks.table(rows.drop("tags"), str(tmp_path / "t"), kind="tsv", skip_existing=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.table(rows.drop("tags"), str(tmp_path / "t"), kind="tsv")


def test_mates_are_judged_each_by_its_own_place(spark):
    features = spark.createDataFrame([("c", 0, 60, "+", 0, "one"), ("c", 100, 160, "+", 0, "two")], "contig string, start long, end long, strand string, phase int, identifier string")
    seq = "ACG" * 10
    rows = [("m", 65, 40, "c", 3, 33, "30M", seq), ("m", 129, 40, "c", 103, 133, "30M", seq), ("m", 65, 40, "c", 200, 230, "30M", seq), ("m", 81, 40, "c", 3, 33, "30M", seq), ("m", 65, 40, "c", 3, 33, "30M", seq)]
    df = spark.createDataFrame(rows, "read_id string, flag int, mapq int, contig string, ref_start long, ref_end long, cigar string, seq string")
    got = sorted((r.ref_start, r.flag, r.reason, r.cds_identifier) for r in cds.classified(df, features).collect())
    assert got == [(3, 65, "written", "one"), (3, 65, "written", "one"), (3, 81, "not_fully_contained_or_antisense", None), (103, 129, "written", "two"), (200, 65, "no_cds_overlap", None)]


def test_first_rows_equal_a_sort(spark):
    import random

    draw = random.Random(4)
    values = [draw.randrange(-5, 10**draw.randrange(1, 18)) for _ in range(3000)] + [7] * 50 + [10**17] * 20
    df = spark.createDataFrame([(v,) for v in values], "ordinal long")
    for n in (1, 40, 55, 1000, 3069, 3070, 5000):
        got = sorted(r.ordinal for r in counts.first_rows(df, n, few=0, buckets=16).collect())
        assert got == sorted(values)[:n]
