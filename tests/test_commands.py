import csv
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqcycle.__main__ import main
from seqcycle.plans import composition
from seqcycle.streaming import composition as streaming


def read_tsv(folder):
    return [r for p in sorted(Path(folder).rglob("part-*")) for r in csv.DictReader(p.open(), delimiter="\t")]


def read(folder):
    return [r for p in sorted(Path(folder).rglob("part-*")) for r in csv.DictReader(p.open())]


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    p = tmp_path_factory.mktemp("d") / "input.fasta"
    motifs = ("ATG", "TGA", "GAT")
    p.write_text("".join(f">r{i}\n{motifs[i % 3] * 20}\n" for i in range(180)))
    return p


def test_kmer_command(spark, fasta, tmp_path):
    main(["kmer", str(fasta), "--outdir", str(tmp_path), "--min-read-count", "100", "--k", "1,2", "--permutations", "20"])
    rows = read(tmp_path / "input/csv/kmer/k1")
    assert len(rows) == 60 and all(abs(float(r["A"]) - 1 / 3) < 1e-12 and float(r["C"]) == 0 for r in rows)
    assert len(read(tmp_path / "input/csv/kmer/k2")) == 59
    assert read(tmp_path / "input/stats/read_lengths") == [{"length": "60", "observed_read_count": "180", "analyzed_read_count": "180", "processed": "true", "passed_min_read_count": "true"}]
    fits = json.loads("".join(p.read_text() for p in (tmp_path / "input/stats/period3").glob("part-*")))["fits"]
    assert {f["base"]: (f["r2"], f["p_value"], f["significant"]) for f in fits} == {b: (0.0, 1.0, False) for b in "ATGC"}
    main(["kmer", str(fasta), "--outdir", str(tmp_path), "--min-read-count", "100", "--no-test", "--skip-existing"])
    with pytest.raises(ValueError, match="60: 180"):
        composition.planned(spark, composition.Settings(str(fasta)))
    with pytest.raises(ValueError, match="61"):
        composition.planned(spark, composition.Settings(str(fasta), lengths=(60, 61)))
    with pytest.raises(ValueError):
        composition.Settings("x", k=(4,))


def test_dry_run_writes_nothing(spark, fasta, tmp_path, capsys):
    main(["kmer", str(fasta), "--outdir", str(tmp_path / "none"), "--min-read-count", "1", "--no-test", "--dry-run"])
    assert "Physical Plan" in capsys.readouterr().out and not (tmp_path / "none").exists()


def test_table_commands(spark, tmp_path, capsys):
    import math

    def wave(shift):
        lines = ["cycle,A,T,G,C"]
        for t in range(1, 61):
            a, b = 0.25 + 0.025 * math.cos(2 * math.pi * (t + shift) / 3), 0.25 + 0.02 * math.sin(2 * math.pi * (t + shift) / 3)
            lines.append(f"{t},{a},{b},{0.5 - a},{0.5 - b}")
        return "\n".join(lines)

    for k in (0, 1):
        (tmp_path / f"{k}.csv").write_text(wave(k))
    main(["test", str(tmp_path / "0.csv"), "--permutations", "200"])
    got = json.loads(capsys.readouterr().out)
    assert all(f["significant"] and math.isclose(f["r2"], 1.0) for f in got["fits"])
    main(["compare", str(tmp_path / "0.csv"), str(tmp_path / "1.csv")])
    got = json.loads(capsys.readouterr().out)
    assert got["best_shift"] == 1 and math.isclose(got["similarity_percent"], 100.0)


def test_dft_trim_and_em_commands(spark, fasta, tmp_path):
    main(["dft", str(fasta), "--output", str(tmp_path / "dft")])
    rows = read(tmp_path / "dft/spectrum")
    assert len(rows) == 64 and all(abs(float(r["magnitude"]) - (1 / 3 if r["bin"] == "0" and r["base"] != "C" else 0)) < 1e-12 for r in rows)
    main(["trim", str(fasta), str(tmp_path / "trim"), "--five", "1"])
    text = "".join(p.read_text() for p in (tmp_path / "trim/reads").glob("part-*"))
    assert text.count(">") == 180 and "phase_trim5=1 trim3=1" in text
    main(["em", str(fasta), "--out", str(tmp_path / "em"), "--restarts", "2"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "em/L60/manifest").glob("part-*")))["e_steps"] == 2
    facts = json.loads("".join(p.read_text() for p in (tmp_path / "trim/manifest").glob("part-*")))
    assert facts == {"records_seen": 180, "length_matched": 180, "ambiguous_excluded": 0, "records_written": 180, "offset_0": 0, "offset_1": 180, "offset_2": 0}
    assert [(r["canonicalization_mode"], r["effective_length_mod3"]) for r in read_tsv(tmp_path / "em/L60/canonicalization")] == [("full6", "0")]
    latex = "".join(p.read_text() for p in (tmp_path / "em/L60/latex").glob("part-*"))
    assert r"\begin{tabular}" in latex and "60 & 180 & " in latex


@pytest.mark.parametrize("argv", [
    ["trim", "x", "y", "--length", "2"], ["trim", "x", "y", "--five", "3"], ["trim", "x", "y", "--min-mapq", "-1"], ["cds", "x", "y", "z", "--min-mapq", "-1"], ["simulate", "x", "y", "--reads", "0"],
    ["simulate", "x", "y", "--reverse-share", "1.5"], ["simulate", "x", "y", "--bias5", "0.4"], ["em", "x", "--lengths", "60", "--trim5", "30", "--trim3", "30"], ["em", "x", "--trim5", "-1"], ["em", "x", "--cap", "5"],
    ["em", "x", "--alpha", "0"], ["em", "x", "--restarts", "0"], ["em", "x", "--canonicalize", "other"],
])
def test_parameters_outside_their_domains_are_refused(spark, argv):
    with pytest.raises(ValueError, match="--"):
        main(argv)


def test_simulate_and_conditions_commands(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(">contig1\n" + "AAGGCT" * 200 + "\n>contig2\n" + "GGTTAC" * 120 + "\n")
    main(["simulate", str(tmp_path / "ref.fa"), str(tmp_path / "sim"), "--reads", "200", "--length", "30", "--bias5", "0.7"])
    assert "".join(p.read_text() for p in (tmp_path / "sim").glob("part-*")).count(">read_") == 200
    counters = {(r["counter"], r["name"]): float(r["value"]) for r in read(tmp_path / "sim-counters")}
    assert counters["outcome", "accepted"] == 200 and counters["attempts", "all"] == sum(v for (c, _), v in counters.items() if c == "outcome")
    assert counters["valid_starts", "contig1"] == 1170 and sum(v for (c, _), v in counters.items() if c == "orientation") == 200
    manifest = json.loads("".join(p.read_text() for p in (tmp_path / "sim-manifest").glob("part-*")))
    assert list(manifest["inputs"].values()) == [hashlib.sha256((tmp_path / "ref.fa").read_bytes()).hexdigest()]
    rows = [f"g,{b},0.5,{r},{x},{v + d}" for b, v0 in ((0.5, 0.03), (0.9, 0.84)) for r, v in ((1, v0 - 0.005), (2, v0 + 0.005)) for x, d in zip("ATGC", (-0.01, 0, 0, 0.01), strict=True)]
    (tmp_path / "s.csv").write_text("genome,bias_5prime,bias_3prime,replicate,base,r2\n" + "\n".join(rows))
    main(["conditions", str(tmp_path / "s.csv"), str(tmp_path / "c")])
    got = sorted((float(r["mean_r2"]), float(r["ci95_lower"])) for r in read(tmp_path / "c/condition_summary"))
    assert abs(got[0][0] - 0.03) < 1e-12 and got[0][1] == 0 and abs(got[1][0] - 0.84) < 1e-12
    with pytest.raises(ValueError):
        (tmp_path / "s.csv").write_text("genome,bias_5prime,bias_3prime,replicate,base,r2\n" + "\n".join(rows[:-1]))
        main(["conditions", str(tmp_path / "s.csv"), str(tmp_path / "d")])


def test_arriving_reads_give_the_batch_result(spark, tmp_path):
    reads = spark.createDataFrame([(i, "ACGT" * 5 + "N" * (i % 4 == 0)) for i in range(40)], "ordinal long, seq string")
    reads.repartition(4).write.parquet(str(tmp_path / "in"))
    live = streaming.arriving(spark, str(tmp_path / "in"), "ordinal long, seq string", files_per_batch=1)
    streaming.run_to_end(streaming.length_histogram(live), "live_lengths", str(tmp_path / "c1"))
    assert [tuple(r) for r in spark.table("live_lengths").collect()] == [(20, 30)]
    streaming.run_to_end(streaming.kmer_counts(live, 2), "live_kmers", str(tmp_path / "c2"))
    assert spark.table("live_kmers").agg(F.sum("n")).first()[0] == 30 * 19
