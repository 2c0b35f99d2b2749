"""The run over one library: input order over files, one scan, counters, tables that a further run completes; the latent-state fit over a table of restarts."""

import json
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcycle.functions.special import erfc
from seqcycle.operators import cds, counts, em, quantiles
from seqcycle.plans import composition
from seqcycle.sources import sequences, shared, sinks, streams
from tests.test_statistics import mixture


def fastq(path, names, seq="ACGTACGT"):
    path.write_text("".join(f"@{n}\n{seq}\n+\n{'I' * len(seq)}\n" for n in names))
    return str(path)


@pytest.mark.parametrize("few", [0, counts.FEW])
def test_caps_follow_the_order_of_the_input(spark, tmp_path, few):
    one, two = fastq(tmp_path / "z_R1.fastq", [f"a{i}" for i in range(9)]), fastq(tmp_path / "a_R2.fastq", [f"b{i}" for i in range(9)])
    first = lambda df, n: [r.read_id for r in counts.first_rows(df, n, few=few, buckets=3).orderBy(*counts.input_order(df)).collect()]
    both = sequences.paired(spark, one, two, "both")
    assert first(both, 4) == ["a0", "a1", "a2", "a3"] and first(both, 11) == [*(f"a{i}" for i in range(9)), "b0", "b1"] and len(first(both, 99)) == 18
    assert first(sequences.fastq(spark, [two, one], split_bytes=40), 10) == [*(f"b{i}" for i in range(9)), "a0"]
    for name, start in (("z.fa", 0), ("y.fa", 100)):
        (tmp_path / name).write_text("".join(f">s{start + i}\nACGT\n" for i in range(6)))
    files = [str(tmp_path / "z.fa"), str(tmp_path / "y.fa")]
    assert first(sequences.fasta(spark, files), 8) == [*(f"s{i}" for i in range(6)), "s100", "s101"]
    assert first(sequences.fasta(spark, files[::-1]), 7) == [*(f"s{100 + i}" for i in range(6)), "s0"]
    sam = "".join(f"m{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*\n" for i in range(4))
    (tmp_path / "k.sam").write_text(sam)
    (tmp_path / "b.sam").write_text(sam.replace("m", "n"))
    assert first(sequences.sam(spark, [str(tmp_path / "k.sam"), str(tmp_path / "b.sam")]), 5) == ["m0", "m1", "m2", "m3", "n0"]


def test_splits_of_one_file_keep_its_order(spark, tmp_path):
    (tmp_path / "long.fa").write_text("".join(f">s{i:05d}\n{'ACGT' * 30}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        reads = sequences.fasta(spark, str(tmp_path / "long.fa"))
        assert reads.select("span").distinct().count() > 5
        for few in (0, counts.FEW):
            assert sorted(r.read_id for r in counts.first_rows(reads, 2500, few=few).collect()) == [f"s{i:05d}" for i in range(2500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_collapse_keeps_the_first_of_all_files(spark, tmp_path):
    one, two = fastq(tmp_path / "z.fastq", ["late"]), fastq(tmp_path / "a.fastq", ["x", "y"])
    assert [(r.read_id, r.copies) for r in counts.collapse(sequences.fastq(spark, [one, two])).collect()] == [("late", 3)]


def plain(reads, k):
    return Counter((len(s), i + 1, s[i : i + k]) for s in reads if s and set(s) <= set("ACGT") for i in range(len(s) - k + 1))


def test_all_tables_come_from_one_scan(spark, tmp_path):
    draw = random.Random(4)
    reads = ["".join(draw.choice("ACGT") for _ in range(draw.randrange(1, 9))) for _ in range(300)] + ["ACGN", "", None, "N"] + ["ACGT"] * 5
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(reads)], "ordinal long, seq string")
    cells = composition.counted(rows, 3)
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    for k in (1, 2, 3):
        assert {(r.length, r.cycle, r.kmer): r.n for r in counts.kmers_in(cells, k).collect()} == plain(reads, k)
    assert counts.qc_in(cells).first().asDict() == {"n_total": 309, "n_valid": 305, "n_invalid": 4, "n_duplicates": 0, "n_analyzed": 305}
    unique = composition.counted(rows, 1, collapse_exact=True)
    assert counts.qc_in(unique).first().asDict() == {"n_total": 309, "n_valid": 305, "n_invalid": 4, "n_duplicates": 305 - len(set(reads[:300]) | {"ACGT"}), "n_analyzed": len(set(reads[:300]) | {"ACGT"})}
    assert {(r.length, r.cycle, r.kmer): r.n for r in counts.kmers_in(unique, 1).collect()} == plain(set(reads), 1)
    plan = composition.planned(spark, composition.Settings("x", k=(1, 2, 3), min_read_count=5, permutations=5), rows)
    for table in (*plan.tables.values(), plan.fits, plan.observed, plan.analyzed, plan.counters()):
        text = table._jdf.queryExecution().optimizedPlan().toString()
        assert "seq#" not in text, text  # nothing but the cells is read again


def library(path, lengths):
    path.write_text("".join(f">r{i}\n{'ACG' * 7}{'A' * n}\n" for n in lengths for i in range(3)) + ">bad\nACGN\n>copy\n" + "ACG" * 7 + "\n")
    return str(path)


def test_manifest_counts_what_was_scanned(spark, tmp_path):
    settings = composition.Settings(library(tmp_path / "lib.fa", (0, 1)), str(tmp_path / "out"), min_read_count=1, collapse_exact=True, test=False)
    composition.run(spark, settings)
    facts = json.loads("".join(p.read_text() for p in (tmp_path / "out/lib/manifest").glob("part-*")))
    assert facts["reads"] == {"n_total": 8, "n_valid": 7, "n_invalid": 1, "n_duplicates": 5, "n_analyzed": 2, "n_lengths": 2, "n_taken": 2}


def lengths_of(folder):
    return sorted(int(p.name.partition("=")[2]) for p in Path(folder).glob("length=*"))


def test_a_further_run_adds_the_lengths_that_are_missing(spark, tmp_path):
    source, out = library(tmp_path / "lib.fa", (0, 1, 2)), tmp_path / "out"
    run = lambda *lengths, **more: composition.run(spark, composition.Settings(source, str(out), lengths=lengths, permutations=9, **({"skip_existing": True} | more)))
    table, fits = out / "lib/csv/kmer/k1", out / "lib/stats/period3"
    run(21, 22)
    stamp = {p: p.stat().st_mtime_ns for p in table.rglob("part-*")}
    run(21, 22, 23)
    assert lengths_of(table) == lengths_of(out / "lib/charts/k1_profile") == [21, 22, 23] and all(p.stat().st_mtime_ns == t for p, t in stamp.items())
    assert sorted(json.loads(line)["length"] for p in fits.glob("part-*") for line in p.read_text().splitlines()) == [21, 22, 23]
    run(21, 22, 23, k=(1, 2))
    assert lengths_of(out / "lib/csv/kmer/k2") == [21, 22, 23] and len(list(fits.glob("part-*"))) == len({p.name for p in fits.glob("part-*")})
    whole = {(r["length"], r["cycle"]): (r["A"], r["C"]) for r in spark.read.csv(str(table), header=True).collect()}
    # a run that was cut off: one length half written and not noted as done
    done = spark.read.parquet(str(out / "lib/written")).where("length <> 22 OR path NOT LIKE '%csv/kmer/k1'").collect()
    spark.createDataFrame(done, "path string, length int").write.mode("overwrite").parquet(str(out / "lib/written"))
    part = next((table / "length=22").glob("part-*"))
    part.write_text("\n".join(part.read_text().splitlines()[:5]) + "\n")
    run(21, 22, 23)
    assert {(r["length"], r["cycle"]): (r["A"], r["C"]) for r in spark.read.csv(str(table), header=True).collect()} == whole
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        run(21, skip_existing=False)


def test_error_function(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 1.999999, 2.0, 2.000001, 2.5, 3.0, 5.0, 10.0, 20.0, 26.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x"))).collect()]
    assert all(math.isclose(a, math.erfc(x), rel_tol=1e-12) for a, x in zip(got, xs, strict=True))


def plain_fit(table, effective, seed, alpha=em.ALPHA):
    """The loop of one restart over (counts, weight) rows, the slow way."""
    c, w = np.array([r[:12] for r in table], float), np.array([r[12] for r in table], float)
    maps = [[4 * ((r + o) % 3) + b if s > 0 else None for r in range(3) for b in range(4)] for s in (1,) for o in range(3)]
    turned = [4 * ((effective - 1 - r) % 3) + 3 - b for r in range(3) for b in range(4)]
    p = em.initial(sum((c[:, 4 * r : 4 * r + 4] * w[:, None]).sum(axis=0) for r in range(3)), seed)
    before = None
    for step in range(1, 100):
        log = np.log(p).ravel()
        views = [c, c[:, turned]]
        scores = np.stack([sum(v[:, j] * log[m[j]] for j in range(12)) for v in views for m in maps], axis=1)
        state = scores.argmax(axis=1)
        if before is not None and (state == before).all():
            return p, float((scores.max(axis=1) * w).sum()), step
        t = np.zeros(12)
        for k in range(6):
            for j in range(12):
                t[maps[k % 3][j]] += (views[k // 3][:, j] * w)[state == k].sum()
        before, p = state, em.m_step(t, alpha)
    raise AssertionError("not stable")


def test_all_lengths_and_restarts_advance_on_one_table(spark):
    rows = [(f"r{n}-{i}", i, s[:n]) for n in (58, 59, 60, 61) for _, i, s in mixture(150, 61, n)]
    effective = {n: n - 1 for n in (58, 59, 60, 61)}
    profiles = shared.written(em.profiles(spark.createDataFrame(rows, "read_id string, ordinal long, seq string"), list(effective), trim3=1), "profiles")
    seeds = {n: 100 * n for n in effective}
    fits = em.fit_all(profiles, effective, restarts=4, seeds=seeds)
    for n, fit in fits.items():
        table = [tuple(r[1:]) for r in profiles.where(F.col("length") == n).collect()]
        each = [(plain_fit(table, effective[n], seeds[n] + k), seeds[n] + k) for k in range(4)]
        best = max(x[0][1] for x in each)
        (p, ll, steps), seed = next(x for x in each if x[0][1] >= best - 1e-9)
        assert fit.seed == seed and np.allclose(fit.p, p, atol=1e-12) and math.isclose(fit.ll, ll, rel_tol=1e-12) and len(fit.trace) == steps
    moving = [(n, effective[n], em.Fit(k, fit.p)) for n, fit in fits.items() for k in range(10)]
    assert em.stepper(profiles)(moving)._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_overlaps_equal_brute_force_for_features_of_any_size(spark):
    draw = random.Random(1)
    aligned = [(i, f"c{draw.randrange(2)}", (x := draw.randrange(0, 3_000_000)), x + draw.randrange(1, 400)) for i in range(200)]
    feature = [(f"c{draw.randrange(2)}", (x := draw.randrange(0, 3_000_000)), x + draw.choice([1, 100, 4096, 4097, 40_000, 900_000, 10_000_000]), "+", 0, f"f{i}") for i in range(150)]
    features = spark.createDataFrame(feature, "contig string, start long, end long, strand string, phase int, identifier string")
    rows = spark.createDataFrame(aligned, "read_id long, contig string, ref_start long, ref_end long")
    got = sorted((r.read_id, r.cds_identifier) for r in cds.overlaps(rows, features).collect())
    assert got == sorted((a[0], f[5]) for a in aligned for f in feature if a[1] == f[0] and a[2] < f[2] and a[3] > f[1])
    assert cds.overlaps(rows, features.limit(0)).count() == 0
    wide = cds.binned(features.where("end - start = 10000000"), "start", "end", cds.feature_level(F.col("end") - F.col("start")))
    assert wide.groupBy("identifier").count().agg(F.max("count")).first()[0] <= 2


def test_plain_paths_are_of_the_default_file_system(spark, tmp_path):
    """Under a default file system other than the local one, a path without scheme means that one, for Spark's readers and for those of this library."""
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.other.link./data", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://other")
    try:
        assert shared.qualified(spark, "/data/x.fastq") == "viewfs://other/data/x.fastq" and shared.qualified(spark, f"file://{tmp_path}/x") == f"file:{tmp_path}/x"
        assert shared.qualified(spark, "file:/tmp/") == "file:/tmp"
    finally:
        conf.set("fs.defaultFS", before or "file:///")
    assert streams.located(shared.qualified(spark, str(tmp_path)))[1] == str(tmp_path)
    assert list(sinks.digest_all(spark, [fastq(tmp_path / "x.fastq", ["a"])])) == [str(tmp_path / "x.fastq")]


def weighted_quantile(pairs, q):
    values = sorted(x for x, w in pairs for _ in range(w))
    place = (len(values) - 1) * q
    low = values[math.floor(place)]
    return low + (place - math.floor(place)) * (values[math.ceil(place)] - low)


def test_quantiles_are_exact_by_narrowing_ranges(spark):
    draw = random.Random(3)
    groups = {
        "wide": [(draw.choice([1e-9, 1.0, 1e12, -1e6]) * draw.random(), draw.randrange(1, 5)) for _ in range(400)], "one": [(7.5, 3)], "tied": [(0.25, 900), (0.5, 1), (1e9, 2)], "close": [(1 + k * 2**-52, 1) for k in range(9)],
        "huge": [(-1e308, 1), (0.0, 2), (1e308, 1)],
    }
    rows = spark.createDataFrame([(g, x, w) for g, v in groups.items() for x, w in v] + [("wide", None, 5), ("none", None, 1), ("wide", 3.0, 0)], "g string, x double, w int").repartition(6)
    shares = {"median": 0.5, "q05": 0.05, "q25": 0.25, "q95": 0.95, "least": 0.0, "most": 1.0}
    for few in (0, quantiles.FEW):
        got = {r.g: r for r in quantiles.exact(rows, ["g"], "x", shares, F.col("w"), few=few).collect()}
        assert set(got) == set(groups)
        for g, pairs in groups.items():
            if g != "huge" or few == 0:
                assert all(math.isclose(got[g][name], weighted_quantile(pairs, q), rel_tol=1e-12, abs_tol=1e-300) for name, q in shares.items()), (g, got[g])
