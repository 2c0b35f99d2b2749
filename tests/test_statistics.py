import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcycle.functions.sequences import replayed_offsets, reverse_complement, uniform
from seqcycle.functions.special import chi_square_survival, t_quantile
from seqcycle.operators import counts, em, harmonic, rollup, simulate, spectrum


def cells(spark, y, start=1, base="A"):
    return spark.createDataFrame([(base, start + i, float(v)) for i, v in enumerate(y)], "base string, cycle int, x double")


def test_fit_equals_least_squares(spark):
    t = np.arange(10, 41)
    y = 0.25 + 0.025 * np.cos(2 * np.pi * t / 3) + 0.01 * np.sin(2 * np.pi * t / 3) + 0.003 * np.random.default_rng(3).normal(size=len(t))
    got = harmonic.fit(cells(spark, y, 10), ["base"], value="x").first()
    design = np.stack([np.ones_like(t, float), np.cos(2 * np.pi * t / 3), np.sin(2 * np.pi * t / 3)], axis=1)
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    r2 = 1 - np.square(y - design @ beta).sum() / np.square(y - y.mean()).sum()
    assert np.allclose([got.intercept, got.cos_coef, got.sin_coef, got.r2], [*beta, r2])
    assert math.isclose(got.amplitude, math.hypot(beta[1], beta[2])) and 0 <= got.phase_degrees < 360


def test_flat_profile_has_no_fit_and_short_windows_are_marked(spark):
    flat = spark.createDataFrame([("A", i, 60) for i in range(10, 41)], "base string, cycle int, n long")
    row = harmonic.fit(flat, ["base"]).first()
    assert row.r2 == 0.0 and row.status == "ok"
    assert harmonic.fit(cells(spark, [1 / 3] * 31, 10), ["base"], value="x").first().r2 == 0.0
    assert harmonic.fit(cells(spark, [1, 2, 3, 4, 5]), ["base"], value="x").first().status == "skipped"
    gap = spark.createDataFrame([("A", c, 1.0) for c in (1, 3, 4, 6)], "base string, cycle int, x double")
    assert harmonic.fit(gap, ["base"], value="x").first().status == "degenerate"


def test_pure_wave_has_spectral_share_one(spark):
    t = np.arange(10, 40)
    y = 0.25 + 0.02 * np.cos(2 * np.pi * t / 3)
    row = spectrum.spectral_r2(cells(spark, y, 10), ["base"]).first()
    assert math.isclose(row.r2, 1.0) and math.isclose(row.magnitude, 0.01)
    fitted = harmonic.fit(cells(spark, y, 10), ["base"], value="x").first()
    assert math.isclose(fitted.amplitude / 2, row.magnitude)
    got = {r.bin: r.magnitude for r in spectrum.spectrum(cells(spark, y, 10), ["base"]).collect()}
    assert np.allclose([got[b] for b in range(16)], np.abs(np.fft.rfft(y)) / 30)
    assert spectrum.strongest(spectrum.spectrum(cells(spark, y, 10), ["base"]), ["base"]).first().bin == 10
    with pytest.raises(ValueError):
        spectrum.require_target(31)


def test_permutations_find_a_planted_period_and_not_noise(spark):
    strong = [("A", c, 100 + 30 * (c % 3 == 0)) for c in range(10, 41)]
    noise = [("T", c, int(x)) for c, x in zip(range(10, 41), np.random.default_rng(5).integers(90, 110, 31), strict=True)]
    rows = spark.createDataFrame(strong + noise, "base string, cycle int, n long")
    for table in (harmonic.permutation_p(rows, ["base"], 99), harmonic.permutation_p_replayed(rows, ["base"], 99)):
        p = {r.base: r.p_value for r in table.collect()}
        assert p["A"] == 0.01 and p["T"] > 0.05


def test_holm_steps_down(spark):
    p = {"A": 0.01, "T": 0.04, "G": 0.03, "C": 0.5}
    rows = spark.createDataFrame([(1, b, v) for b, v in p.items()], "length int, base string, p_value double")
    got = {r.base: r for r in harmonic.holm(rows, ["length"]).collect()}
    assert np.allclose([got[b].p_value_adjusted for b in "ATGC"], [0.04, 0.09, 0.09, 0.5])
    assert got["A"].significant and not got["T"].significant and not got["A"].all_significant


def test_distribution_functions(spark):
    assert math.isclose(t_quantile(1), 12.706204736, rel_tol=1e-9)
    assert math.isclose(t_quantile(2), 4.302652730, rel_tol=1e-8) and math.isclose(t_quantile(10), 2.228138852, rel_tol=1e-8) and math.isclose(t_quantile(30), 2.042272456, rel_tol=1e-8)
    x = spark.createDataFrame([(3.841458821, 5.991464547, 11.0704976935)], "a double, b double, c double")
    row = x.select(chi_square_survival(F.col("a"), 1), chi_square_survival(F.col("b"), 2), chi_square_survival(F.col("c"), 5)).first()
    assert np.allclose(list(row), 0.05, atol=1e-8)


def test_conditions_have_intervals_within_bounds(spark):
    rows = [("g", 0.5, 0.5, r, b, v + d) for r, v in ((1, 0.025), (2, 0.035)) for b, d in zip("ATGC", (-0.015, -0.005, 0.005, 0.015), strict=True)]
    got = rollup.condition_summary(rollup.replicate_means(spark.createDataFrame(rows, "genome string, bias_5prime double, bias_3prime double, replicate int, base string, r2 double"))).first()
    assert math.isclose(got.mean_r2, 0.03) and got.ci95_lower == 0.0 and math.isclose(got.ci95_upper, 0.09353102368, rel_tol=1e-8)
    one = rollup.condition_summary(spark.createDataFrame([("g", 0.5, 0.5, 1, 0.4)], "genome string, bias_5prime double, bias_3prime double, replicate int, mean_r2_across_bases double")).first()
    assert one.sd_between_replicates == 0 and one.ci95_lower == one.ci95_upper == 0.4


def mixture(n=600, length=60, seed=123):
    draw = np.random.default_rng(seed)
    p = np.array([[0.55, 0.15, 0.15, 0.15], [0.1, 0.5, 0.2, 0.2], [0.15, 0.1, 0.6, 0.15]])
    out = []
    for i in range(n):
        offset = int(draw.integers(3))
        s = "".join("ACGT"[draw.choice(4, p=p[(k + offset) % 3])] for k in range(length))
        out.append((f"r{i}", i, s if draw.random() < 0.5 else s[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return out


def plain_scores(seq, p):
    log = np.log(p)
    turned = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return [sum(log[(i + o) % 3, "ACGT".index(c)] for i, c in enumerate(s)) for s in (seq, turned) for o in range(3)]


def test_scores_and_loop(spark):
    reads = spark.createDataFrame(mixture(), "read_id string, ordinal long, seq string")
    rows = em.profiles(reads, 60).cache()
    p = np.array([[0.4, 0.2, 0.1, 0.3], [0.1, 0.3, 0.4, 0.2], [0.25, 0.15, 0.35, 0.25]])
    for r in em.e_step(rows, p, 60).limit(5).collect():
        letters = {(q, b): r[f"c{4 * q + b}"] for q in range(3) for b in range(4)}
        seq = "".join("ACGT"[b] for k in range(20) for q in range(3) for b in [next(b for b in range(4) if sum(letters[q, x] for x in range(b + 1)) > k)])
        want = plain_scores(seq, p)
        assert np.allclose([r[f"s{i}"] for i in range(6)], want) and r.state == int(np.argmax(np.round(want, 9)))
    fit = em.fit(rows, 60, restarts=3, seed=7)
    assert fit.stable and all(b >= a - 1e-6 * (1 + abs(a)) for a, b in zip(fit.trace, fit.trace[1:], strict=False))
    assigned = em.e_step(rows, fit.p, 60)
    t = em.totals(assigned, ["length"], 60).first()
    assert np.allclose(em.m_step(np.array([t[f"t{i}"] for i in range(12)], float)), fit.p) and t.n == 600
    found = em.canonical(fit.p, 60)
    assert sorted(found.states) == list(range(6))
    again = em.e_step(rows, found.p, 60).withColumn("old", em.first_largest(em.scores(fit.p, 60)))
    assert again.where(F.col("state") != em.renumbered(F.col("old"), found.states)).count() == 0
    assert em.canonical(em.rotate(fit.p, 1), 60).p.round(12).tolist() == found.p.round(12).tolist()
    assert em.canonical(em.flip(fit.p, 60), 60).p.round(12).tolist() == found.p.round(12).tolist()
    with pytest.raises(ValueError):
        em.fit(rows.where("weight < 0"), 60)


def test_known_mixture_of_three_pure_offsets(spark):
    motifs = ("ATG", "TGA", "GAT")
    reads = spark.createDataFrame([(f"r{i}", i, motifs[i % 3] * 20) for i in range(180)], "read_id string, ordinal long, seq string")
    rows = em.profiles(reads, 60).cache()
    fit = em.fit(rows, 60, seed=1 + 60 * 10007)
    found = em.canonical(fit.p, 60)
    named = em.gaps(em.e_step(rows, fit.p, 60)).withColumn("state", em.renumbered(F.col("state"), found.states))
    got = em.state_distribution(named, ["length"]).first()
    assert [got[f"count_{s}"] for s in em.STATES] == [60, 60, 60, 0, 0, 0]
    assert math.isclose(got.chisq_6states, 180) and got.chisq_3shifts == 0 and got.p_3shifts == 1 and math.isclose(got.chisq_orientation, 180)
    assert math.isclose(fit.ll, -4.498438107382802, rel_tol=1e-9) and len(fit.trace) == 2 and not found.flipped
    assert np.allclose(found.p.max(axis=1), 0.9995835646862854)


def test_deduplication_keys(spark):
    reads = spark.createDataFrame([("a", 2, "ACGG"), ("b", 1, "CCGT"), ("c", 3, "ACGG"), ("d", 4, "NNNN")], "read_id string, ordinal long, seq string")
    n = {m: counts.collapse(reads, m).count() for m in ("sequence", "seq_rc", "hash64", "hash64_rc")}
    assert n == {"sequence": 3, "seq_rc": 2, "hash64": 3, "hash64_rc": 2}
    assert counts.collapse(reads, "seq_rc").where("copies = 3").first().read_id == "b"
    assert reads.select(reverse_complement(F.lit("ACGTNacgtn")).alias("x")).first().x == "nacgtNACGT"


def test_sample_does_not_depend_on_partitions(spark):
    contigs = spark.createDataFrame([("one", 0, "AAGGCT" * 100), ("two", 1, "GGTTAC" * 40), ("short", 2, "ACG")], "name string, ordinal long, seq string")
    rows = simulate.sample(spark, contigs, 500, 30, 0.7, 0.5).collect()
    assert len(rows) == 500 and all(len(r.fragment) == 30 for r in rows)
    seqs = {"one": "AAGGCT" * 100, "two": "GGTTAC" * 40}
    comp = str.maketrans("ACGT", "TGCA")
    for r in rows:
        piece = seqs[r.name][r.start : r.end]
        assert r.fragment == (piece[::-1].translate(comp) if r.reverse else piece)
        assert r.outside == (seqs[r.name][r.end].translate(comp) if r.reverse else seqs[r.name][r.start - 1])
    with pytest.raises(ValueError):
        simulate.candidates(spark, contigs.where("name = 'short'"), 10, 30)
    assert 0 <= spark.range(1).select(uniform(F.lit("x")).alias("u")).first().u < 1


def test_sequential_replays():
    offsets = replayed_offsets(180, 9)
    assert [offsets.count(k) for k in range(3)] == [71, 50, 59]
    rows, attempts = simulate.replayed([("contig1", "AAGGCT" * 200), ("contig2", "GGTTAC" * 120)], 200, 30, 0.7, 0.5, seed=22)
    assert attempts == 268 and sum(r[0] == "contig1" for r in rows) == 119 and sum(r[3] for r in rows) in (95, 105)


def test_turned_fits_tie_exactly():
    """Sums of many reads' scores differ in their last digits by how the reads are dealt; totals are whole numbers."""
    draw = np.random.default_rng(5)
    for _ in range(200):
        t = draw.integers(1, 10**8, (3, 4))
        p = em.m_step(t)
        for k in range(3):
            turned = em.rotate(t, k), em.rotate(p, k)
            assert em.score(*turned) == em.score(t, p) and (em.m_step(turned[0]) == turned[1]).all()
            assert em.score(em.flip(turned[0], 60), em.flip(turned[1], 60)) == em.score(t, p)
    fits = [em.Fit(seed, p, trace=[ll]) for seed, ll in ((1, -5e6), (2, -4169181.274104658), (3, -4169181.2741046576))]
    assert em.first_best(fits).seed == 2
