"""Queries over the latent-state model, alignments and features, simulated fragments, and collections of libraries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.sequences import STATE_BASES, codon_corrected, is_simple_cigar, kmer_tokens, mod3_counts, pyrimidine_acceptance, safe_name
from ..operators import cds, charts, em, quantiles, rollup, simulate, validate
from ..sources.shared import written
from . import demo

#: Parameters under which single steps are shown.
P = np.array([[0.4, 0.2, 0.1, 0.3], [0.1, 0.3, 0.4, 0.2], [0.25, 0.15, 0.35, 0.25]])
LENGTH, SAMPLE, READ, STEPS, RESTARTS = 60, 2000, 20, 4, 3
FIRST = em.SEED + LENGTH * 10007


def _rows(spark, sf_dir):
    dealt = 2 * spark.sparkContext.defaultParallelism  # files, so that a step over few megabytes still runs on all cores
    return written(em.profiles(demo.reads(spark, sf_dir), LENGTH).repartition(dealt), "profiles")


def _steps(spark, sf_dir):
    rows = em.profiles(demo.reads(spark, sf_dir), LENGTH)
    return written(em.gaps(em.e_step(rows, P, LENGTH)), "steps")  # else every statistic would contain all scores


def mod3(spark, sf_dir):
    rows = demo.reads(spark, sf_dir)
    counts = mod3_counts(F.col("seq"))
    return rows.select("read_id", *[F.get(counts, F.lit(4 * r + i)).alias(f"n{r}{b}") for r in range(3) for i, b in enumerate(STATE_BASES)])


def em_scores(spark, sf_dir):
    """Scores and state of each distinct profile."""
    rows = em.e_step(_rows(spark, sf_dir), P, LENGTH)
    return rows.select(*[f"c{i}" for i in range(12)], "weight", *[F.round(f"s{i}", 6).alias(f"s{i}") for i in range(6)], F.col("state").cast("long").alias("state"))


def em_e_step(spark, sf_dir):
    rows = _steps(spark, sf_dir)
    return rows.groupBy("length", "state").agg(F.sum("weight").alias("n"), F.round(F.sum(F.col("ll") * F.col("weight")), 5).alias("ll")).select(F.col("length").cast("long").alias("length"), F.col("state").cast("long").alias("state"), "n", "ll")


def em_m_step(spark, sf_dir):
    t = em.totals(_steps(spark, sf_dir), ["length"], LENGTH)
    out = []
    for q in range(3):
        whole = sum(F.col(f"t{4 * q + i}") + em.ALPHA for i in range(4))
        out += [F.round((F.col(f"t{4 * q + i}") + em.ALPHA) / whole, 9).alias(f"p{q}{b}") for i, b in enumerate(STATE_BASES)]
    return t.select(F.col("length").cast("long").alias("length"), *out)


def em_gap_summary(spark, sf_dir):
    rows = em.gap_summary(_steps(spark, sf_dir), ["length"])
    return rows.select(F.col("length").cast("long").alias("length"), "n_reads", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


def em_gap_by_state(spark, sf_dir):
    rows = em.by_state(_steps(spark, sf_dir))
    numbers = [c for c in rows.columns if c.startswith("gap_")]
    return rows.select(F.col("length").cast("long").alias("length"), "assigned_state", "n_reads", *[F.round(c, 6).alias(c) for c in numbers])


def em_gap_quantiles(spark, sf_dir):
    """Quantiles of the gaps of each state, by narrowing ranges of values."""
    rows = quantiles.exact(_steps(spark, sf_dir), ["state"], "gap_ll", {"median": 0.5, "q05": 0.05, "q95": 0.95}, F.col("weight"), few=0)
    return rows.select(F.col("state").cast("long").alias("state"), *[F.round(c, 6).alias(c) for c in ("median", "q05", "q95")])


def em_runnerup(spark, sf_dir):
    rows = em.runner_up(_steps(spark, sf_dir))
    return rows.select(F.col("length").cast("long").alias("length"), "assigned_state", "runnerup_state", "count", F.round("prop_within_assigned", 9).alias("prop_within_assigned"))


def chi_square_uniform(spark, sf_dir):
    """The shift test, whose distribution function SQL has."""
    rows = em.state_distribution(_steps(spark, sf_dir), ["length"])
    return rows.select(F.col("length").cast("long").alias("length"), "n_sequences", *[F.round(c, 6).alias(c) for c in ("chisq_6states", "chisq_3shifts", "chisq_orientation", "p_3shifts")])


def _fit(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    fit = em.fit(rows, LENGTH, restarts=RESTARTS, seed=FIRST)
    return rows, fit, em.canonical(fit.p, LENGTH)


def em_charts(spark, sf_dir):
    """Shares of states, shifts and orientations under the given parameters, as the charts show them."""
    tables = charts.em(em.state_distribution(_steps(spark, sf_dir), ["length"]))
    parts = [t.select(F.lit(name).alias("chart"), F.col("length").cast("long").alias("length"), F.col(t.columns[1]).alias("mark"), F.round("share", 9).alias("share")) for name, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def em_iterations(spark, sf_dir):
    """A few whole steps of the fit from given parameters: the score of each and the parameters that it leads to."""
    steps = em.iterated(_rows(spark, sf_dir), LENGTH, P, STEPS)
    rows = [(i + 1, round(ll, 6), q, b, round(float(p[q, j]), 9)) for i, (ll, p) in enumerate(steps) for q in range(3) for j, b in enumerate(STATE_BASES)]
    return spark.createDataFrame(rows, "step long, ll double, position_class long, base string, prob double")


def em_fit(spark, sf_dir):
    _, fit, found = _fit(spark, sf_dir)
    names = "length long, effective_length long, position_class long, base string, prob double, canonicalization_mode string, canonical_rotation long, canonical_rc_flip boolean"
    return spark.createDataFrame(em.base_table(LENGTH, LENGTH, found), names).withColumn("prob", F.round("prob", 9))


def em_state_distribution(spark, sf_dir):
    rows, fit, found = _fit(spark, sf_dir)
    assigned = em.gaps(em.e_step(rows, fit.p, LENGTH))
    named = assigned.withColumn("state", em.renumbered(F.col("state"), found.states))
    out = em.state_distribution(named, ["length"])
    numbers = [F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in out.dtypes]
    facts = {"seed_used": fit.seed, "n_em_e_steps": len(fit.trace), "canonical_rotation": found.rotation}
    return out.select(*numbers, F.lit(round(fit.ll, 5)).alias("best_ll"), *[F.lit(v).cast("long").alias(k) for k, v in facts.items()], F.lit(found.flipped).alias("canonical_rc_flip"))


def _classified(spark, sf_dir):
    return cds.classified(demo.alignments(spark, sf_dir), demo.features(spark, sf_dir))


def cds_containment(spark, sf_dir):
    rows = _classified(spark, sf_dir).where("reason = 'written'")
    return rows.select("read_id", "contig", "ref_start", "ref_end", "cds_identifier", "cds_strand")


def cds_exclusion_funnel(spark, sf_dir):
    return cds.funnel(_classified(spark, sf_dir))


def codon_phase(spark, sf_dir):
    rows = _classified(spark, sf_dir).where("reason = 'written'")
    return rows.select("read_id", *[F.col(c).cast("long").alias(c) for c in ("phase", "trim5", "trim3")], "corrected", cds.fasta_header(rows).alias("header"))


def cds_overlap_pairs(spark, sf_dir):
    rows = cds.overlaps(demo.alignments(spark, sf_dir), demo.features(spark, sf_dir))
    return rows.groupBy("contig").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("read_id").alias("n_reads"), F.countDistinct("cds_identifier").alias("n_features"))


def _fragments(spark, sf_dir):
    return simulate.judged(simulate.candidates(spark, demo.contigs(spark, sf_dir), SAMPLE, READ), 0.7, 0.6)


def simulate_candidates(spark, sf_dir):
    return _fragments(spark, sf_dir).select("id", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "reverse", "fragment", "outside", "inside")


def simulate_accept(spark, sf_dir):
    return _fragments(spark, sf_dir).select("id", "outcome")


def boundary_counts(spark, sf_dir):
    return simulate.boundary_counts(_fragments(spark, sf_dir))


def simulate_counters(spark, sf_dir):
    return simulate.counters(_fragments(spark, sf_dir), demo.contigs(spark, sf_dir), READ)


def simulate_sample(spark, sf_dir):
    rows = simulate.sample(spark, demo.contigs(spark, sf_dir), 500, READ, 0.7, 0.6)
    return rows.select("id", "name", "fragment")


def _libraries(spark, sf_dir):
    rows = demo.lengths(spark, sf_dir)
    return rows.withColumn("category", rollup.category(F.col("sample")))


def library_all_lengths(spark, sf_dir):
    rows = _libraries(spark, sf_dir)
    return rows.select("sample", "category", F.col("read_length").cast("long").alias("read_length"), "read_count", "observed_read_count", *[F.round(c, 9).alias(c) for c in ("mean_r2", "min_base_r2", "max_base_r2")])


def best_length_per_library(spark, sf_dir):
    rows = rollup.library_summary(_libraries(spark, sf_dir))
    whole = ["best_length", "best_length_read_count", "best_length_observed_read_count", "n_eligible_lengths", "min_eligible_length", "max_eligible_length"]
    numbers = ["max_r2", "best_length_min_base_r2", "best_length_max_base_r2", "median_mean_r2", "mean_mean_r2_across_lengths"]
    return rows.select("sample", "category", *[F.col(c).cast("long").alias(c) for c in whole], *[F.round(c, 9).alias(c) for c in numbers])


def duplicate_guard(spark, sf_dir):
    """Samples and lengths that several orders share, which a table of results must not have."""
    o = demo.table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40 + 30).alias("read_length"))
    return validate.duplicates(o, ["o_custkey", "read_length"])


def incomplete_groups(spark, sf_dir):
    rows = demo.simulations(spark, sf_dir).where("not (base = 'C' and replicate = 1)")
    return validate.incomplete_groups(rows, ["genome", "bias_5prime", "replicate"], "base", ["A", "T", "G", "C"]).withColumn("replicate", F.col("replicate").cast("long"))


def _joined(spark, sf_dir):
    return rollup.joined_metadata(rollup.library_summary(_libraries(spark, sf_dir)), demo.metadata(spark, sf_dir), internal_project="in-house", check=False)


def metadata_join(spark, sf_dir):
    return _joined(spark, sf_dir).select("sample", "category", F.round("max_r2", 9).alias("max_r2"), "library_name", "archive_data_accession", "project_name", "material", "region", "_metadata_merge")


def unmatched_libraries(spark, sf_dir):
    return rollup.unmatched(_joined(spark, sf_dir))


def category_cleanup(spark, sf_dir):
    return rollup.cleaned_categories(_joined(spark, sf_dir), "region", 40).select("sample", F.col("region").alias("label"), rollup.normalized_label(F.col("material")).alias("material"))


def category_order(spark, sf_dir):
    rows = rollup.category_order(rollup.cleaned_categories(_joined(spark, sf_dir), "material"), "material")
    return rows.select("material", "n", F.round("median", 9).alias("median"), F.col("place").cast("long").alias("place"))


def simulation_replicates(spark, sf_dir):
    rows = rollup.replicate_means(demo.simulations(spark, sf_dir))
    return rows.select("genome", "bias_5prime", "bias_3prime", F.col("replicate").cast("long").alias("replicate"), *[F.round(c, 9).alias(c) for c in ("mean_r2_across_bases", "sd_r2_across_bases")])


def simulation_conditions(spark, sf_dir):
    rows = rollup.condition_summary(rollup.replicate_means(demo.simulations(spark, sf_dir)))
    numbers = ["mean_r2", "sd_between_replicates", "sem_between_replicates", "ci95_lower", "ci95_upper"]
    return rows.select("genome", "bias_5prime", "bias_3prime", "n_replicates", *[F.round(c, 8).alias(c) for c in numbers])


def _result_files(spark, sf_dir):
    """A result file for each of the orders, some without a length, a base, or fits, some skipped."""
    o = demo.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.floor("o_totalprice") % 90).alias("v"))
    k = F.col("o_orderkey")
    fit = lambda b, i: F.format_string('{"base":"%s","r2":0.%02d}', F.lit(b), F.col("v") + i)
    bases = F.when(k % 13 == 0, F.concat_ws(",", fit("A", 0), fit("T", 1), fit("G", 2))).otherwise(F.concat_ws(",", fit("A", 0), fit("T", 1), fit("G", 2), fit("c", 3)))
    length = F.when(k % 5 != 0, F.concat(F.lit('"read_length":'), k % 40 + 30, F.lit(","))).otherwise("")
    status = F.when(k % 19 == 0, '"status":"skipped",').otherwise("")
    text = F.concat(F.lit("{"), status, length, F.lit('"read_count":'), k % 1000, F.lit(',"fits":['), bases, F.lit("]}"))
    path = F.concat(F.lit("/results/"), F.when(F.col("o_custkey") % 2 == 0, "ERR").otherwise("LIB"), "o_custkey", F.lit("/stats/period3/kmer/L"), k % 40 + 30, F.lit("/"), k, F.lit(".json"))
    return o.select(path.alias("path"), text.alias("content"))


def json_results(spark, sf_dir):
    good, bad = rollup.parsed_results(_result_files(spark, sf_dir))
    rows = good.select("source_json", "sample", "category", F.col("read_length").cast("long").alias("read_length"), "read_count", F.round("mean_r2", 9).alias("mean_r2"), "min_base_r2", "max_base_r2", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(bad.select(F.col("path").alias("source_json"), "error"), allowMissingColumns=True)


def event_props(spark, sf_dir):
    """JSON values of the events, averaged by type."""
    e = demo.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.round(F.avg("p.k"), 9).alias("mean_k"))


def scalar_functions(spark, sf_dir):
    """Name cleaning, acceptance probabilities, alignment predicates and codon trims, row by row."""
    p = demo.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    cigar = F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit("M2=1X"))).otherwise(F.concat("p_size", F.lit("M1D3M")))
    corrected, five, three = codon_corrected(F.substring(F.lit("ACGTACGTACGT"), 1, 11), (F.col("p_size") % 3))
    return p.select(
        "p_partkey", safe_name(F.col("p_name")).alias("safe"), F.round(pyrimidine_acceptance(0.5 + F.col("p_size") / 100.0), 9).alias("acceptance"), is_simple_cigar(cigar).alias("simple"),
        corrected.alias("codons"), five.cast("long").alias("trim5"), three.cast("long").alias("trim3"),
    )


def kmer_token_table(spark, sf_dir):
    return spark.createDataFrame([(k, i, t) for k in (1, 2, 3) for i, t in enumerate(kmer_tokens(k))], "k long, code long, token string")


QUERIES = {
    "scalar_functions": scalar_functions, "kmer_tokens": kmer_token_table, "mod3_counts": mod3, "em_scores": em_scores, "em_e_step": em_e_step, "em_m_step": em_m_step, "em_gap_summary": em_gap_summary, "em_gap_by_state": em_gap_by_state, "em_runnerup": em_runnerup,
    "em_gap_quantiles": em_gap_quantiles, "chi_square_uniform": chi_square_uniform, "em_charts": em_charts, "em_iterations": em_iterations, "em_fit": em_fit, "em_state_distribution": em_state_distribution, "cds_containment": cds_containment, "cds_exclusion_funnel": cds_exclusion_funnel,
    "codon_phase": codon_phase, "cds_overlap_pairs": cds_overlap_pairs, "simulate_candidates": simulate_candidates, "simulate_accept": simulate_accept, "boundary_counts": boundary_counts, "simulate_counters": simulate_counters, "simulate_sample": simulate_sample,
    "library_all_lengths": library_all_lengths, "best_length_per_library": best_length_per_library, "duplicate_guard": duplicate_guard, "incomplete_groups": incomplete_groups, "metadata_join": metadata_join,
    "unmatched_libraries": unmatched_libraries, "category_cleanup": category_cleanup, "category_order": category_order, "simulation_replicates": simulation_replicates,
    "simulation_conditions": simulation_conditions, "json_results": json_results, "event_props": event_props,
}

# ---- the same in SQL

_MOD3 = ", ".join(
    f"len(list_filter(range(1, length(seq) + 1), lambda i: (i - 1) % 3 = {r} AND substring(seq, i, 1) = '{b}'))::BIGINT AS n{r}{b}" for r in range(3) for b in STATE_BASES
)
_COMP = dict(zip("ACGT", "TGCA", strict=True))


def _score(sign: int, offset: int) -> str:
    log = np.log(P)
    terms = []
    for r in range(3):
        for i, b in enumerate(STATE_BASES):
            cell = f"n{r}{b}" if sign > 0 else f"n{(LENGTH - 1 - r) % 3}{_COMP[b]}"
            terms.append(f"{cell} * {float(log[(r + offset) % 3, i])!r}::DOUBLE")
    return "(" + " + ".join(terms) + ")"


_STATES = [(s, o) for s in (1, -1) for o in range(3)]
_EM = f"""reads AS ({demo.READS}), c AS (SELECT read_id, {_MOD3} FROM reads WHERE length(seq) = {LENGTH} AND regexp_full_match(seq, '[ACGT]+')),
s AS (SELECT *, [{', '.join(_score(*x) for x in _STATES)}] AS sc FROM c),
a AS (SELECT *, list_position(sc, list_max(sc)) - 1 AS state, list_max(sc) AS ll FROM s),
o AS (SELECT *, list_transform(sc, lambda x, i: CASE WHEN i = state + 1 THEN '-Infinity'::DOUBLE ELSE x END) AS oth FROM a),
g AS (SELECT *, list_position(oth, list_max(oth)) - 1 AS runnerup, ll - list_max(oth) AS gap_ll, (ll - list_max(oth)) / {LENGTH} AS gap_ll_per_base FROM o)"""


def _added(position: int, base: str) -> str:
    """What a read adds to a position class and base in its state."""
    cases = []
    for k, (sign, offset) in enumerate(_STATES):
        r = (position - offset) % 3
        cases.append(f"WHEN {k} THEN " + (f"n{r}{base}" if sign > 0 else f"n{(LENGTH - 1 - r) % 3}{_COMP[base]}"))
    return f"sum(CASE state {' '.join(cases)} END)"


def _stats(x: str) -> str:
    q = lambda p: f"quantile_cont({x}, {p})"
    parts = {"mean": f"avg({x})", "median": q(0.5), "sd": f"stddev_pop({x})", "min": f"min({x})", "q05": q(0.05), "q25": q(0.25), "q75": q(0.75), "q95": q(0.95), "max": f"max({x})"}
    return ", ".join(f"round({v}, 6) AS {x}_{k}" for k, v in parts.items())


def _map(sign: int, offset: int) -> list[int]:
    """The cell of the parameters, from 1, that each of a read's twelve counts belongs to in a state."""
    own = {4 * r + b if sign > 0 else 4 * ((LENGTH - 1 - r) % 3) + 3 - b: 4 * ((r + offset) % 3) + b + 1 for r in range(3) for b in range(4)}
    return [own[i] for i in range(12)]


def _iterated(start: str, steps: int) -> str:
    """Tables c (counts of each read) and it(step, seed, ll, p): so many whole steps from the rows (step 0, seed, 0, p) that ``start`` selects."""
    cells = ", ".join(f"(sum(list_sum(list_transform(c, lambda x, i: CASE WHEN map[i] = {j + 1} THEN x ELSE 0 END))))::DOUBLE" for j in range(12))
    return f"""RECURSIVE reads AS ({demo.READS}), c AS MATERIALIZED (
  SELECT [{', '.join(f'n{r}{b}' for r in range(3) for b in STATE_BASES)}] AS c FROM (SELECT read_id, {_MOD3} FROM reads WHERE length(seq) = {LENGTH} AND regexp_full_match(seq, '[ACGT]+'))),
m AS (SELECT {[_map(*x) for x in _STATES]} AS maps), it(step, seed, ll, p) AS (
  {start}
  UNION ALL
  SELECT step + 1, seed, ll, list_transform(t, lambda x, i: (x + {em.ALPHA}::DOUBLE) / (list_sum(t[(i - 1) // 4 * 4 + 1:(i - 1) // 4 * 4 + 4]) + 4 * {em.ALPHA}::DOUBLE)) FROM (
    SELECT step, seed, sum(ll) AS ll, [{cells}] AS t FROM (
      SELECT step, seed, c, list_max(sc) AS ll, maps[list_position(sc, list_max(sc))] AS map FROM (
        SELECT step, seed, c, maps, list_transform(maps, lambda w: list_sum(list_transform(c, lambda x, i: x * ln(p[w[i]])))) AS sc FROM it, c, m WHERE step < {steps}))
    GROUP BY step, seed)
)"""


#: The complementary error function of sqrt(x / 2), by Simpson's rule over its integral, term by term.
_tail = "(1 - 2 / sqrt(pi()) * sqrt({0} / 2) / 3000 * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-{0} / 2 * i * i / 1e6::DOUBLE))))"
_GIVEN = _iterated(f"SELECT 0::BIGINT, 0::BIGINT, 0::DOUBLE, {[float(x) for x in np.asarray(P).ravel()]}::DOUBLE[]", STEPS)
_NOISE = ", ".join(f"({seed}, {[float(x) for x in em.noise(seed).ravel()]}::DOUBLE[])" for seed in range(FIRST, FIRST + RESTARTS))
#: Once a fit is stable, further steps leave it as it is.
_FITTED = _iterated(
    f"""SELECT 0::BIGINT, seed::BIGINT, 0::DOUBLE, list_transform(raw, lambda x, i: x / list_sum(raw[(i - 1) // 4 * 4 + 1:(i - 1) // 4 * 4 + 4]))
  FROM (SELECT seed, list_transform(noise, lambda x, i: greatest(x + share[(i - 1) % 4 + 1], 1e-8::DOUBLE)) AS raw
        FROM (VALUES {_NOISE}) AS v(seed, noise), (SELECT list_transform(b, lambda x: x / list_sum(b)::DOUBLE) AS share FROM (SELECT [{', '.join(f'sum(c[{j + 1}] + c[{j + 5}] + c[{j + 9}])' for j in range(4))}] AS b FROM c)))""",
    40,
)
_PLACES = np.arange(12).reshape(3, 4)
#: The members of the symmetry class as places in the parameters, in the order in which they are tried.
_MEMBERS = [(flipped, k, (em.rotate(em.flip(_PLACES, LENGTH) if flipped else _PLACES, k).ravel() + 1).tolist()) for flipped in (False, True) for k in range(3)]
_NAMES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(em.STATES))
_FUNNEL = f"""a AS ({demo.ALIGNMENTS}), f AS ({demo.FEATURES}),
early AS MATERIALIZED (SELECT *, row_number() OVER () AS record, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 2816 <> 0 THEN 'non_primary_or_qcfail' WHEN flag & 1024 <> 0 THEN 'duplicate_flag_excluded'
   WHEN mapq < 25 THEN 'low_mapq' WHEN NOT regexp_full_match(cigar, '([0-9]+[M=X])+') THEN 'complex_cigar_excluded' END AS early FROM a),
pairs AS (SELECT record, f.*, (ref_start >= f.start AND ref_end <= f."end" AND (flag & 16 <> 0) = (strand = '-')) AS inside
  FROM early JOIN f ON early.contig = f.contig AND ref_start < f."end" AND ref_end > f.start WHERE early IS NULL),
per AS (SELECT record, count(*) FILTER (inside) AS n_inside, min(identifier) FILTER (inside) AS identifier FROM pairs GROUP BY record),
joined AS (SELECT early.*, n_inside, f.start AS cs, f."end" AS ce, f.strand, f.phase AS cp, f.identifier,
   CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGTN', 'TGCAN')) ELSE seq END AS rd, early.contig IN (SELECT contig FROM f) AS annotated
  FROM early LEFT JOIN per USING (record) LEFT JOIN f USING (identifier)),
phased AS (SELECT *, CASE WHEN strand = '+' THEN ((ref_start - (cs + cp)) % 3 + 3) % 3 ELSE (((ce - 1 - cp) - (ref_end - 1)) % 3 + 3) % 3 END AS ph FROM joined),
cut AS (SELECT *, (3 - ph) % 3 AS t5, greatest(length(rd) - (3 - ph) % 3, 0) % 3 AS t3 FROM phased),
done AS (SELECT *, substring(rd, (t5 + 1)::BIGINT, (greatest(length(rd) - t5, 0) - t3)::BIGINT) AS corrected FROM cut),
final AS (SELECT *, coalesce(early, CASE WHEN NOT annotated THEN 'contig_without_cds' WHEN n_inside IS NULL THEN 'no_cds_overlap' WHEN n_inside = 0 THEN 'not_fully_contained_or_antisense'
   WHEN n_inside > 1 THEN 'ambiguous_multiple_cds' WHEN rd IS NULL THEN 'missing_sequence' WHEN NOT regexp_full_match(rd, '[ACGT]+') THEN 'ambiguous_sequence'
   WHEN length(corrected) < 3 THEN 'too_short_after_trim' ELSE 'written' END) AS reason FROM done)"""
_U = lambda what: demo.UNIFORM.format(f"'42:{what}:' || id")
_SIM = f"""k AS ({demo.CONTIGS}), u AS (SELECT *, greatest(length(seq) - {READ}, 0) AS starts FROM k), p AS (SELECT *, sum(starts) OVER (ORDER BY ordinal) AS high FROM u WHERE starts > 0),
d AS (SELECT id, floor({_U('slot')} * (SELECT max(high) FROM p))::BIGINT AS slot, {_U('side')} < 0.5 AS reverse FROM range(0, {SAMPLE}) AS r(id)),
c AS (SELECT id, name, seq, reverse, (slot - (high - starts) + CASE WHEN reverse THEN 0 ELSE 1 END)::BIGINT AS start FROM d JOIN p ON slot >= high - starts AND slot < high),
s AS (SELECT id, name, start, start + {READ} AS "end", reverse, CASE WHEN reverse THEN reverse(translate(substring(seq, start + 1, {READ}), 'ACGT', 'TGCA')) ELSE substring(seq, start + 1, {READ}) END AS fragment,
   CASE WHEN reverse THEN translate(substring(seq, start + {READ} + 1, 1), 'ACGT', 'TGCA') ELSE substring(seq, start, 1) END AS outside,
   CASE WHEN reverse THEN translate(substring(seq, start + 1, 1), 'ACGT', 'TGCA') ELSE substring(seq, start + {READ}, 1) END AS inside FROM c),
j AS (SELECT *, CASE WHEN NOT regexp_full_match(fragment || outside || inside, '[ACGT]+') THEN 'invalid' WHEN outside IN ('C', 'T') AND {_U('five')} >= (1 - 0.7::DOUBLE) / 0.7::DOUBLE THEN 'rejected_5prime'
   WHEN inside IN ('C', 'T') AND {_U('three')} >= (1 - 0.6::DOUBLE) / 0.6::DOUBLE THEN 'rejected_3prime' ELSE 'accepted' END AS outcome FROM s)"""
_LIB = f"""l AS (SELECT *, CASE WHEN regexp_matches(sample, '^(SRR|ERR|DRR|PRJ)') THEN 'external_ancient' ELSE 'internal_ancient' END AS category FROM ({demo.LENGTHS})),
best AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY sample ORDER BY mean_r2 DESC, coalesce(read_count, -1) DESC, read_length) = 1)"""
_META = f"""{_LIB}, m AS ({demo.METADATA}), j AS (
  SELECT sample, category, mean_r2 AS max_r2, library_name, archive_data_accession, project_name, material, region, CASE WHEN m.archive_data_accession IS NULL THEN 'left_only' ELSE 'both' END AS _metadata_merge
  FROM best LEFT JOIN m ON sample = m.archive_data_accession WHERE category = 'external_ancient'
  UNION ALL
  SELECT sample, category, mean_r2, library_name, archive_data_accession, coalesce(project_name, 'in-house'), material, region, CASE WHEN m.library_name IS NULL THEN 'left_only' ELSE 'both' END
  FROM best LEFT JOIN m ON sample = m.library_name WHERE category = 'internal_ancient')"""
_LABEL = "CASE WHEN {0} IS NULL OR lower(trim({0})) IN ('unknown', 'unspecified', 'not specified', 'not available', 'na', 'n/a', 'null', '') THEN 'Unknown' ELSE trim({0}) END"
_REP = f"""s AS ({demo.SIMULATIONS}), r AS (SELECT genome, bias_5prime, bias_3prime, replicate, avg(r2) AS m, stddev_samp(r2) AS sd FROM s GROUP BY ALL)"""
_T = ", ".join(f"({k}, {rollup.t_quantile(k)!r}::DOUBLE)" for k in range(1, 31))
_FILES = """f AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice)::BIGINT % 90 AS v FROM orders WHERE o_orderkey % 19 <> 0),
p AS (SELECT *, (CASE WHEN c % 2 = 0 THEN 'ERR' ELSE 'LIB' END) || c AS sample FROM f)"""

_TOKENS = "b(i, x) AS (VALUES (0, 'A'), (1, 'T'), (2, 'G'), (3, 'C'))"

ORACLE_SQL = {
    "em_charts": f"""WITH {_EM}, n AS (SELECT state, count(*) AS n FROM a GROUP BY state), names(i, name) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(em.STATES))}),
p AS (SELECT i, name, coalesce(n, 0) / (SELECT count(*) FROM a)::DOUBLE AS share FROM names LEFT JOIN n ON state = i)
SELECT 'states' AS chart, {LENGTH}::BIGINT AS length, name AS mark, round(share, 9) AS share FROM p
UNION ALL SELECT 'shifts', {LENGTH}, (i % 3)::VARCHAR, round(sum(share), 9) FROM p GROUP BY i % 3
UNION ALL SELECT 'orientation', {LENGTH}, substring(name, 1, 1), round(sum(share), 9) FROM p GROUP BY ALL""",
    "em_fit": f"""WITH {_FITTED}, last AS (SELECT seed, ll, p FROM it WHERE step = 40), best AS (SELECT p FROM last WHERE ll >= (SELECT max(ll) FROM last) - 1e-9 ORDER BY seed LIMIT 1),
members(flipped, k, places) AS (VALUES {', '.join(f'({str(f).lower()}, {k}, {at})' for f, k, at in _MEMBERS)}),
found AS (SELECT flipped, k, list_transform(places, lambda i: p[i]) AS q FROM best, members ORDER BY list_transform(places, lambda i: round(p[i], 12)), flipped, k LIMIT 1)
SELECT {LENGTH}::BIGINT AS length, {LENGTH}::BIGINT AS effective_length, (i - 1) // 4 AS position_class, ['{"', '".join(STATE_BASES)}'][(i - 1) % 4 + 1] AS base, round(q[i], 9) AS prob,
  'full6' AS canonicalization_mode, k::BIGINT AS canonical_rotation, flipped AS canonical_rc_flip FROM found, range(1, 13) AS r(i)""",
    "em_state_distribution": f"""WITH {_FITTED}, last AS (SELECT seed, ll, p FROM it WHERE step = 40), best AS (SELECT * FROM last WHERE ll >= (SELECT max(ll) FROM last) - 1e-9 ORDER BY seed LIMIT 1),
members(flipped, k, places) AS (VALUES {', '.join(f'({str(f).lower()}, {k}, {at})' for f, k, at in _MEMBERS)}),
found AS (SELECT flipped, k FROM best, members ORDER BY list_transform(places, lambda i: round(p[i], 12)), flipped, k LIMIT 1),
raw AS (SELECT list_position(sc, list_max(sc)) - 1 AS s FROM (SELECT list_transform(maps, lambda w: list_sum(list_transform(c, lambda x, i: x * ln(p[w[i]])))) AS sc FROM best, c, m)),
named AS (SELECT CASE WHEN flipped THEN 3 * (1 - s // 3) + ((3 - s % 3) - k + 3) % 3 ELSE 3 * (s // 3) + (s % 3 - k + 3) % 3 END AS s FROM raw, found),
n AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (s = {i}) AS c{i}' for i in range(6))} FROM named),
x AS (SELECT *, {' + '.join(f'(c{i} - n / 6) * (c{i} - n / 6) / (n / 6)' for i in range(6))} AS x6, {' + '.join(f'(c{i} + c{i + 3} - n / 3) * (c{i} + c{i + 3} - n / 3) / (n / 3)' for i in range(3))} AS x3,
  (c0 + c1 + c2 - n / 2) * (c0 + c1 + c2 - n / 2) / (n / 2) + (c3 + c4 + c5 - n / 2) * (c3 + c4 + c5 - n / 2) / (n / 2) AS x2 FROM n)
SELECT {LENGTH}::BIGINT AS length, n AS n_sequences, {float(LENGTH)}::DOUBLE AS mean_informative_bases, round(x6, 6) AS chisq_6states, round(x3, 6) AS chisq_3shifts, round(x2, 6) AS chisq_orientation,
  round(exp(-x3 / 2), 6) AS p_3shifts, round({_tail.format('x2')}, 6) AS p_orientation, round({_tail.format('x6')} + sqrt(2 * x6 / pi()) * exp(-x6 / 2) * (1 + x6 / 3), 6) AS p_6states,
  {', '.join(f'c{i} AS "count_{x}", round(c{i} / n, 6) AS "prop_{x}"' for i, x in enumerate(em.STATES))},
  {', '.join(f'c{i} + c{i + 3} AS count_shift{i}, round((c{i} + c{i + 3}) / n, 6) AS prop_shift{i}' for i in range(3))}, round((c0 + c1 + c2) / n, 6) AS prop_plus, round((c3 + c4 + c5) / n, 6) AS prop_minus,
  round(ll, 5) AS best_ll, seed AS seed_used, (SELECT min(a.step) FROM it a JOIN it b ON b.seed = a.seed AND b.step = a.step - 1 AND a.p = b.p WHERE a.seed = best.seed) AS n_em_e_steps,
  k::BIGINT AS canonical_rotation, flipped AS canonical_rc_flip FROM x, best, found""",
    "em_iterations": f"""WITH {_GIVEN} SELECT step, round(ll, 6) AS ll, (i - 1) // 4 AS position_class, ['{"', '".join(STATE_BASES)}'][(i - 1) % 4 + 1] AS base, round(p[i], 9) AS prob
FROM it, range(1, 13) AS r(i) WHERE step > 0""",
    "scalar_functions": r"""SELECT p_partkey, regexp_replace(p_name, '[^\w-]', '_', 'g') AS safe, round((1 - (0.5::DOUBLE + p_size / 100.0::DOUBLE)) / (0.5::DOUBLE + p_size / 100.0::DOUBLE), 9) AS acceptance,
  p_size % 3 = 0 AS simple, substr('ACGTACGTACG', 1 + (3 - p_size % 3) % 3, (11 - (3 - p_size % 3) % 3) // 3 * 3) AS codons, ((3 - p_size % 3) % 3)::BIGINT AS trim5, ((11 - (3 - p_size % 3) % 3) % 3)::BIGINT AS trim3 FROM part""",
    "kmer_tokens": f"WITH {_TOKENS} SELECT 1::BIGINT AS k, i::BIGINT AS code, x AS token FROM b UNION ALL SELECT 2, p.i * 4 + q.i, p.x || q.x FROM b p, b q UNION ALL SELECT 3, p.i * 16 + q.i * 4 + r.i, p.x || q.x || r.x FROM b p, b q, b r",
    "mod3_counts": f"WITH reads AS ({demo.READS}) SELECT read_id, {_MOD3} FROM reads",
    "em_scores": f"WITH {_EM} SELECT " + ", ".join(f"n{r}{b}::BIGINT AS c{4 * r + i}" for r in range(3) for i, b in enumerate(STATE_BASES)) + ", count(*) AS weight, "
    + ", ".join(f"round(any_value(sc[{i + 1}]), 6) AS s{i}" for i in range(6)) + ", any_value(state)::BIGINT AS state FROM a GROUP BY " + ", ".join(f"n{r}{b}" for r in range(3) for b in STATE_BASES),
    "em_e_step": f"WITH {_EM} SELECT {LENGTH}::BIGINT AS length, state::BIGINT AS state, count(*) AS n, round(sum(ll), 5) AS ll FROM a GROUP BY state",
    "em_m_step": f"WITH {_EM}, t AS (SELECT " + ", ".join(f"{_added(q, b)}::DOUBLE + 0.5 AS t{q}{b}" for q in range(3) for b in STATE_BASES) + f" FROM a) SELECT {LENGTH}::BIGINT AS length, "
    + ", ".join(f"round(t{q}{b} / (" + " + ".join(f"t{q}{x}" for x in STATE_BASES) + f"), 9) AS p{q}{b}" for q in range(3) for b in STATE_BASES) + " FROM t",
    "em_gap_summary": f"""WITH {_EM} SELECT {LENGTH}::BIGINT AS length, count(*) AS n_reads, {float(LENGTH)}::DOUBLE AS mean_informative_bases, round(avg((gap_ll <= 1e-12)::INTEGER), 6) AS fraction_tie_best_vs_runnerup,
  round(avg((gap_ll < 0.1)::INTEGER), 6) AS fraction_gap_lt_0p1, round(avg((gap_ll < 1)::INTEGER), 6) AS fraction_gap_lt_1, {_stats('gap_ll')}, {_stats('gap_ll_per_base')} FROM g""",
    "em_gap_by_state": f"""WITH {_EM}, st AS (SELECT state, count(*) AS n, {_stats('gap_ll')}, {_stats('gap_ll_per_base')} FROM g GROUP BY state)
SELECT {LENGTH}::BIGINT AS length, name AS assigned_state, coalesce(n, 0) AS n_reads, st.* EXCLUDE (state, n) FROM (VALUES {_NAMES}) AS v(i, name) LEFT JOIN st ON st.state = v.i""",
    "em_gap_quantiles": f"WITH {_EM} SELECT state::BIGINT AS state, " + ", ".join(f"round(quantile_cont(gap_ll, {q}), 6) AS {n}" for n, q in (("median", 0.5), ("q05", 0.05), ("q95", 0.95))) + " FROM g GROUP BY state",
    "em_runnerup": f"""WITH {_EM}, pr AS (SELECT state, runnerup, count(*) AS n FROM g GROUP BY ALL), fr AS (SELECT x.i AS si, x.name AS assigned_state, y.i AS ri, y.name AS runnerup_state FROM (VALUES {_NAMES}) AS x(i, name), (VALUES {_NAMES}) AS y(i, name) WHERE x.i <> y.i),
t AS (SELECT assigned_state, runnerup_state, coalesce(n, 0) AS c FROM fr LEFT JOIN pr ON state = si AND runnerup = ri)
SELECT {LENGTH}::BIGINT AS length, assigned_state, runnerup_state, c AS "count", CASE WHEN sum(c) OVER (PARTITION BY assigned_state) > 0 THEN round(c / sum(c) OVER (PARTITION BY assigned_state), 9) END AS prop_within_assigned FROM t""",
    "chi_square_uniform": f"""WITH {_EM}, n AS (SELECT count(*)::DOUBLE AS n, """ + ", ".join(f"count(*) FILTER (state = {i})::DOUBLE AS c{i}" for i in range(6)) + f""" FROM a),
x AS (SELECT n, {' + '.join(f'(c{i} - n/6)*(c{i} - n/6)/(n/6)' for i in range(6))} AS x6, {' + '.join(f'(c{i} + c{i + 3} - n/3)*(c{i} + c{i + 3} - n/3)/(n/3)' for i in range(3))} AS x3,
  (c0+c1+c2 - n/2)*(c0+c1+c2 - n/2)/(n/2) + (c3+c4+c5 - n/2)*(c3+c4+c5 - n/2)/(n/2) AS x2 FROM n)
SELECT {LENGTH}::BIGINT AS length, n::BIGINT AS n_sequences, round(x6, 6) AS chisq_6states, round(x3, 6) AS chisq_3shifts, round(x2, 6) AS chisq_orientation, round(exp(-x3 / 2), 6) AS p_3shifts FROM x""",
    "cds_containment": f"WITH {_FUNNEL} SELECT read_id, contig, ref_start, ref_end, identifier AS cds_identifier, strand AS cds_strand FROM final WHERE reason = 'written'",
    "cds_exclusion_funnel": f"WITH {_FUNNEL}, n AS (SELECT reason, count(*) AS n FROM final GROUP BY reason UNION ALL SELECT 'records_seen', count(*) FROM final) SELECT v.reason, coalesce(n, 0) AS n FROM (VALUES "
    + ", ".join(f"('{r}')" for r in ("records_seen", *cds.REASONS)) + ") AS v(reason) LEFT JOIN n ON n.reason = v.reason",
    "codon_phase": f"""WITH {_FUNNEL} SELECT read_id, ph::BIGINT AS phase, t5::BIGINT AS trim5, t3::BIGINT AS trim3, corrected,
  read_id || '|phase=' || ph || '|trim5=' || t5 || '|trim3=' || t3 || '|cds=' || identifier || '|cds_strand=' || strand AS header FROM final WHERE reason = 'written'""",
    "cds_overlap_pairs": f"""WITH a AS ({demo.ALIGNMENTS}), f AS ({demo.FEATURES}) SELECT a.contig, count(*) AS n_pairs, count(DISTINCT read_id) AS n_reads, count(DISTINCT identifier) AS n_features
FROM a JOIN f ON a.contig = f.contig AND ref_start < f."end" AND ref_end > f.start GROUP BY a.contig""",
    "simulate_candidates": f'WITH {_SIM} SELECT id, name, start, "end", reverse, fragment, outside, inside FROM s',
    "simulate_accept": f"WITH {_SIM} SELECT id, outcome FROM j",
    "boundary_counts": f"WITH {_SIM} SELECT outcome, 'outside_5p' AS boundary, outside AS base, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT outcome, 'inside_3p', inside, count(*) FROM j GROUP BY ALL",
    "simulate_counters": f"""WITH {_SIM}, n AS (
  SELECT 'attempts' AS counter, 'all' AS name, count(*)::DOUBLE AS value FROM j
  UNION ALL SELECT 'outcome', o.outcome, count(j.id) FROM (VALUES ('invalid'), ('rejected_5prime'), ('rejected_3prime'), ('accepted')) AS o(outcome) LEFT JOIN j USING (outcome) GROUP BY o.outcome
  UNION ALL SELECT 'acceptance_fraction', 'all', avg((outcome = 'accepted')::INTEGER) FROM j
  UNION ALL SELECT 'orientation', CASE WHEN reverse THEN 'reverse_complement' ELSE 'forward_reference' END, count(*) FROM j WHERE outcome = 'accepted' GROUP BY reverse
  UNION ALL SELECT 'candidate_contig', name, count(*) FROM j GROUP BY name
  UNION ALL SELECT 'accepted_contig', name, count(*) FROM j WHERE outcome = 'accepted' GROUP BY name
  UNION ALL SELECT 'valid_starts', name, starts FROM p
) SELECT counter, name, round(value, 9) AS value FROM n""",
    "simulate_sample": f"WITH {_SIM.replace(f'range(0, {SAMPLE})', 'range(0, 4000)')} SELECT id, name, fragment FROM j WHERE outcome = 'accepted' ORDER BY id LIMIT 500",
    "library_all_lengths": f"WITH {_LIB} SELECT sample, category, read_length::BIGINT AS read_length, read_count, observed_read_count, round(mean_r2, 9) AS mean_r2, round(min_base_r2, 9) AS min_base_r2, round(max_base_r2, 9) AS max_base_r2 FROM l",
    "best_length_per_library": f"""WITH {_LIB}, g AS (SELECT sample, count(*) AS n, min(read_length) AS lo, max(read_length) AS hi, median(mean_r2) AS med, avg(mean_r2) AS mean FROM l GROUP BY sample)
SELECT sample, category, read_length::BIGINT AS best_length, read_count AS best_length_read_count, observed_read_count AS best_length_observed_read_count, n AS n_eligible_lengths, lo::BIGINT AS min_eligible_length,
  hi::BIGINT AS max_eligible_length, round(mean_r2, 9) AS max_r2, round(min_base_r2, 9) AS best_length_min_base_r2, round(max_base_r2, 9) AS best_length_max_base_r2, round(med, 9) AS median_mean_r2, round(mean, 9) AS mean_mean_r2_across_lengths
FROM best JOIN g USING (sample)""",
    "duplicate_guard": "SELECT o_custkey, o_orderkey % 40 + 30 AS read_length, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
    "incomplete_groups": f"WITH s AS ({demo.SIMULATIONS}) SELECT genome, bias_5prime, replicate::BIGINT AS replicate, string_agg(base, '' ORDER BY base) AS found FROM s WHERE NOT (base = 'C' AND replicate = 1) GROUP BY ALL HAVING string_agg(base, '' ORDER BY base) <> 'ACGT'",
    "metadata_join": f"WITH {_META} SELECT sample, category, round(max_r2, 9) AS max_r2, library_name, archive_data_accession, project_name, material, region, _metadata_merge FROM j",
    "unmatched_libraries": f"WITH {_META} SELECT sample, category, _metadata_merge FROM j WHERE _metadata_merge <> 'both'",
    "category_cleanup": f"WITH {_META}, n AS (SELECT sample, {_LABEL.format('region')} AS r, {_LABEL.format('material')} AS material FROM j) SELECT sample, CASE WHEN count(*) OVER (PARTITION BY r) >= 40 THEN r ELSE 'Other' END AS label, material FROM n",
    "category_order": f"""WITH {_META}, n AS (SELECT max_r2, {_LABEL.format('material')} AS r FROM j), k AS (SELECT max_r2, CASE WHEN count(*) OVER (PARTITION BY r) >= 5 THEN r ELSE 'Other' END AS material FROM n),
g AS (SELECT material, count(*) AS n, median(max_r2) AS med FROM k GROUP BY material) SELECT material, n, round(med, 9) AS median, row_number() OVER (ORDER BY med, material) AS place FROM g""",
    "simulation_replicates": f"WITH {_REP} SELECT genome, bias_5prime, bias_3prime, replicate::BIGINT AS replicate, round(m, 9) AS mean_r2_across_bases, round(sd, 9) AS sd_r2_across_bases FROM r",
    "simulation_conditions": f"""WITH {_REP}, g AS (SELECT genome, bias_5prime, bias_3prime, count(*) AS n, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS sd FROM r GROUP BY ALL), t(df, q) AS (VALUES {_T})
SELECT genome, bias_5prime, bias_3prime, n AS n_replicates, round(mean, 8) AS mean_r2, round(sd, 8) AS sd_between_replicates, round(sd / sqrt(n), 8) AS sem_between_replicates,
  round(greatest(mean - coalesce(q * sd / sqrt(n), 0), 0), 8) AS ci95_lower, round(least(mean + coalesce(q * sd / sqrt(n), 0), 1), 8) AS ci95_upper FROM g LEFT JOIN t ON df = n - 1""",
    "json_results": f"""WITH {_FILES} SELECT '/results/' || sample || '/stats/period3/kmer/L' || (k % 40 + 30) || '/' || k || '.json' AS source_json, CASE WHEN k % 13 <> 0 THEN sample END AS sample,
  CASE WHEN k % 13 <> 0 THEN CASE WHEN c % 2 = 0 THEN 'external_ancient' ELSE 'internal_ancient' END END AS category, CASE WHEN k % 13 <> 0 THEN k % 40 + 30 END AS read_length, CASE WHEN k % 13 <> 0 THEN k % 1000 END AS read_count,
  CASE WHEN k % 13 <> 0 THEN round((v / 100.0::DOUBLE + (v + 1) / 100.0::DOUBLE + (v + 2) / 100.0::DOUBLE + (v + 3) / 100.0::DOUBLE) / 4, 9) END AS mean_r2,
  CASE WHEN k % 13 <> 0 THEN v / 100.0::DOUBLE END AS min_base_r2, CASE WHEN k % 13 <> 0 THEN (v + 3) / 100.0::DOUBLE END AS max_base_r2, CASE WHEN k % 13 = 0 THEN 'a base is missing' END AS error FROM p""",
    "event_props": "SELECT event_type, count((props->>'k')::BIGINT) AS n, round(avg((props->>'k')::BIGINT), 9) AS mean_k FROM events GROUP BY event_type",
}
