"""Command line: ``python -m seqcycle COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .functions.sequences import hashed_offset, is_unambiguous, phase_trimmed
from .operators import cds, charts, counts, em, harmonic, rollup, simulate, spectrum
from .plans import composition
from .sources import detect, sequences, sinks, tables
from .sources.shared import qualified, written


def _ints(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.replace(",", " ").split())


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqcycle")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        for flag, kind, default in options:
            if kind is bool:
                c.add_argument(flag, action="store_true")
            elif flag.startswith("--"):
                c.add_argument(flag, type=kind, default=default)
            else:
                c.add_argument(flag, type=kind)

    h = harmonic
    command(
        "kmer", ("input", str, None), ("--outdir", str, "composition"), ("--k", _ints, (1,)), ("--lengths", _ints, ()), ("--min-read-count", int, counts.MIN_READ_COUNT), ("--max-reads", int, 0),
        ("--which", str, "r1"), ("--exclude-duplicates", bool, False), ("--collapse-exact", bool, False), ("--no-test", bool, False), ("--start", int, h.START), ("--end", int, h.END),
        ("--alpha", float, h.ALPHA), ("--permutations", int, h.PERMUTATIONS), ("--seed", int, h.SEED), ("--skip-existing", bool, False), ("--dry-run", bool, False),
    )
    command("test", ("csv", str, None), ("--start", int, h.START), ("--end", int, h.END), ("--alpha", float, h.ALPHA), ("--permutations", int, h.PERMUTATIONS), ("--seed", int, h.SEED))
    command("compare", ("one", str, None), ("two", str, None), ("--start", int, h.START), ("--end", int, h.END), ("--output", str, ""))
    command(
        "dft", ("input", str, None), ("--length", int, 60), ("--trim5", int, 0), ("--trim3", int, 0), ("--start", int, spectrum.START), ("--end", int, spectrum.END), ("--max-reads", int, 0),
        ("--collapse-exact", bool, False), ("--output", str, "dft"), ("--which", str, "r1"), ("--input-type", str, "auto"), ("--exclude-duplicates", bool, False),
    )
    command("trim", ("input", str, None), ("outdir", str, None), ("--length", int, 60), ("--five", int, -1), ("--mapped-only", bool, False), ("--min-mapq", int, 0), ("--seed", int, 42))
    command(
        "em", ("input", str, None), ("--out", str, "em"), ("--lengths", _ints, (60,)), ("--trim5", int, 0), ("--trim3", int, 0), ("--dedup", str, "none"), ("--cap", int, 0), ("--alpha", float, em.ALPHA),
        ("--max-iter", int, em.MAX_ITER), ("--tolerance", float, em.TOLERANCE), ("--seed", int, em.SEED), ("--restarts", int, em.RESTARTS), ("--canonicalize", str, "full6"), ("--allow-ambiguous", bool, False),
        ("--include-secondary", bool, False), ("--include-supplementary", bool, False), ("--include-qcfail", bool, False), ("--include-duplicates", bool, False),
    )
    command("cds", ("alignments", str, None), ("gff", str, None), ("output", str, None), ("--min-mapq", int, cds.MIN_MAPQ), ("--include-duplicates", bool, False))
    command(
        "simulate", ("input", str, None), ("output", str, None), ("--reads", int, 1000), ("--length", int, 60), ("--bias5", float, 0.5), ("--bias3", float, 0.5), ("--seed", int, simulate.SEED),
        ("--reverse-share", float, simulate.REVERSE_SHARE),
    )
    command("aggregate", ("folder", str, None), ("output", str, None))
    command("metadata", ("libraries", str, None), ("tsv", str, None), ("outdir", str, None), ("--min-libraries", int, rollup.MIN_LIBRARIES), ("--internal-project", str, None))
    command("conditions", ("csv", str, None), ("outdir", str, None))
    return p


def _kmer(spark, a):
    names = composition.Settings.__dataclass_fields__
    settings = composition.Settings(**{k: v for k, v in vars(a).items() if k in names}, test=not a.no_test)
    if a.dry_run:
        print(composition.planned(spark, settings).explained())
    else:
        composition.run(spark, settings)


def _test(spark, a):
    cells = harmonic.window(tables.cells_of(tables.one_mer_csv(spark, a.csv)), a.start, a.end)
    p = harmonic.permutation_p_replayed(cells, ["base"], a.permutations, a.seed, value="x")
    rows = harmonic.fit(cells, ["base"], value="x").join(p, "base").withColumn("window", F.lit(f"{a.start}-{a.end}"))
    if rows.where("status <> 'ok'").count():
        raise ValueError(f"the window needs at least {harmonic.MIN_CYCLES} cycles and all phases")
    print(sinks.fit_json(harmonic.holm(rows, ["window"], alpha=a.alpha), ["window"]).first().value)


def _compare(spark, a):
    means = [harmonic.phase_means(harmonic.window(tables.cells_of(tables.one_mer_csv(spark, p)), a.start, a.end), ["base"], "x").withColumn("pair", F.lit(1)) for p in (a.one, a.two)]
    print(harmonic.compare(*means, ["pair"]).drop("pair").toJSON().first())
    if a.output:
        sinks.table(charts.comparison(*means), f"{a.output}/comparison", kind="csv")


def _dft(spark, a):
    reads = detect.reads(spark, a.input, forced=a.input_type, which=a.which, duplicates=not a.exclude_duplicates)
    wide = counts.positional_frequencies(reads, a.length, a.trim5, a.trim3, collapse_exact=a.collapse_exact, max_reads=a.max_reads)
    total = F.col("A") + F.col("T") + F.col("G") + F.col("C")
    shares = wide.select("cycle", *[(F.col(b) / total).alias(b) for b in ("A", "T", "G", "C")]).cache()
    cells = tables.cells_of(shares)
    sinks.table(shares, f"{a.output}/cycle_frequencies", kind="csv")
    sinks.table(spectrum.spectrum(cells, ["base"], start=a.start, end=a.end), f"{a.output}/spectrum", kind="csv")
    r2 = {r.base: r.r2 for r in spectrum.spectral_r2(cells, ["base"], start=a.start, end=a.end).collect()}
    facts = counts.trim_counters(reads, a.length, a.trim5, a.trim3, collapse_exact=a.collapse_exact).first().asDict()
    sinks.manifest(spark, {"counters": facts, "r2": r2, "window": [a.start, a.end]}, f"{a.output}/manifest")


def _trim(spark, a):
    kind = detect.kind([qualified(spark, a.input)])
    rows = sequences.bam(spark, a.input) if kind == "bam" else sequences.sam(spark, a.input) if kind == "sam" else detect.reads(spark, a.input)
    if kind in ("bam", "sam"):
        if a.mapped_only:
            rows = rows.where((F.col("flag").bitwiseAND(cds.UNMAPPED) == 0) & (F.col("mapq") >= a.min_mapq))
        rows = sequences.as_reads(rows)
    five = F.lit(a.five) if a.five >= 0 else hashed_offset(F.col("read_id"), a.seed)
    facts = {r.counter: r.n for r in counts.trim_run(rows, a.length, five).collect()}
    rows = rows.where((F.length("seq") == a.length) & is_unambiguous(F.col("seq")))
    moved = rows.withColumn("trim5", five).withColumn("trim3", 2 - F.col("trim5"))
    for c in {"seq", "qual"} & set(moved.columns):
        moved = moved.withColumn(c, phase_trimmed(F.col(c), F.col("trim5")))
    if kind == "bam":
        sinks.bam(moved, f"{a.outdir}/reads", ["RG", "BC", "NM"])
    elif kind == "sam":
        sinks.sam_lines(moved, ["RG", "BC", "NM"]).write.text(f"{a.outdir}/reads")
    else:
        getattr(sinks, kind)(moved, f"{a.outdir}/reads", sinks.trimmed_header(moved))
    sinks.manifest(spark, facts, f"{a.outdir}/manifest")


def _em(spark, a):
    kinds = {"secondary": a.include_secondary, "supplementary": a.include_supplementary, "qc_fail": a.include_qcfail, "duplicates": a.include_duplicates}
    reads = detect.reads(spark, a.input, **kinds)
    inputs = sinks.digest_all(spark, a.input.split(","))
    effective = {n: n - a.trim5 - a.trim3 for n in a.lengths}
    every = written(em.profiles(reads, list(effective), trim5=a.trim5, trim3=a.trim3, dedup=a.dedup, cap=a.cap, allow_ambiguous=a.allow_ambiguous), "profiles")
    fits = em.fit_all(every, effective, restarts=a.restarts, seeds={n: a.seed + n * 10007 for n in effective}, alpha=a.alpha, max_iter=a.max_iter, tolerance=a.tolerance)
    distributions = []
    for length, fit in fits.items():
        rows, effective = every.where(F.col("length") == length), length - a.trim5 - a.trim3
        found = em.canonical(fit.p, effective, a.canonicalize)
        raw = written(em.gaps(em.e_step(rows, fit.p, effective)), "gaps")
        named = raw.withColumns({c: em.renumbered(F.col(c), found.states) for c in ("state", "runnerup")})
        names = "length int, effective_length int, position_class int, base string, prob double, canonicalization_mode string, canonical_rotation int, canonical_rc_flip boolean"
        out = {
            "base_probs": spark.createDataFrame(em.base_table(length, effective, found, a.canonicalize), names), "state_distribution": em.state_distribution(named, ["length"]),
            "gap_summary": em.gap_summary(raw, ["length"]), "gap_by_state": em.by_state(named), "runnerup": em.runner_up(named),
            "canonicalization": spark.createDataFrame(
                [(length, effective, a.canonicalize, found.rotation, found.flipped, effective % 3)],
                "length int, effective_length int, canonicalization_mode string, canonical_rotation int, canonical_rc_flip boolean, effective_length_mod3 int",
            ),
        }
        for name, table in out.items():
            sinks.table(table, f"{a.out}/L{length}/{name}", kind="tsv")
        distributions.append(out["state_distribution"])
        sinks.latex_table(spark, out["state_distribution"], ["length", "n_sequences", *[f"prop_{s}" for s in em.STATES]], f"{a.out}/L{length}/latex", caption=f"Shares of the six states, canonicalization {a.canonicalize}.")
        sinks.manifest(spark, {"inputs": inputs, "length": length, "ll": fit.ll, "seed": fit.seed, "e_steps": len(fit.trace), "rotation": found.rotation, "flipped": found.flipped}, f"{a.out}/L{length}/manifest")
    union = distributions[0]
    for part in distributions[1:]:
        union = union.unionByName(part)
    for name, table in charts.em(union).items():
        sinks.table(table, f"{a.out}/charts/{name}", kind="tsv")


def _cds(spark, a):
    kind = detect.kind([qualified(spark, a.alignments)])
    rows = cds.classified((sequences.sam if kind == "sam" else sequences.bam)(spark, a.alignments), tables.gff3(spark, a.gff), min_mapq=a.min_mapq, include_duplicates=a.include_duplicates).cache()
    sinks.fasta(rows.where("reason = 'written'"), f"{a.output}/fasta", cds.fasta_header(rows), "corrected")
    sinks.manifest(spark, {r.reason: r.n for r in cds.funnel(rows).collect()}, f"{a.output}/manifest")


def _simulate(spark, a):
    rows = simulate.sample(spark, tables.contigs(spark, a.input), a.reads, a.length, a.bias5, a.bias3, seed=a.seed, reverse_share=a.reverse_share)
    numbered = rows.withColumn("number", F.row_number().over(Window.orderBy("id")) - 1)  # a sample of as many rows as were asked for
    sinks.fasta(numbered, a.output, simulate.fasta_header(F.col("number").cast("string")), "fragment")
    contigs = tables.contigs(spark, a.input)
    tries = rows.agg(F.max("id")).first()[0] + 1  # the last accepted candidate ends the attempts
    made = simulate.judged(simulate.candidates(spark, contigs, tries, a.length, seed=a.seed, reverse_share=a.reverse_share), a.bias5, a.bias3, seed=a.seed)
    sinks.table(simulate.counters(made, contigs, a.length), f"{a.output}-counters", kind="csv")
    sinks.table(simulate.boundary_counts(made.where("outcome = 'accepted'")), f"{a.output}-boundaries", kind="csv")
    sinks.manifest(spark, {"inputs": sinks.digest_all(spark, [a.input]), "settings": vars(a)}, f"{a.output}-manifest")


def _aggregate(spark, a):
    good, bad = rollup.parsed_results(tables.result_files(spark, a.folder))
    good = rollup.require_unique(good.cache(), ["sample", "read_length"], "the results")
    for name, table in (("all_lengths", good), ("libraries", rollup.library_summary(good)), ("errors", bad)):
        sinks.table(table, f"{a.output}/{name}", kind="csv")
    sinks.manifest(spark, {"settings": vars(a), "results": good.count(), "libraries": good.select("sample").distinct().count(), "errors": bad.count()}, f"{a.output}/manifest")


def _metadata(spark, a):
    joined = rollup.joined_metadata(tables.library_csv(spark, a.libraries), tables.metadata_tsv(spark, a.tsv), internal_project=a.internal_project).cache()
    sinks.table(joined, f"{a.outdir}/joined", kind="csv")
    sinks.table(rollup.unmatched(joined), f"{a.outdir}/unmatched", kind="csv")
    facts = {"settings": vars(a), "libraries": joined.count(), "unmatched": rollup.unmatched(joined).count(), "inputs": sinks.digest_all(spark, [a.libraries, a.tsv])}
    sinks.manifest(spark, facts, f"{a.outdir}/manifest")
    for c in [c for c in ("project_name", "material") if c in joined.columns]:
        sinks.table(rollup.category_order(rollup.cleaned_categories(joined, c, a.min_libraries), c), f"{a.outdir}/order_{c}", kind="csv")


def _conditions(spark, a):
    means = rollup.replicate_means(tables.simulation_csv(spark, a.csv)).cache()
    sinks.table(means, f"{a.outdir}/replicate_means", kind="csv")
    sinks.table(rollup.condition_summary(means), f"{a.outdir}/condition_summary", kind="csv")


def _check(a) -> None:
    """Refuses parameters outside their domains, before anything is read."""

    def need(fine: bool, text: str) -> None:
        if not fine:
            raise ValueError(text)

    if a.command == "trim":
        need(a.length > 2, "--length must exceed 2, the symbols that are cut off")
        need(a.five in (-1, 0, 1, 2), "--five is 0, 1 or 2, or -1 for an offset by read")
    if a.command in ("trim", "cds"):
        need(a.min_mapq >= 0, "--min-mapq must not be negative")
    if a.command in ("dft", "kmer"):
        need(a.which in ("r1", "r2", "both"), "--which is r1, r2 or both")
    if a.command == "simulate":
        need(a.reads > 0 and a.length > 0, "--reads and --length must be positive")
        need(0 <= a.reverse_share <= 1, "--reverse-share must lie in [0, 1]")
        need(0.5 <= a.bias5 <= 1 and 0.5 <= a.bias3 <= 1, "--bias5 and --bias3 must lie in [0.5, 1]")
    if a.command == "em":
        need(bool(a.lengths) and min(a.lengths) > 0, "--lengths must hold positive numbers")
        need(a.trim5 >= 0 and a.trim3 >= 0, "--trim5 and --trim3 must not be negative")
        need(all(n - a.trim5 - a.trim3 > 0 for n in a.lengths), "--trim5 and --trim3 must leave something of every length")
        need(a.cap >= 0, "--cap must not be negative")
        need(not a.cap or a.dedup != "none", "--cap needs a --dedup other than none")
        need(a.alpha > 0 and a.max_iter >= 1 and a.tolerance >= 0 and a.restarts >= 1, "--alpha must be positive, --max-iter and --restarts at least 1, --tolerance not negative")
        need(a.canonicalize in em.MODES, f"--canonicalize is one of {', '.join(em.MODES)}")


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    _check(a)
    spark = SparkSession.builder.appName("seqcycle").getOrCreate()
    globals()[f"_{a.command}"](spark, a)


if __name__ == "__main__":
    main()
