"""Biased sampling of fragments from contigs.

A candidate is a number; contig, orientation, place and both acceptance tests follow from MD5s over seed and number, so the
sample does not depend on partitioning. The first ``n`` accepted candidates by number are the sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import complement, is_unambiguous, pyrimidine_acceptance, reverse_complement_upper, uniform

SEED, REVERSE_SHARE, CHUNK = 42, 0.5, 1 << 16


def placed_contigs(contigs: DataFrame, read_length: int) -> DataFrame:
    """(name, ordinal, starts, low, high): usable contigs with their slots [low, high) among all start places, in the order of ``ordinal``.

    Contigs are as many as a reference has, so the running sum is over a short table, which holds no sequence.
    """
    usable = contigs.select("name", "ordinal", F.greatest(F.length("seq") - read_length, F.lit(0)).cast("long").alias("starts")).where("starts > 0")
    order = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return usable.withColumn("high", F.sum("starts").over(order)).select("name", "ordinal", "starts", (F.col("high") - F.col("starts")).alias("low"), "high")


def pieces(contigs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(ordinal, chunk, piece): contigs in chunks of ``size`` symbols, each followed by the first ``overlap`` of the next one."""
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    whole = F.transform(F.col("cut"), lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("cut", i + 1), 1, overlap), F.lit(""))))
    return contigs.select("ordinal", cut.alias("cut")).select("ordinal", F.posexplode(whole).alias("chunk", "piece"))


def candidates(spark: SparkSession, contigs: DataFrame, n: int, read_length: int, *, seed: int = SEED, reverse_share: float = REVERSE_SHARE) -> DataFrame:
    """(id, name, start, end, reverse, fragment, outside, inside): places, and the read-oriented bases at both breaks.

    All joins are on equal keys. Slots are cut into as many bins as there are contigs, so a candidate meets two contigs in its bin on the mean, whatever their
    sizes; then it meets the one chunk of sequence that holds its fragment.
    """
    places = placed_contigs(contigs, read_length)
    total, count = places.agg(F.max("high"), F.count(F.lit(1))).first()
    if total is None:
        raise ValueError("no contig is long enough for the read length and the base before it")
    u = lambda what: uniform(F.lit(str(seed)), F.lit(what), F.col("id").cast("string"))
    drawn = spark.range(n).select("id", F.floor(u("slot") * total).alias("slot"), (u("side") < reverse_share).alias("reverse"))
    width, size = -(-total // count), max(CHUNK, 2 * read_length + 4)
    bins = places.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    found = drawn.withColumn("bin", F.floor(F.col("slot") / width)).join(bins, "bin").where((F.col("slot") >= F.col("low")) & (F.col("slot") < F.col("high")))
    start = F.col("slot") - F.col("low") + F.when(F.col("reverse"), 0).otherwise(1)
    first = F.greatest(F.col("start") - 1, F.lit(0))
    placed = found.select("id", "name", "ordinal", "reverse", start.cast("int").alias("start")).withColumn("end", F.col("start") + read_length)
    at = placed.withColumn("chunk", F.floor(first / size).cast("int")).join(pieces(contigs, size, read_length + 2), ["ordinal", "chunk"])
    base = lambda i: F.substr("piece", (i - F.col("chunk") * size + 1).cast("int"), F.lit(1))
    piece = F.substr("piece", (F.col("start") - F.col("chunk") * size + 1).cast("int"), F.lit(read_length))
    outside = F.when(F.col("reverse"), complement(base(F.col("end")))).otherwise(base(F.col("start") - 1))
    inside = F.when(F.col("reverse"), complement(base(F.col("start")))).otherwise(base(F.col("end") - 1))
    fragment = F.when(F.col("reverse"), reverse_complement_upper(piece)).otherwise(piece)
    return at.select("id", "name", "start", "end", "reverse", fragment.alias("fragment"), outside.alias("outside"), inside.alias("inside"))


def judged(rows: DataFrame, bias5: float = 0.5, bias3: float = 0.5, *, seed: int = SEED) -> DataFrame:
    """Adds ``outcome``: invalid, rejected_5prime, rejected_3prime or accepted. A and G always pass; C and T with probability (1-b)/b."""
    u = lambda what: uniform(F.lit(str(seed)), F.lit(what), F.col("id").cast("string"))

    def passes(base: Column, bias: float, what: str) -> Column:
        return base.isin("A", "G") | (u(what) < pyrimidine_acceptance(bias))

    valid = is_unambiguous(F.col("fragment")) & is_unambiguous(F.col("outside")) & is_unambiguous(F.col("inside"))
    outcome = (
        F.when(~valid, "invalid").when(~passes(F.col("outside"), bias5, "five"), "rejected_5prime").when(~passes(F.col("inside"), bias3, "three"), "rejected_3prime").otherwise("accepted")
    )
    return rows.withColumn("outcome", outcome)


def sample(spark: SparkSession, contigs: DataFrame, n: int, read_length: int, bias5: float = 0.5, bias3: float = 0.5, *, seed: int = SEED, reverse_share: float = REVERSE_SHARE) -> DataFrame:
    """The first ``n`` accepted candidates by id; candidates are made until there are enough, or max(100000, 10000 n) were."""
    tries, limit = max(2 * n, 1000), max(100_000, 10_000 * n)
    while True:
        rows = judged(candidates(spark, contigs, min(tries, limit), read_length, seed=seed, reverse_share=reverse_share), bias5, bias3, seed=seed).where("outcome = 'accepted'")
        if rows.count() >= n:
            return rows.orderBy("id").limit(n)
        if tries >= limit:
            raise ValueError(f"too few fragments were accepted in {limit} attempts")
        tries *= 4


def fasta_header(number: Column) -> Column:
    """The structured header of the sample's ``number``-th fragment."""
    side = F.when(F.col("reverse"), "reverse_complement").otherwise("forward_reference")
    named = {"chrom": "name", "start": "start", "end": "end", "base_5p_outside_oriented": "outside", "base_3p_inside_oriented": "inside"}
    return F.concat_ws("|", F.concat(F.lit("read_"), number), *[F.concat(F.lit(f"{k}="), F.col(c)) for k, c in named.items()], F.concat(F.lit("orientation="), side))


def replayed(contigs: list[tuple[str, str]], n: int, read_length: int, bias5: float = 0.5, bias3: float = 0.5, *, seed: int = SEED, reverse_share: float = REVERSE_SHARE) -> tuple[list[tuple], int]:
    """(accepted fragments, attempts) of one sequential random generator, for small samples that must repeat an earlier run.

    Each attempt draws a slot, an orientation and a start, then one number for each break after C or T that it comes to.
    """
    draw = np.random.default_rng(seed)
    usable = [(name, seq, len(seq) - read_length) for name, seq in contigs if len(seq) > read_length]
    bounds = np.cumsum([starts for *_, starts in usable])
    turned = str.maketrans("ACGT", "TGCA")

    def kept(base: str, bias: float) -> bool:
        return base in "AG" or draw.random() < (1 - bias) / bias

    rows: list[tuple] = []
    for attempt in range(1, max(100_000, 10_000 * n) + 1):
        name, seq, starts = usable[int(np.searchsorted(bounds, draw.integers(0, bounds[-1]), side="right"))]
        reverse = bool(draw.random() < reverse_share)
        start = int(draw.integers(0, starts) if reverse else draw.integers(1, starts + 1))
        piece = seq[start : start + read_length]
        ends = (seq[start + read_length] + piece[0]).translate(turned) if reverse else seq[start - 1] + piece[-1]
        if set(piece + ends) <= set("ACGT") and kept(ends[0], bias5) and kept(ends[1], bias3):
            rows.append((name, start, start + read_length, reverse, piece[::-1].translate(turned) if reverse else piece))
            if len(rows) == n:
                return rows, attempt
    raise ValueError(f"too few fragments were accepted in {attempt} attempts")


def counters(rows: DataFrame, contigs: DataFrame, read_length: int) -> DataFrame:
    """(counter, name, value) of judged candidates: attempts, outcomes, the accepted share, orientations and contigs of accepted ones, contigs of all, valid starts of contigs."""
    good = F.col("outcome") == "accepted"
    side = F.when(F.col("reverse"), "reverse_complement").otherwise("forward_reference")

    def counted(counter: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(counter).alias("counter"), name.alias("name"), value.cast("long").alias("n"), F.lit(1).alias("of"))

    each = [counted("attempts", F.lit("all"), F.lit(1)), counted("candidate_contig", F.col("name"), F.lit(1)), counted("acceptance_fraction", F.lit("all"), good)]
    each += [counted("outcome", F.lit(o), F.col("outcome") == o) for o in ("invalid", "rejected_5prime", "rejected_3prime", "accepted")]
    each += [F.when(good, counted("orientation", side, F.lit(1))), F.when(good, counted("accepted_contig", F.col("name"), F.lit(1)))]
    sums = rows.select(F.explode(F.array(*each)).alias("e")).where("e is not null").groupBy("e.counter", "e.name").agg(F.sum("e.n").alias("n"), F.sum("e.of").alias("of"))
    value = F.when(F.col("counter") == "acceptance_fraction", F.round(F.col("n") / F.col("of"), 9)).otherwise(F.col("n").cast("double"))
    starts = placed_contigs(contigs, read_length).select(F.lit("valid_starts").alias("counter"), "name", F.col("starts").cast("double").alias("value"))
    return sums.select("counter", "name", value.alias("value")).unionByName(starts)


def boundary_counts(rows: DataFrame) -> DataFrame:
    """(outcome, boundary, base, n): which bases stand at either break."""
    ends = F.explode(F.array(F.struct(F.lit("outside_5p").alias("boundary"), F.col("outside").alias("base")), F.struct(F.lit("inside_3p").alias("boundary"), F.col("inside").alias("base")))).alias("e")
    return rows.select("outcome", ends).groupBy("outcome", "e.boundary", "e.base").agg(F.count(F.lit(1)).alias("n"))
