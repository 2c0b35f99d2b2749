"""The period-3 harmonic: fit, permutation test, step-down adjustment, comparison of profiles.

On whole-numbered cycles the harmonic has as many parameters as there are phases (cycle mod 3), so least squares fits the
three phase means: all of the fit comes from sums by phase. Sums of counts are whole numbers, so a flat profile has a
coefficient of determination of exactly 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import BASES

START, END, ALPHA, PERMUTATIONS, SEED, MIN_CYCLES = 10, 40, 0.05, 10_000, 12345, 9
_COS = [math.cos(2 * math.pi * j / 3) for j in range(3)]
_SIN = [math.sin(2 * math.pi * j / 3) for j in range(3)]


def window(cells: DataFrame, start: int = START, end: int = END) -> DataFrame:
    """The cells whose cycle lies in the window, both ends included."""
    return cells.where(F.col("cycle").between(start, end))


def window_status(cells: DataFrame, start: int = START, end: int = END) -> DataFrame:
    """(length, n_cycles, status): ``skipped`` where the window has fewer than MIN_CYCLES cycles."""
    inside = F.countDistinct(F.when(F.col("cycle").between(start, end), F.col("cycle")))
    rows = cells.groupBy("length").agg(inside.alias("n_cycles"))
    return rows.withColumn("status", F.when(F.col("n_cycles") < MIN_CYCLES, "skipped").otherwise("ok"))


def phase_means(cells: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """(keys, phase, mean, n_cycles): the mean value at each cycle mod 3."""
    return cells.groupBy(*keys, (F.col("cycle") % 3).alias("phase")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_cycles"))


def fit(cells: DataFrame, keys: list[str], *, value: str = "n", scale: Column | None = None) -> DataFrame:
    """One row for each group of ``keys``: start, end, n_cycles, intercept, cos_coef, sin_coef, amplitude, phase_rad, phase_degrees, r2, status.

    ``value`` may be a count, and ``scale`` what it is divided by (a grouped expression); sums of counts are exact. A
    window without one of the phases has no unique fit and is ``degenerate``; its coefficients are null.
    """
    x = F.col(value).cast("decimal(38,0)") if dict(cells.dtypes)[value] in ("int", "bigint") else F.col(value)
    phase = F.col("cycle") % 3
    sums = [F.sum(F.when(phase == j, x)).alias(f"s{j}") for j in range(3)]
    ns = [F.sum((phase == j).cast("long")).alias(f"n{j}") for j in range(3)]
    scaled = (scale if scale is not None else F.lit(1.0)).alias("scale")
    grouped = cells.groupBy(*keys).agg(
        *sums, *ns, F.sum(x * x).alias("squares"), F.sum(x).alias("total"), F.count(F.lit(1)).alias("n_cycles"),
        F.min("cycle").alias("start"), F.max("cycle").alias("end"), F.max(F.abs(x)).alias("largest"), scaled,
    )
    d = lambda c: c.cast("double")
    m = [d(F.col(f"s{j}")) / d(F.col(f"n{j}")) / d(F.col("scale")) for j in range(3)]
    n, total = d(F.col("n_cycles")), d(F.col("total"))
    # n * SST from whole numbers where they are; a flat profile gives exactly 0
    spread = d(F.col("n_cycles") * F.col("squares") - F.col("total") * F.col("total"))
    between = n * sum(d(F.col(f"s{j}")) * d(F.col(f"s{j}")) / d(F.col(f"n{j}")) for j in range(3)) - total * total
    noise = F.pow(n * F.lit(2.0**-52) * d(F.col("largest")), 2) * n
    r2 = F.when(spread <= noise, 0.0).otherwise(F.least(F.greatest(between / spread, F.lit(0.0)), F.lit(1.0)))
    cos = 2 / 3 * sum(m[j] * _COS[j] for j in range(3))
    sin = 2 / 3 * sum(m[j] * _SIN[j] for j in range(3))
    whole = (F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("n2") > 0)
    out = grouped.where("n_cycles >= 3").withColumn("whole", whole).select(
        *keys, "start", "end", "n_cycles", F.when(F.col("whole"), (m[0] + m[1] + m[2]) / 3).alias("intercept"),
        F.when(F.col("whole"), cos).alias("cos_coef"), F.when(F.col("whole"), sin).alias("sin_coef"), F.when(F.col("whole"), r2).alias("r2"),
        F.when(~F.col("whole"), "degenerate").when(F.col("n_cycles") < MIN_CYCLES, "skipped").otherwise("ok").alias("status"),
    )
    angle = F.atan2("sin_coef", "cos_coef")
    degrees = F.degrees(angle)
    return out.select(
        *keys, "start", "end", "n_cycles", "intercept", "cos_coef", "sin_coef", F.hypot("cos_coef", "sin_coef").alias("amplitude"), angle.alias("phase_rad"),
        (degrees - 360 * F.floor(degrees / 360)).alias("phase_degrees"), "r2", "status",
    )


def permutation_p(cells: DataFrame, keys: list[str], permutations: int = PERMUTATIONS, seed: int = SEED, *, value: str = "n") -> DataFrame:
    """(keys, exceeding, p_value): (#{permuted fit at least as good} + 1) / (permutations + 1).

    The p-th permutation deals the values of a group to its cycles in the order of an MD5 over seed, permutation and
    cycle, so any partitioning gives the same. Total spread does not change under permutation, so fits compare by the sum of
    squared phase sums over phase counts, in whole numbers.
    """
    phase = F.col("cycle") % 3
    base = cells.groupBy(*keys).agg(
        *[F.sum(F.when(phase == j, F.col(value)).otherwise(0)).alias(f"s{j}") for j in range(3)],
        *[F.sum((phase == j).cast("long")).alias(f"n{j}") for j in range(3)],
    )
    order = Window.partitionBy(*keys).orderBy("cycle")
    placed = cells.select(*keys, "cycle", F.col(value).alias("x"), (F.row_number().over(order)).alias("slot"))
    many = placed.select(*keys, "cycle", "x", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("cycle").cast("string")))
    dealt = many.withColumn("slot", F.row_number().over(Window.partitionBy(*keys, "perm").orderBy(code, "cycle")))
    phases = placed.select(*keys, "slot", phase.alias("phase"))
    moved = dealt.join(phases, [*keys, "slot"]).groupBy(*keys, "perm").agg(*[F.sum(F.when(F.col("phase") == j, F.col("x")).otherwise(0)).alias(f"p{j}") for j in range(3)])
    big = lambda c: F.col(c).cast("decimal(18,0)")

    def score(prefix: str) -> Column:
        n = [big(f"n{j}").cast("decimal(6,0)") for j in range(3)]
        s = [(big(f"{prefix}{j}") * big(f"{prefix}{j}")).cast("decimal(30,0)") for j in range(3)]
        return sum((s[j] * (n[(j + 1) % 3] * n[(j + 2) % 3]).cast("decimal(8,0)")).cast("decimal(38,0)") for j in range(3))

    better = (score("p") >= score("s")).cast("long")
    return moved.join(base, keys).groupBy(*keys).agg(F.sum(better).alias("exceeding")).withColumn("p_value", (F.col("exceeding") + 1) / F.lit(float(permutations + 1)))


def permutation_p_replayed(cells: DataFrame, keys: list[str], permutations: int = PERMUTATIONS, seed: int = SEED, *, value: str = "n", base: str = "base") -> DataFrame:
    """(keys, p_value) by numpy's generator, with one child seed for each base in the order of the tables.

    Where ``length`` is a key, the seed of a length is ``seed + 10007 * length``.

    Every group is one window of cycles, so a group is as small as the window however many reads there are.
    """
    import numpy as np
    import pandas as pd

    schema = ", ".join(f"{c} {t}" for c, t in cells.select(*keys).dtypes) + ", p_value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cycle")
        own = seed + 10007 * int(pdf["length"].iloc[0]) if "length" in keys else seed
        child = np.random.SeedSequence(own).spawn(len(BASES))[BASES.index(pdf[base].iloc[0])]
        draw = np.random.default_rng(int(child.generate_state(1, dtype=np.uint64)[0]))
        y, phase = pdf[value].to_numpy(float), pdf.cycle.to_numpy() % 3
        members = np.stack([(phase == j) / max((phase == j).sum(), 1) ** 0.5 for j in range(3)])
        observed = np.square(members @ y).sum()
        slack = 1e-12 * max(abs(observed), 1.0)
        hits = sum(np.square(members @ draw.permutation(y)).sum() >= observed - slack for _ in range(permutations))
        return pdf.iloc[:1][keys].assign(p_value=(hits + 1) / (permutations + 1))

    return cells.groupBy(*keys).applyInPandas(run, schema)


def holm(rows: DataFrame, keys: list[str], *, p: str = "p_value", name: str = "base", alpha: float = ALPHA) -> DataFrame:
    """Adds p_value_adjusted, significant and all_significant within each group of ``keys``."""
    place = F.create_map(*[x for i, b in enumerate(BASES) for x in (F.lit(b), F.lit(i))])[F.col(name)]
    order = Window.partitionBy(*keys).orderBy(p, place)
    whole = Window.partitionBy(*keys)
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(whole))
    step = F.least((F.col("m") - F.col("rank") + 1) * F.col(p), F.lit(1.0))
    adjusted = ranked.withColumn("p_value_adjusted", F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = adjusted.withColumn("significant", F.col("p_value_adjusted") < alpha)
    return marked.withColumn("all_significant", F.min("significant").over(whole)).drop("rank", "m")


def compare(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Compares phase profiles (keys, base, phase, mean): best_shift, similarity_percent and that of each base.

    Each base's three means are centred and scaled to unit length (0 if flat); the second profile is shifted by 0, 1 and 2 phases, and the first
    shift with the largest correlation over all 12 values is taken. Similarity is 100 times the squared positive correlation.
    """
    a = _standard(one, keys).select(*keys, "base", "phase", F.col("z").alias("a"))
    b = _standard(two, keys).select(*keys, "base", F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("shift"), F.col("phase").alias("from"), F.col("z").alias("b"))
    b = b.withColumn("phase", F.pmod(F.col("from") + F.col("shift"), F.lit(3))).drop("from")
    pairs = a.join(b, [*keys, "base", "phase"])
    by_base = pairs.groupBy(*keys, "shift", "base").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    r = lambda ab, aa, bb: F.when((aa > 0) & (bb > 0), ab / F.sqrt(aa * bb)).otherwise(0.0)
    percent = lambda x: 100 * F.pow(F.greatest(x, F.lit(0.0)), 2)
    each = [percent(F.max(F.when(F.col("base") == x, r(F.col("ab"), F.col("aa"), F.col("bb"))))).alias(f"similarity_{x}") for x in BASES]
    shifts = by_base.groupBy(*keys, "shift").agg(r(F.sum("ab"), F.sum("aa"), F.sum("bb")).alias("r"), *each)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("r", 12)), "shift")
    best = shifts.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return best.select(*keys, F.col("shift").alias("best_shift"), percent(F.col("r")).alias("similarity_percent"), *[f"similarity_{x}" for x in BASES])


def _standard(profile: DataFrame, keys: list[str]) -> DataFrame:
    group = Window.partitionBy(*keys, "base")
    centred = profile.withColumn("c", F.col("mean") - F.avg("mean").over(group))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(group))
    return centred.withColumn("norm", norm).withColumn("z", F.when(F.col("norm") > 1e-12, F.col("c") / F.col("norm")).otherwise(0.0))
