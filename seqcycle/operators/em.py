"""A latent model of six states: a read's period-3 offset (0, 1, 2) and orientation (+, -), fitted by hard expectation-maximisation.

A read is its 12 counts of A, C, G, T at positions of remainder 0, 1, 2 (columns ``c0`` to ``c11``, in that order). Counts of the reverse
complement are a permutation of those of the read, so both orientations score from the same columns. Reads with equal counts are
one row with a ``weight``. The parameters are 12 probabilities, so a step is one projection with their logarithms (literal, or columns of a small table of
restarts) and one sum of 12 columns for each state; assignments follow from the parameters and are never stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import STATE_BASES, is_unambiguous, mod3_counts, trimmed
from ..functions.special import chi_square_survival
from . import quantiles
from .counts import capped_unique, collapse

MODES = ("none", "rotation", "full6")
STATES = ("+0", "+1", "+2", "-0", "-1", "-2")
ALPHA, MAX_ITER, TOLERANCE, SEED, RESTARTS = 0.5, 100, 1e-6, 1, 10
#: A, C, G, T complement to T, G, C, A: the order of the bases, reversed.
_COMPLEMENT = (3, 2, 1, 0)


_CELLS = [f"c{i}" for i in range(12)]


def profiles(reads: DataFrame, lengths: int | list[int], *, trim5: int = 0, trim3: int = 0, dedup: str = "none", cap: int = 0, allow_ambiguous: bool = False) -> DataFrame:
    """(length, c0..c11, weight) of the reads of one or several raw lengths, trimmed, from one scan; reads without a counted symbol are left out."""
    wanted = [lengths] if isinstance(lengths, int) else list(lengths)
    rows = reads.where(F.length("seq").isin(wanted)).withColumn("length", F.length("seq")).withColumn("seq", trimmed(F.col("seq"), trim5, trim3))
    rows = rows.where(F.length("seq") > 0 if allow_ambiguous else is_unambiguous(F.col("seq")))
    if dedup != "none":
        rows = capped_unique(rows, dedup, cap) if cap else collapse(rows, dedup)
    grouped = rows.select("length", mod3_counts(F.col("seq")).alias("profile")).groupBy("length", "profile").agg(F.count(F.lit(1)).alias("weight"))
    cells = grouped.select("length", *[F.get("profile", F.lit(i)).alias(c) for i, c in enumerate(_CELLS)], "weight")
    return cells.where(informative() > 0)


def informative() -> Column:
    """The number of counted symbols of a read."""
    return sum((F.col(c) for c in _CELLS[1:]), F.col(_CELLS[0]))


def _count(effective: int, sign: int, remainder: int, base: int) -> Column:
    """The count of a base at a remainder, of the read or of its reverse complement."""
    if sign > 0:
        return F.col(f"c{4 * remainder + base}")
    return F.col(f"c{4 * ((effective - 1 - remainder) % 3) + _COMPLEMENT[base]}")


def _scores(count: Callable[[int, int, int], Column], log: Callable[[int, int], Column]) -> list[Column]:
    """The log likelihoods of the six states from counts (sign, remainder, base) and log probabilities (position class, base)."""
    out = []
    for sign in (1, -1):
        for offset in range(3):
            terms = [count(sign, r, b) * log((r + offset) % 3, b) for r in range(3) for b in range(4)]
            out.append(sum(terms[1:], terms[0]))
    return out


def scores(p: np.ndarray, effective: int) -> list[Column]:
    """The log likelihoods of the six states under ``p`` (3 position classes by 4 bases)."""
    log = np.log(np.asarray(p, float))
    return _scores(lambda sign, r, b: _count(effective, sign, r, b), lambda q, b: F.lit(float(log[q, b])))


def first_largest(values: list[Column]) -> Column:
    """The place of the first of the largest values."""
    return (F.array_position(F.array(*values), F.greatest(*values)) - 1).cast("int")


def e_step(rows: DataFrame, p: np.ndarray, effective: int) -> DataFrame:
    """Adds s0..s5 (scores), state (the first of the largest) and ll (its score)."""
    scored = rows.select("*", *[s.alias(f"s{i}") for i, s in enumerate(scores(p, effective))])
    values = [F.col(f"s{i}") for i in range(6)]
    return scored.select("*", first_largest(values).alias("state"), F.greatest(*values).alias("ll"))


def totals(assigned: DataFrame, keys: list[str], effective: int) -> DataFrame:
    """(keys, t0..t11, ll, n): sums over all reads of the counts that their states add to the position classes."""
    return assigned.groupBy(*keys).agg(*_sums(lambda sign, r, b: _count(effective, sign, r, b)))


def _sums(count: Callable[[int, int, int], Column]) -> list[Column]:
    """The aggregates t0..t11, ll and n."""
    cells: list[list[Column]] = [[None] * 6 for _ in range(12)]
    for state in range(6):
        sign, offset = (1, -1)[state // 3], state % 3
        for r in range(3):
            for b in range(4):
                cells[4 * ((r + offset) % 3) + b][state] = count(sign, r, b)
    sums = []
    for i, by_state in enumerate(cells):
        cell = by_state[0]
        for state in range(1, 6):
            cell = F.when(F.col("state") == state, by_state[state]).otherwise(cell)
        sums.append(F.sum(cell * F.col("weight")).alias(f"t{i}"))
    return [*sums, F.sum(F.col("ll") * F.col("weight")).alias("ll"), F.sum("weight").alias("n")]


def m_step(t: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    smoothed = np.asarray(t, float).reshape(3, 4) + alpha
    return smoothed / smoothed.sum(axis=1, keepdims=True)


def score(t: np.ndarray, p: np.ndarray) -> float:
    """The log likelihood of the reads whose totals are ``t``, rounded once: it does not depend on how reads are dealt, and fits that are turns of each other tie exactly."""
    return math.fsum((np.asarray(t, float).ravel() * np.log(np.asarray(p, float)).ravel()).tolist())


def first_best(fits: list[Fit]) -> Fit:
    """The first of the fits whose score is the largest but for rounding."""
    top = max(f.ll for f in fits)
    return next(f for f in fits if f.ll >= top - 1e-9)


def noise(seed: int) -> np.ndarray:
    """What tells a restart's first parameters from the overall base frequencies."""
    return np.random.default_rng(seed).normal(0, 0.01, (3, 4))


def initial(base_counts: np.ndarray, seed: int) -> np.ndarray:
    """The overall base frequencies with normal noise of deviation 0.01, kept positive, for each position class."""
    share = np.asarray(base_counts, float)
    share = share / share.sum()
    p = np.clip(share[None, :] + noise(seed), 1e-8, None)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class Fit:
    """One restart: parameters, the score of each E-step, and whether assignments have become stable."""

    seed: int
    p: np.ndarray
    before: np.ndarray | None = None
    trace: list[float] = field(default_factory=list)
    stable: bool = False

    @property
    def ll(self) -> float:
        return self.trace[-1]


def parameters(spark, moving: list[tuple[int, int, Fit]]) -> DataFrame:
    """(length, seed, turn, l0..l11, first, o0..o11): the logarithms of each restart's parameters and of those before them, and by how much its length turns the reverse strand."""
    names = ["length int", "seed long", "turn int", *[f"l{i} double" for i in range(12)], "first boolean", *[f"o{i} double" for i in range(12)]]
    logs = lambda p: [float(x) for x in np.log(np.asarray(p, float)).ravel()]
    rows = [(n, f.seed, (effective - 1) % 3, *logs(f.p), f.before is None, *logs(f.p if f.before is None else f.before)) for n, effective, f in moving]
    return spark.createDataFrame(rows, ", ".join(names))


def stepper(rows: DataFrame) -> Callable[[list[tuple[int, int, Fit]]], DataFrame]:
    """A function that gives (length, seed, t0..t11, ll, n, changed) of one step of all given restarts (length, effective length, fit); its expressions are the same for every step."""
    # On the reverse strand, a remainder r is counted where the read has turn - r and the complement.
    turned = [F.element_at(F.array(*[F.col(f"c{4 * ((turn - r) % 3) + _COMPLEMENT[b]}") for turn in range(3)]), F.col("turn") + 1).alias(f"d{4 * r + b}") for r in range(3) for b in range(4)]
    count = lambda sign, r, b: F.col(f"{'c' if sign > 0 else 'd'}{4 * r + b}")
    now, before = (_scores(count, lambda q, b, x=x: F.col(f"{x}{4 * q + b}")) for x in "lo")
    scored = ["length", "seed", "weight", "first", *_CELLS, *[f"d{i}" for i in range(12)], *[s.alias(f"s{i}") for i, s in enumerate(now)], *[s.alias(f"p{i}") for i, s in enumerate(before)]]
    values = [F.col(f"s{i}") for i in range(6)]
    states = {"state": first_largest(values), "ll": F.greatest(*values)}
    moved = F.col("first") | (first_largest([F.col(f"p{i}") for i in range(6)]) != F.col("state"))
    sums = [*_sums(count), F.max(moved).alias("changed")]

    def step(moving: list[tuple[int, int, Fit]]) -> DataFrame:
        table = F.broadcast(parameters(rows.sparkSession, moving))  # as many rows as restarts, which the caller has in its own list
        return rows.join(table, "length").select("*", *turned).select(*scored).withColumns(states).groupBy("length", "seed").agg(*sums)

    return step


def fit_all(rows: DataFrame, effective: dict[int, int], *, restarts: int = RESTARTS, seeds: dict[int, int] | None = None, alpha: float = ALPHA, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> dict[int, Fit]:
    """For each raw length of ``effective`` (its length after trims), the best of ``restarts`` fits: the largest score, then the smallest seed.

    All restarts of all lengths that still move advance together: their parameters are a small table, a row for each, which is joined to the profiles by
    length, and one aggregate by length and restart gives the new sums and whether any read's state differs from its state under the parameters before; a restart
    stops when none does. A step reads the profiles once, however many restarts there are; ``rows`` should be written down, or each reads what they come from.
    """
    bases = [F.sum((F.col(f"c{b}") + F.col(f"c{4 + b}") + F.col(f"c{8 + b}")) * F.col("weight")).alias(f"b{b}") for b in range(4)]
    counts = {r.length: np.array([r.b0, r.b1, r.b2, r.b3], float) for r in rows.groupBy("length").agg(*bases).collect()}  # a row for each length
    if missing := sorted(set(effective) - set(counts)):
        raise ValueError(f"no reads to fit of lengths {missing}")
    first = seeds or {}
    fits = {n: [Fit(first.get(n, SEED) + r, initial(counts[n], first.get(n, SEED) + r)) for r in range(restarts)] for n in effective}
    step = stepper(rows)
    for _ in range(max_iter):
        moving = [(n, f) for n, own in fits.items() for f in own if not f.stable]
        if not moving:
            break
        sums = {(r.length, r.seed): r for r in step([(n, effective[n], f) for n, f in moving]).collect()}  # a row for each restart
        for n, f in moving:
            r = sums[n, f.seed]
            t = np.array([r[f"t{i}"] for i in range(12)], float)
            ll = score(t, f.p)
            if f.trace and ll < f.trace[-1] - tolerance * (1 + abs(f.trace[-1])):
                raise ValueError("the score has fallen")
            f.trace.append(ll)
            if f.before is not None and not r.changed:
                f.stable = True
            else:
                f.before, f.p = f.p, m_step(t, alpha)
    if not all(f.stable for own in fits.values() for f in own):
        raise ValueError(f"assignments are not stable after {max_iter} steps")
    return {n: first_best(own) for n, own in fits.items()}


def fit(rows: DataFrame, effective: int, *, restarts: int = RESTARTS, seed: int = SEED, alpha: float = ALPHA, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> Fit:
    """The best fit of the profiles of one length."""
    one = rows.withColumn("length", F.lit(0))
    return fit_all(one, {0: effective}, restarts=restarts, seeds={0: seed}, alpha=alpha, max_iter=max_iter, tolerance=tolerance)[0]


def iterated(rows: DataFrame, effective: int, p: np.ndarray, steps: int, alpha: float = ALPHA) -> list[tuple[float, np.ndarray]]:
    """(score, new parameters) of each of a given number of steps from given parameters."""
    out = []
    for _ in range(steps):
        r = totals(e_step(rows, p, effective).withColumn("all", F.lit(1)), ["all"], effective).first()
        p = m_step(np.array([r[f"t{i}"] for i in range(12)], float), alpha)
        out.append((float(r.ll), p))
    return out


def rotate(p: np.ndarray, k: int) -> np.ndarray:
    return np.asarray(p)[[(q + k) % 3 for q in range(3)]]


def flip(p: np.ndarray, effective_length: int) -> np.ndarray:
    """The parameters of the other strand for reads of this length."""
    p = np.asarray(p)
    return np.array([[p[(effective_length - 1 - q) % 3, _COMPLEMENT[b]] for b in range(4)] for q in range(3)])


@dataclass
class Canonical:
    p: np.ndarray
    rotation: int
    flipped: bool
    states: list[int]  # the new number of each state


def canonical(p: np.ndarray, effective_length: int, mode: str = "full6") -> Canonical:
    """The member of the model's symmetry class whose rounded parameters come first in order; states are renumbered alike."""
    if mode == "none":
        return Canonical(np.asarray(p), 0, False, list(range(6)))
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    found = None
    for flipped in (False, True) if mode == "full6" else (False,):
        start = flip(p, effective_length) if flipped else np.asarray(p)
        for k in range(3):
            q = rotate(start, k)
            key = tuple(np.round(q.ravel(), 12))
            if found is None or key < found[0]:
                states = []
                for s in range(6):
                    minus, offset = divmod(s, 3)
                    if flipped:
                        minus, offset = 1 - minus, -offset % 3
                    states.append(3 * minus + (offset - k) % 3)
                found = (key, Canonical(q, k, flipped, states))
    return found[1]


def renumbered(state: Column, states: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in states]), state + 1)


def gaps(assigned: DataFrame) -> DataFrame:
    """Adds runnerup (the first best of the other states), gap_ll, informative and gap_ll_per_base."""
    others = [F.when(F.col("state") == i, F.lit(float("-inf"))).otherwise(F.col(f"s{i}")) for i in range(6)]
    out = assigned.select("*", first_largest(others).alias("runnerup"), (F.col("ll") - F.greatest(*others)).alias("gap_ll"), informative().alias("informative"))
    return out.withColumn("gap_ll_per_base", F.col("gap_ll") / F.greatest("informative", F.lit(1)))


_QUANTILES = {"median": 0.5, "q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}


def summary(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys, more, mean, median, population deviation, minimum, quantiles and maximum of both gaps) of weighted rows."""
    w = F.col("weight")
    parts, joined = [], None
    for column in ("gap_ll", "gap_ll_per_base"):
        x = F.col(column)
        mean = F.sum(w * x) / F.sum(w)
        spread = F.sqrt(F.greatest(F.sum(w * x * x) / F.sum(w) - mean * mean, F.lit(0.0)))
        parts += [v.alias(f"{column}_{k}") for k, v in (("mean", mean), ("sd", spread), ("min", F.min(x)), ("max", F.max(x)))]
        found = quantiles.exact(rows, keys, column, {f"{column}_{k}": q for k, q in _QUANTILES.items()}, w)
        joined = found if joined is None else joined.join(found, keys)
    names = [f"{c}_{k}" for c in ("gap_ll", "gap_ll_per_base") for k in ("mean", "median", "sd", "min", "q05", "q25", "q75", "q95", "max")]
    sums = rows.groupBy(*keys).agg(*more, *parts)
    return sums.join(joined, keys).select([c for c in sums.columns if not c.startswith("gap_")] + names)


def gap_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n_reads, mean_informative_bases, three shares of small gaps, and both gaps' statistics, for each group."""
    w, gap = F.col("weight"), F.col("gap_ll")
    share = lambda c: F.sum(F.when(c, w).otherwise(0)) / F.sum(w)
    return summary(
        rows, keys, F.sum(w).alias("n_reads"), (F.sum(w * F.col("informative")) / F.sum(w)).alias("mean_informative_bases"),
        share(gap <= 1e-12).alias("fraction_tie_best_vs_runnerup"), share(gap < 0.1).alias("fraction_gap_lt_0p1"), share(gap < 1).alias("fraction_gap_lt_1"),
    )


def _names(lengths: DataFrame, column: str) -> DataFrame:
    return lengths.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("name")) for i, s in enumerate(STATES)])).alias("s")).select(
        *lengths.columns, F.col("s.i").alias(f"{column}_id"), F.col("s.name").alias(column)
    )


def by_state(rows: DataFrame) -> DataFrame:
    """(length, assigned_state, n_reads, statistics): six rows for each length, null statistics where a state is empty."""
    stats = summary(rows, ["length", "state"], F.sum("weight").alias("n"))
    frame = _names(rows.select("length").distinct(), "assigned_state")
    joined = frame.join(stats.withColumnRenamed("state", "assigned_state_id"), ["length", "assigned_state_id"], "left")
    return joined.withColumn("n_reads", F.coalesce("n", F.lit(0))).drop("n", "assigned_state_id")


def runner_up(rows: DataFrame) -> DataFrame:
    """(length, assigned_state, runnerup_state, count, prop_within_assigned): 30 rows for each length; the share of an empty state is null."""
    pairs = rows.groupBy("length", F.col("state").alias("assigned_state_id"), F.col("runnerup").alias("runnerup_state_id")).agg(F.sum("weight").alias("n"))
    frame = _names(_names(rows.select("length").distinct(), "assigned_state"), "runnerup_state").where("assigned_state_id <> runnerup_state_id")
    joined = frame.join(pairs, ["length", "assigned_state_id", "runnerup_state_id"], "left").withColumn("count", F.coalesce("n", F.lit(0)))
    whole = F.sum("count").over(Window.partitionBy("length", "assigned_state_id"))
    return joined.withColumn("prop_within_assigned", F.when(whole > 0, F.col("count") / whole)).select("length", "assigned_state", "runnerup_state", "count", "prop_within_assigned")


def uniformity(counts: list[Column], total: Column) -> tuple[Column, Column]:
    """(chi-square, p) of counts against equal shares."""
    k = len(counts)
    expected = total / F.lit(float(k))
    statistic = sum((c - expected) * (c - expected) / expected for c in counts)
    return statistic, chi_square_survival(statistic, k - 1)


def state_distribution(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of states, shifts and orientations with their chi-square tests, one row for each group."""
    w = F.col("weight")
    n = [F.sum(F.when(F.col("state") == i, w).otherwise(0)).alias(f"c{i}") for i in range(6)]
    t = rows.groupBy(*keys).agg(*n, F.sum("weight").alias("n_sequences"), (F.sum(w * F.col("informative")) / F.sum(w)).alias("mean_informative_bases"))
    c, total = [F.col(f"c{i}") for i in range(6)], F.col("n_sequences")
    shifts, sides = [c[i] + c[i + 3] for i in range(3)], [c[0] + c[1] + c[2], c[3] + c[4] + c[5]]
    tests = {}
    for name, parts in (("6states", c), ("3shifts", shifts), ("orientation", sides)):
        tests[f"chisq_{name}"], tests[f"p_{name}"] = uniformity(parts, total)
    named = {f"count_{s}": c[i] for i, s in enumerate(STATES)} | {f"prop_{s}": c[i] / total for i, s in enumerate(STATES)}
    named |= {f"count_shift{i}": s for i, s in enumerate(shifts)} | {f"prop_shift{i}": s / total for i, s in enumerate(shifts)}
    named |= {"prop_plus": sides[0] / total, "prop_minus": sides[1] / total}
    return t.select(*keys, "n_sequences", "mean_informative_bases", *[v.alias(k) for k, v in (tests | named).items()])


def base_table(length: int, effective_length: int, found: Canonical, mode: str = "full6") -> list[tuple]:
    """Rows (length, effective_length, position_class, base, prob, mode, rotation, flipped) of the parameters."""
    return [(length, effective_length, q, b, float(found.p[q, i]), mode, found.rotation, found.flipped) for q in range(3) for i, b in enumerate(STATE_BASES)]
