"""Discrete Fourier spectra of short windows, as sums over cycles and bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = 10, 39


def require_target(n: int, period: int = 3) -> int:
    """The bin of frequency 1/period; an error if the window has none at exactly that frequency."""
    if n % period:
        raise ValueError(f"a window of {n} cycles has no bin at frequency 1/{period}")
    return n // period


def spectrum(cells: DataFrame, keys: list[str], *, value: str = "x", start: int = START, end: int = END) -> DataFrame:
    """(keys, bin, frequency, magnitude): absolute sums over the window divided by its number of cycles.

    ``cells`` has a row for each cycle of a group. A bin sees every cycle of a group once; nothing but sums is shuffled.
    """
    n = end - start + 1
    inside = cells.where(F.col("cycle").between(start, end))
    bins = inside.select(*keys, "cycle", F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("bin"))
    angle = F.lit(2 * math.pi / n) * F.pmod((F.col("cycle") - start) * F.col("bin"), F.lit(n))
    sums = bins.groupBy(*keys, "bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"), F.count(F.lit(1)).alias("cycles"))
    checked = F.when(F.col("cycles") == n, F.hypot("re", "im") / n).otherwise(F.raise_error(F.lit("the window has cycles that the table lacks")).cast("double"))
    return sums.select(*keys, "bin", (F.col("bin") / F.lit(float(n))).alias("frequency"), checked.alias("magnitude"))


def spectral_r2(cells: DataFrame, keys: list[str], *, value: str = "x", start: int = START, end: int = END, period: int = 3) -> DataFrame:
    """(keys, magnitude, r2): the share of the window's variance at frequency 1/period, 0 for a flat window."""
    n = end - start + 1
    target = require_target(n, period)
    peak = spectrum(cells, keys, value=value, start=start, end=end).where(F.col("bin") == target).select(*keys, "magnitude")
    spread = cells.where(F.col("cycle").between(start, end)).groupBy(*keys).agg(F.var_pop(value).alias("variance"), F.max(F.abs(value)).alias("largest"))
    factor = 1.0 if 2 * target == n else 2.0
    noise = F.pow(F.lit(n * 2.0**-52) * F.col("largest"), 2)
    r2 = F.when(F.col("variance") <= noise, 0.0).otherwise(F.least(F.lit(factor) * F.pow("magnitude", 2) / F.col("variance"), F.lit(1.0)))
    return peak.join(spread, keys).select(*keys, "magnitude", r2.alias("r2"))


def strongest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The bin of the largest magnitude above frequency 0, the lowest of equal ones."""
    order = Window.partitionBy(*keys).orderBy(F.desc("magnitude"), "bin")
    return rows.where("bin > 0").withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
