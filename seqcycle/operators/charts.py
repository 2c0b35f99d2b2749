"""What charts show, as tables in long form: a row for each mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import kmer_tokens
from .em import STATES


def _long(table: DataFrame, keys: list[str], series: str, marks: dict[str, str], value: str) -> DataFrame:
    """(keys, series, value): the columns ``marks`` (by the name in the chart) under each other."""
    each: list[Column] = [F.struct(F.lit(name).alias(series), F.col(f"`{column}`").cast("double").alias(value)) for name, column in marks.items()]
    return table.select(*keys, F.explode(F.array(*each)).alias("m")).select(*keys, f"m.{series}", f"m.{value}")


def kmer_profile(fractions: DataFrame, k: int) -> DataFrame:
    """(length, cycle, kmer, fraction) of the wide table of fractions."""
    return _long(fractions, ["length", "cycle"], "kmer", {t: t for t in kmer_tokens(k)}, "fraction")


def em(distribution: DataFrame) -> dict[str, DataFrame]:
    """Shares by length of the six states (bars and heat map), the three shifts, and the two orientations."""
    return {
        "states": _long(distribution, ["length"], "state", {s: f"prop_{s}" for s in STATES}, "share"),
        "shifts": _long(distribution, ["length"], "shift", {str(i): f"prop_shift{i}" for i in range(3)}, "share"),
        "orientation": _long(distribution, ["length"], "orientation", {"+": "prop_plus", "-": "prop_minus"}, "share"),
    }


def comparison(one: DataFrame, two: DataFrame) -> DataFrame:
    """(profile, base, phase, mean) of two tables of phase means."""
    sides = [t.select(F.lit(name).alias("profile"), "base", "phase", "mean") for name, t in (("one", one), ("two", two))]
    return sides[0].unionByName(sides[1])
