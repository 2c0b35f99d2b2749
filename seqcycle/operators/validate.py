"""Checks of whole tables: each counts its violations in one pass and raises if there are any."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: set[str], what: str) -> None:
    missing = sorted(names - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """``df``, after a check that ``holds`` is true in every row."""
    bad = df.where(~F.coalesce(holds, F.lit(False))).agg(F.count(F.lit(1))).first()[0]
    if bad:
        raise ValueError(f"{message} ({bad} rows)")
    return df


def require_unique(df: DataFrame, keys: list[str], what: str, *, skip_null: bool = False) -> DataFrame:
    """``df``, after a check that no two rows share their keys; rows with a null key may be left out of it."""
    rows = df.where(~reduce(or_, [F.col(k).isNull() for k in keys])) if skip_null else df
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(*keys).limit(10).collect()
    if found:
        raise ValueError(f"{what} is not unique in {keys} (examples: {', '.join(str(tuple(r)[:-1]) for r in found)})")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows share, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def incomplete_groups(df: DataFrame, keys: list[str], column: str, expected: list[str]) -> DataFrame:
    """Groups whose values of ``column`` are not exactly the expected ones, each once."""
    got = df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(column)), "").alias("found"))
    return got.where(F.col("found") != "".join(sorted(expected)))
