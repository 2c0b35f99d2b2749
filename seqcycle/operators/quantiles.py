"""Exact quantiles of weighted values by group, without a task that holds a group.

A quantile lies between two order statistics. The place of each is narrowed by counting: a range of values is cut into ``BUCKETS`` equal parts, a grouped sum tells the
weight, least and largest value of each, and the part in which the wanted rank falls becomes the next range, from its least to its largest value, until that is one value.
Sums are made in each task before a shuffle, so a pass sends on at most ``BUCKETS`` rows for each range and task, whatever the size of a group or however many rows share one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BUCKETS, FEW, MAX_PASSES = 1024, 1_000_000, 250


def _ranks(rows: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, rank, low, high, below): for each order statistic that a quantile needs, the range it lies in and the weight below that."""
    whole = rows.groupBy(*keys).agg(F.sum("w").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    at = [(F.col("n") - 1) * F.lit(q) for q in shares]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    return whole.select(*keys, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"))


def _narrowed(rows: DataFrame, keys: list[str], ranks: DataFrame, buckets: int) -> DataFrame:
    """The ranges of ``ranks`` after one more pass over ``rows``."""
    place = [*keys, "low", "high"]
    ranges = ranks.where("low < high").select(*place, "below").distinct()
    half = F.when(F.col("high") - F.col("low") == float("inf"), 0.5).otherwise(1.0)  # else the widest ranges have no width
    share = (F.col("x") * half - F.col("low") * half) / (F.col("high") * half - F.col("low") * half)
    part = F.least(F.floor(share * buckets), F.lit(buckets - 1))  # a range's ends fall into different parts, so it shrinks
    inside = rows.join(ranges, keys).where(F.col("x").between(F.col("low"), F.col("high")))
    parts = inside.groupBy(*place, "below", part.alias("part")).agg(F.sum("w").alias("w"), F.min("x").alias("least"), F.max("x").alias("most"))
    upto = Window.partitionBy(*place, "below").orderBy("part")  # at most ``buckets`` rows
    ends = parts.withColumn("end", F.col("below") + F.sum("w").over(upto)).withColumn("start", F.col("end") - F.col("w"))
    found = ranks.where("low < high").join(ends, [*place, "below"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
    done = ranks.where("low = high")
    return done.unionByName(found.select(*keys, "rank", F.col("least").alias("low"), F.col("most").alias("high"), F.col("start").alias("below")))


def exact(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], weight: Column | None = None, *, few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(keys, one column for each name of ``shares``): quantiles with linear interpolation between the values of a group, each counted ``weight`` times.

    Values that are null or no numbers do not count. Groups of up to ``few`` rows are left to the engine's own aggregate, which holds the values of a group in one task.
    """
    given = rows.select(*keys, F.col(value).alias("x"), (F.lit(1) if weight is None else weight).cast("long").alias("w")).where("x is not null and not isnan(x) and w > 0")
    largest = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
    if largest <= few:
        return given.groupBy(*keys).agg(*[F.percentile("x", F.lit(q), F.col("w")).alias(name) for name, q in shares.items()])
    ranks = written(_ranks(given, keys, list(shares.values())), "ranks")
    for _ in range(MAX_PASSES):
        if not ranks.where("low < high").limit(1).count():
            break
        ranks = written(_narrowed(given, keys, ranks, buckets), "ranks")
    else:
        raise ValueError(f"ranges are not single values after {MAX_PASSES} passes")
    values = ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at"))  # two for each share
    sizes = given.groupBy(*keys).agg(F.sum("w").alias("n"))
    out = []
    for name, q in shares.items():
        place = (F.col("n") - 1) * F.lit(q)
        low, high = (F.element_at("at", f(place).cast("long")) for f in (F.floor, F.ceil))
        out.append((low + (place - F.floor(place)) * (high - low)).alias(name))
    return sizes.join(values, keys).select(*keys, *out)
