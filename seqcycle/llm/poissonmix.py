"""Mixing sources to target weights by Poisson replication.

A source's rate is its target weight times the number of rows over its own number of rows, so the mix has about as many
rows as the input. Each row is repeated as often as an inverted Poisson distribution with that mean says for a uniform
number hashed from seed and doc_id: the count is the number of cumulative probabilities at or below it. Rates above
``CHUNK`` are sums of independent draws of at most that mean, so that no probability underflows. Rates are
joined as the engine sees fit by their written size: broadcast where few sources fit the session's bound, else by a sort-merge
join whose hot source adaptive execution splits. The copies are dealt to equal ranges of
a hash of seed, doc_id and copy and sorted by it, which is the global shuffle; its keys are uniform, so no task gets more than its share.

Draws depend on seed and doc_id alone: a lost task makes the same rows again.

Defined results: a null source is a source of its own, named ``""`` among the weights. Sources without a weight get none
of the mix; without ``weights``, all sources weigh the same. Repeated rows and rows with equal doc_id draw alike; a null
doc_id draws as the text ``null``. Null and empty texts are rows as any. Columns named as those added give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SEED, CHUNK = 17, 16.0
#: 60 cumulative probabilities reach past 1 - 2**-48, the largest uniform number, at means up to CHUNK.
_TERMS = 60


def uniform(*parts: Column) -> Column:
    """48 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(source_key, rate, parts, cumulative): each source's mean number of copies, the number of independent draws that
    it is the sum of, and the cumulative probabilities of one such draw.
    """
    counts = written(docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source_key")).agg(F.count(F.lit(1)).alias("rows")), "sources")
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source_key string, weight double")
        weighed = counts.join(given, "source_key")
    everything = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    weight = weighed.agg(F.coalesce(F.sum("weight"), F.lit(1.0))).first()[0]
    rate = weighed.select("source_key", (F.col("weight") / weight * everything / F.col("rows")).alias("rate"))
    rate = rate.withColumn("parts", F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + term)).alias("sums"))

    sums = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS - 1)), start, step, lambda s: s["sums"])
    return written(rate.withColumn("cumulative", sums), "rates")


def draws(key: Column, seed: int) -> Column:
    """A Poisson number by the columns of ``rates``, the same for equal ``key``."""

    def one(part: Column) -> Column:
        u = uniform(F.lit(str(seed)), F.lit("draw"), key, part.cast("string"))
        return F.size(F.filter("cumulative", lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda total, part: total + one(part))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, *, seed: int = SEED) -> DataFrame:
    """The copies of all rows in shuffled order, with ``copy`` (from 1), ``copies`` and ``shuffle_key`` added."""
    names = [n for n in docs.columns if n not in ("copy", "copies", "shuffle_key", "source_key", "rate", "parts", "cumulative")]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rate = rates(docs, weights)
    keyed = docs.select(*names, F.coalesce(F.col("source"), F.lit("")).alias("source_key"))
    drawn = keyed.join(rate, "source_key").withColumn("copies", draws(key, seed))
    copies = drawn.where("copies > 0").select(*names, "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    shuffled = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("shuffle"), key, F.col("copy").cast("string"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # keys are uniform, so their ranges need no sampling
    at = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") * n / (1 << 32)).cast("int")
    return shuffled.repartitionById(n, at).sortWithinPartitions("shuffle_key")
