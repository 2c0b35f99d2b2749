"""Interaction of quality filters: what each removes in every order of application, from a histogram of failure masks.

Whether a filter fails a document does not depend on the order in which filters run, so one scan suffices: expressions of
the engine give each document a mask with a bit for every filter that it fails, and the number of documents of each mask
says what any order removes at any step. Five filters make 32 cells for each part (source); their 120 orders are
enumerated from those cells, never from documents.

Four filters look at the text alone. The fifth fails copies: texts are grouped by their SHA-256 with the smallest
doc_id of each, and a document fails unless it is that one. Rows meet their group's smallest doc_id by doc_id and
digest together, so that a text which a third of all documents share is spread over all tasks; groups and cells are summed in
each task before they are shuffled. Texts are read once: what follows works on a written table of doc_id, part, mask and digest.

Defined results: null texts count as empty, and empty texts are copies of each other. A null part is the empty one. A null
doc_id is not smaller than any other and has no labels, and its row is never a copy; rows of equal doc_id and text stand or
fall together. Of several labels of a doc_id, one of 1 is enough. Words and letters are compared by their bytes. An empty
table has no parts, so no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
WORD, CAPITAL, SYMBOL = r"[^\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"
COPIES = "E"


def _long(count: Column) -> Column:
    return count.cast("long")


#: Of each filter on texts, the condition on (text, its words) under which a document fails.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < MIN_WORDS,
    "B": lambda text, words: _long(F.size(F.array_distinct(words))) * 100 < _long(F.size(words)) * MIN_DISTINCT,
    "C": lambda text, words: _long(F.regexp_count(text, F.lit(CAPITAL))) * 100 > _long(F.length(text)) * MAX_CAPITALS,
    "D": lambda text, words: text.rlike(SYMBOL),
}


def _if(condition: Column, value: int = 1) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0))


def masked(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, *, part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row: bit i is set if it fails the i-th filter; the bit after those, if its text is that of a smaller doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    bits = sum((_if(fails(F.col("text"), words), 1 << i) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = written(given.select("doc_id", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + _if(copy, 1 << len(filters))).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the number of documents of each mask, and how many of them are labelled good and toxic."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(_if(F.col("quality") == 1)).alias("good"), F.max(_if(F.col("toxic") == 1)).alias("toxic"))
    rows = masks.join(marks, "doc_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)


def _led(mask: Column, filters: int) -> Column:
    """In how many orders of the filters a given one of those in ``mask`` comes before the others of it."""
    return F.element_at(F.array(*[F.lit(factorial(filters) // k) for k in range(1, filters + 1)]), F.bit_count(mask))


def interactions(histogram: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the cells of ``cells``; bit i of a mask is the i-th letter.

    A part has at most 2 ** len(letters) cells, which one row holds. A filter's removals summed over all orders follow from its share in
    each cell: of the orders, those in which it comes first among the filters that the cell's documents fail.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    packed = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 of five filters
    steps = packed.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    earlier = F.substr("filter_order", F.lit(1), F.col("at"))
    steps = steps.select(
        "part", "cells", "filter_order", (F.col("at") + 1).alias("step"), sum((_if(F.contains(earlier, F.lit(x)), 1 << i) for i, x in enumerate(letters)), F.lit(0)).alias("before"),
        sum((_if(F.col("letter") == x, 1 << i) for i, x in enumerate(letters)), F.lit(0)).alias("own"),
    )
    before, own = F.col("before"), F.col("own")

    def total(condition: Callable[[Column], Column], value: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(condition(c["mask"]), c[value]).otherwise(0))

    def fails(mask: Column, bits: Column) -> Column:
        return mask.bitwiseAND(bits) != 0

    removed = lambda m: fails(m, own) & ~fails(m, before)
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(fails(c["mask"], own), c["n"] * _led(c["mask"], len(letters))).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", total(lambda m: ~fails(m, own) & ~fails(m, before)).alias("kept"), total(removed).alias("removed"),
        total(lambda m: fails(m, own) & fails(m, before)).alias("redundant"), total(lambda m: m == own).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, *, part: str = "source") -> DataFrame:
    """The interactions of the given filters and of the one that fails copies, which comes last in the letters."""
    return interactions(cells(masked(docs, filters, part=part), labels), "".join(filters) + COPIES)
