"""From raw documents to a training mix: each stage applies one operator and hands its rows to the next as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcycle.llm import disclosure, lshforest, nbsvm, poissonmix, spacedseeds
from seqcycle.llm.common import written


def _shielded(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of the given names under other ones, and how to name them back."""
    back = {f"{name}_of_documents": name for name in names if name in docs.columns}
    return docs.withColumnsRenamed({v: k for k, v in back.items()}), back


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: a score of 0.5 or more.

    A null text counts as empty, and empty texts get the score of the intercept; equal texts are accepted or rejected alike. An empty table stays empty.
    """
    shielded, back = _shielded(docs, ("score", "predicted"))
    scored = nbsvm.quality(shielded, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").drop("score", "predicted").withColumnsRenamed(back).select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the smallest doc_id (without doc_id only if none has one).

    Rows are told apart by doc_id and text, so different texts under one doc_id stay, and repeated rows stay once. Null and empty texts are like nothing else,
    so each doc_id keeps one of either. Of a group, equal doc_ids are told apart by a hash of doc_id and text.
    """
    docs, back = _shielded(docs, ("dedup_key",))
    names = docs.columns
    keyed = docs.withColumn("dedup_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    groups = lshforest.near_duplicates(keyed.select(F.col("dedup_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("dedup_key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "dedup_key")
    kept = keyed.select("dedup_key", "doc_id").join(groups, "dedup_key").groupBy("component_id").agg(F.min_by("dedup_key", order).alias("dedup_key")).select("dedup_key")
    rows = keyed.join(kept, "dedup_key", "left_semi").dropDuplicates(["dedup_key"])
    return rows.select(names).withColumnsRenamed(back)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; null and empty texts overlap none, and repeated rows stay or go alike."""
    return spacedseeds.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms generalised and ``n_chars`` measured again.

    A null text stays null, and so does its ``n_chars``; overlapping spans become one, of the kind that starts first.
    """
    shielded, back = _shielded(docs, ("base", "terms", "sanitised", "text_key"))
    clean = disclosure.sanitised(shielded).withColumn("text", F.col("sanitised")).withColumn("n_chars", F.length("text").cast("long"))
    return clean.drop("base", "terms", "sanitised").withColumnsRenamed(back).select(docs.columns)


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: copies of documents such that every source weighs the same, in shuffled order.

    A null source is a source of its own. Rows of equal doc_id draw alike; a null doc_id draws as the text ``null``.
    """
    return poissonmix.mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii),
    ("mixing sources to target weights", mixing_to_target_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``; columns that are not the stages' own pass through all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs


#: Training a classifier, signatures and audits have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
