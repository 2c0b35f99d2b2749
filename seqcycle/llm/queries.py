"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import disclosure, filteraudit, hnsw, lshforest, nbsvm, oracles, orctokens, poissonmix, seekwarc, separators, spacedseeds, textdensity, urltrees


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seekwarc.round_trip(table(spark, sf_dir, "pages"))


def op2_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents"))


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spacedseeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = disclosure.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spelt = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", spelt)
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    counts = [F.size(_of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in disclosure.KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def _of_kind(kind: str):
    return F.filter("base", lambda s: s["kind"] == kind)


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poissonmix.mixed(table(spark, sf_dir, "documents"))


def op7_hnsw_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_text_density_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textdensity.extracted(table(spark, sf_dir, "pages"))


def op9_url_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URLs are those under a rule (class 1 if it blocks them, else 0); what rules name is masked, and URLs without a rule are unlabelled."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, says = urltrees.rule(urltrees.host(F.col("url")), urltrees.path(F.col("url")))
    labelled = pages.select("url", F.when(says == "block", 1).when(says == "allow", 0).alias("label")).where("label is not null")
    return urltrees.judged(pages, urltrees.train(labelled, masked=urltrees.named_by()))


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    return nbsvm.quality(docs, table(spark, sf_dir, "labels")).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orctokens.digests(orctokens.write(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_seekable_warc": op1_seekable_warc,
    "op2_minhash_lsh_forest": op2_minhash_lsh_forest,
    "op3_spaced_seed_decontamination": op3_spaced_seed_decontamination,
    "op4_disclosure_pii": op4_disclosure_pii,
    "op5_separator_scan": op5_separator_scan,
    "op6_poisson_mix": op6_poisson_mix,
    "op7_hnsw_embedding_dedup": op7_hnsw_embedding_dedup,
    "op8_text_density_extraction": op8_text_density_extraction,
    "op9_url_boosted_trees": op9_url_boosted_trees,
    "op10_nbsvm_quality": op10_nbsvm_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_orc_token_ids": op12_orc_token_ids,
}

ORACLE_SQL: dict[str, str] = {
    "op1_seekable_warc": oracles.OP1,
    "op2_minhash_lsh_forest": oracles.OP2,
    "op3_spaced_seed_decontamination": oracles.OP3,
    "op4_disclosure_pii": oracles.OP4,
    "op6_poisson_mix": oracles.OP6,
    "op7_hnsw_embedding_dedup": oracles.OP7,
    "op11_filter_audit": oracles.OP11,
}
