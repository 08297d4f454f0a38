"""The registered query of each operator, and its SQL answer where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varve.llm import clustering, ctw, decontaminate, exactdup, fingerprints, language, licenses, mixing, neardup, quality, sharding, tokens, whitening

#: Vocabulary file of op2; public_tokenizers finds it on any machine.
VOCABULARY = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(documents(spark, sf_dir))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(documents(spark, sf_dir), size=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_digest(embeddings(spark, sf_dir))


def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_source_mix": op3_source_mix,
    "op4_context_tree": op4_context_tree,
    "op5_decontamination": op5_decontamination,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_shards": op7_shards,
    "op8_licenses": op8_licenses,
    "op9_fingerprints": op9_fingerprints,
    "op10_language": op10_language,
    "op11_clusters": op11_clusters,
    "op12_exact_duplicates": op12_exact_duplicates,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {"op3_source_mix": mixing.MIX_SQL, "op11_clusters": clustering.cluster_sql(), "op12_exact_duplicates": exactdup.DEDUP_SQL}
