"""Thin queries of the corpus operators: each runs its operator over the whole of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, mixing, near_dedup, packing, prefix_trie, quality_model, quality_rules, repeats, sharding, tokens, toxicity, whitening
from .scratch import bounded_batches, documents, labels

#: The tokenizer that the queries use; operators take any file as a parameter.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.repeats_removed(documents(spark, sf_dir))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), TOKENIZER)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(*columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return mixing.mix(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(*columns)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_quality_model": op1_quality_model,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_repeats": op3_repeats,
    "op4_near_dedup": op4_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_license_scan": op11_license_scan,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_repeats": repeats.OP3_SQL,
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_license_scan": licenses.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
