"""Registered queries of this package: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seamline.llm import (
    bpe, decontamination, divergence, language_id, licenses, merkle, ngram_join, quality_knn, quality_rules, suffix_dedup,
    token_counts, token_files, toxicity,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    """All pairs of a document and a benchmark item found in it."""
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark, sf_dir):
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op6_token_files(spark, sf_dir):
    return token_files.read_documents(token_files.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), TOKENIZER)
    return token_counts.length_histogram(lengths)


def op10_quality_knn(spark, sf_dir):
    return quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_license_scan(spark, sf_dir):
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest_digests(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_bpe": op2_bpe,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_language_id": op5_language_id,
        "op6_token_files": op6_token_files,
        "op7_toxicity": op7_toxicity,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_quality_knn": op10_quality_knn,
        "op11_license_scan": op11_license_scan,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_source_divergence": op13_source_divergence,
    }
