"""The corpus pipeline: five stages over `documents`, each written and read again.

Every stage works on all that the one before kept. All but the last return the
columns of `documents`; columns they do not name pass through.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import seamline
from seamline.functions.text import decode_utf8
from seamline.llm import bpe, decontamination, ngram_join, quality_knn, suffix_dedup
from seamline.llm.texts import free_name, small_batches
from seamline.work import written

cloudpickle.register_pickle_by_value(seamline)

#: The rule of this stage; that of the query op1_ngram_join (4 words, 85 percent) is its own.
NEAR_COPIES = ngram_join.Similarity(width=5, percent=80)

#: The rule of this stage; that of the query op3_suffix_dedup (400 bytes) is its own. 50 words of prose seldom have under 200 bytes.
REPEATED = suffix_dedup.Passages(length=200, key=50, words=50)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote of nearest neighbours rejects go; without labels none does."""
    model = quality_knn.fit_neighbours(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "score")
    return quality_knn.with_scores(docs, model, score).where(F.col(score) >= quality_knn.ACCEPT).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the n-gram join (5-word shingles, Jaccard of 0.8 or more) the one with the smallest doc_id stays.

    A row that repeats both doc_id and text goes too. Rows without a doc_id, and
    texts without words, are in no group and stay.
    """
    found = ngram_join.jaccard_components(docs, NEAR_COPIES)
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionAll(once)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words, or of 400 bytes, are cut from the texts; what is left of a cut character goes too. n_chars follows.

    A text that holds an item of the benchmark is not cut: its document is for the next stage to see.
    """
    made = tuple(free_name(docs.columns, name) for name in suffix_dedup.MADE)
    kept, _, removed, _ = made
    held = decontamination.found_texts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    cut = suffix_dedup.remove_repeats(docs, made, REPEATED, spared=held)
    whole = F.col("text").isNull() | (F.col(removed) == 0)
    out = cut.withColumn("text", F.when(whole, F.col("text")).otherwise(decode_utf8(F.col(kept))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, or nearly, go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed, little-endian unsigned 32-bit) and the text decoded from them."""
    # Written in between, so that a task needs one Python worker at a time.
    with small_batches(spark):
        encoded = written(bpe.encode_documents(docs, TOKENIZER))
    decoded = bpe.decode_documents(encoded, TOKENIZER)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality_knn", good_quality),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("bpe", tokenized),
]

#: No stage can be said in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
