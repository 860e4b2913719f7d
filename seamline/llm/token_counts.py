"""Exact length histogram: totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seamline.llm.bpe import remembered, worker_memory
from seamline.llm.library_tokens import LibraryEncoder
from seamline.llm.texts import text_slices
from seamline.work import written

#: Lengths of a block are summed in one task; blocks are few: the longest length over this.
BLOCK = 256


def token_lengths(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens of every document; a null or empty text has none."""
    shared = worker_memory(documents, tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(shared.value, LibraryEncoder)
        for batch in batches:
            for part in text_slices(batch):
                sizes = [len(ids) // encoder.kind.itemsize for ids in encoder.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])
        encoder.known.clear()  # the worker goes on to other tasks

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per encoded length that occurs, taken as a context limit.

    n_tokens (the limit), n_docs of just this length, docs_within and
    tokens_within (documents that fit), docs_beyond, truncated_tokens (ids left
    when every document is cut to the limit), lost_tokens, and quantile (the
    share of documents that fit). Counts are exact; no documents, no rows.

    Sums run over blocks of lengths and then inside each block, so no task sees
    more than `BLOCK` lengths or one row per block.
    """
    counts = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    upwards, below = Window.orderBy("block"), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = upwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(below), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(below), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    within = counts.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_within"),
        (F.col("tokens_before") + F.sum("tokens").over(inside)).alias("tokens_within"),
    )
    beyond = F.col("all_docs") - F.col("docs_within")
    truncated = F.col("tokens_within") + F.col("n_tokens") * beyond
    return within.select(
        "n_tokens", "n_docs", "docs_within", "tokens_within", beyond.alias("docs_beyond"),
        truncated.alias("truncated_tokens"), (F.col("all_tokens") - truncated).alias("lost_tokens"),
        (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """`limits` (column context) with docs_within, tokens_within, docs_beyond, truncated_tokens at any limit, seen or not.

    Limits are a short list that the caller writes; they are few next to the lengths.
    """
    per = histogram.join(limits.select("context").distinct(), F.col("n_tokens") <= F.col("context"))
    top = per.groupBy("context").agg(F.max_by(F.struct("n_tokens", "docs_within", "tokens_within", "docs_beyond"), "n_tokens").alias("h"))
    total = histogram.agg(F.sum("n_docs").alias("all_docs"))
    out = limits.select("context").distinct().join(top, "context", "left").join(total)
    docs, tokens = (F.coalesce(F.col(f"h.{c}"), F.lit(0)) for c in ("docs_within", "tokens_within"))
    beyond = F.col("all_docs") - docs
    return out.select(
        "context", docs.alias("docs_within"), tokens.alias("tokens_within"), beyond.alias("docs_beyond"),
        (tokens + F.col("context") * beyond).alias("truncated_tokens"),
    )
