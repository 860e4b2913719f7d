"""Counts of a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline.sources.store import IndexStore


def table_counts(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: file_count, chunk_count, vector_count."""
    names = ["file_count", "chunk_count", "vector_count"]

    def ones(table: DataFrame, mine: str) -> DataFrame:
        return table.select(*[F.lit(int(name == mine)).cast("bigint").alias(name) for name in names])

    rows = ones(files, names[0]).unionAll(ones(chunks, names[1])).unionAll(ones(vectors, names[2]))
    return rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])


def index_stats(store: IndexStore) -> DataFrame:
    """Counts and parameters of a stored index, all of one snapshot; chunks are those in use.

    model_name is the model that made the vectors, or the one in the parameters
    while there are none.
    """
    store = store.at()
    params = store.params()
    files = store.files().agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunk_count")
    )
    vectors = store.vectors().agg(F.count("*").alias("vector_count"))
    return files.join(vectors).select(
        F.lit(store.path).alias("path"),
        F.lit(store.state().embedder or params.model_name).alias("model_name"),
        F.lit(params.embedding_dim).alias("embedding_dim"),
        "file_count", "chunk_count", "vector_count",
        F.lit(params.chunk_size_lines).alias("chunk_size_lines"),
        F.lit(params.chunk_overlap_lines).alias("chunk_overlap_lines"),
    )
