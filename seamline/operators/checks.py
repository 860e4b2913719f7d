"""Consistency checks; each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def orphan_vectors(vectors: DataFrame, live: DataFrame) -> DataFrame:
    """Ids of vectors that no live chunk refers to."""
    return vectors.select("vector_id").join(live.select("vector_id"), "vector_id", "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Values of `key` that occur more than once, with their number.

    Counts are summed before the shuffle, so a hot value costs one row per task.
    """
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def broken_references(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose file is not in the manifest."""
    return chunks.join(files.select("path"), "path", "left_anti")
