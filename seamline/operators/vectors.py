"""Adding, deleting and counting stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline.functions.vectors import checked_dim, cut, l2_normalise


def normalised(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors ready to be stored: length checked, unit length, float32."""
    return vectors.withColumn(
        "embedding", l2_normalise(checked_dim(F.col("embedding"), dim))
    )


def cut_vectors(vectors: DataFrame, dim: int, allowed_dims: tuple[int, ...]) -> DataFrame:
    """The leading `dim` components, normalised again; `dim` must be an allowed one."""
    if dim not in allowed_dims:
        raise ValueError(f"dim must be one of {list(allowed_dims)}, got {dim}")
    return normalised(vectors.withColumn("embedding", cut(F.col("embedding"), dim)), dim)


def add_vectors(stored: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Stored vectors followed by the new ones; ids must not be null."""
    no_id = F.raise_error(F.lit("a vector has no id"))
    ready = normalised(new, dim).withColumn("vector_id", F.coalesce(F.col("vector_id"), no_id.cast("long")))
    return stored.unionByName(ready.select(*stored.columns))


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors whose id is not listed in `ids`."""
    return vectors.join(ids.select("vector_id"), "vector_id", "left_anti")
