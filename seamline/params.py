"""Job parameters: defaults, checks, and their one-row JSON table."""

from __future__ import annotations

import dataclasses

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from seamline import fixed_values as fixed
from seamline.work import literal_rows

_SCHEMA = (
    "model_name string, embedding_dim int, include_extensions array<string>, "
    "chunk_size_lines int, chunk_overlap_lines int"
)


@dataclasses.dataclass(frozen=True)
class IndexParams:
    """Any empty value (None, 0, "", []) stands for the default."""

    model_name: str | None = None
    embedding_dim: int | None = None
    include_extensions: tuple[str, ...] | None = None
    chunk_size_lines: int | None = None
    chunk_overlap_lines: int | None = None

    def __post_init__(self):
        defaults = {
            "model_name": fixed.MODEL_NAME,
            "embedding_dim": fixed.EMBEDDING_DIM,
            "include_extensions": fixed.INCLUDE_EXTENSIONS,
            "chunk_size_lines": fixed.CHUNK_SIZE_LINES,
            "chunk_overlap_lines": fixed.CHUNK_OVERLAP_LINES,
        }
        for name, default in defaults.items():
            object.__setattr__(self, name, getattr(self, name) or default)
        object.__setattr__(self, "include_extensions", tuple(self.include_extensions))

    def check(self, allowed_dims: tuple[int, ...] = fixed.EMBEDDING_DIMS) -> "IndexParams":
        if self.embedding_dim not in allowed_dims:
            raise ValueError(
                f"embedding_dim must be one of {list(allowed_dims)}, got {self.embedding_dim}"
            )
        if self.chunk_size_lines < 1 or self.chunk_overlap_lines < 0:
            raise ValueError("chunk_size_lines must be positive, chunk_overlap_lines not negative")
        if self.chunk_size_lines <= self.chunk_overlap_lines:
            raise ValueError("chunk_size_lines must exceed chunk_overlap_lines, or most lines are in no chunk")
        return self


def save_params(spark: SparkSession, params: IndexParams, path: str) -> None:
    row = dataclasses.asdict(params)
    row["include_extensions"] = list(params.include_extensions)
    literal_rows(spark, _SCHEMA, row).write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> IndexParams:
    try:
        row = spark.read.schema(_SCHEMA).option("mode", "FAILFAST").json(path).first()
    except AnalysisException as error:
        raise FileNotFoundError(f"no parameters at {path}") from error
    if row is None:
        raise FileNotFoundError(f"no parameters at {path}")
    return IndexParams(**row.asDict())
