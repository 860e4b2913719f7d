"""Which files are indexed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from seamline.fixed_values import EXCLUDED_FOLDERS, INCLUDE_EXTENSIONS
from seamline.functions.paths import has_extension, in_excluded_folder


def keep_files(
    files: DataFrame,
    extensions: Iterable[str] = INCLUDE_EXTENSIONS,
    excluded: Iterable[str] = EXCLUDED_FOLDERS,
) -> DataFrame:
    """Rows whose path has a wanted extension and lies in no excluded folder."""
    path = F.col("path")
    kept = files.where(has_extension(path, extensions))
    excluded = list(excluded)
    return kept.where(~in_excluded_folder(path, excluded)) if excluded else kept
