"""Semantic search over large collections of text files, as PySpark jobs."""

from seamline.params import IndexParams

__all__ = ["IndexParams"]
