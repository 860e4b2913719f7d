"""Files held in a table: path, mtime, and text or content (bytes)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from seamline.fixed_values import EXCLUDED_FOLDERS, INCLUDE_EXTENSIONS
from seamline.functions.text import decode_utf8, unix_newlines
from seamline.operators.files import keep_files


class TableSource:
    """Any DataFrame with a unique `path`, an `mtime` and `text` or `content`."""

    def __init__(self, table: DataFrame, excluded: Iterable[str] = EXCLUDED_FOLDERS):
        self.table = table
        self.excluded = tuple(excluded)

    def listing(self, extensions: Iterable[str] = INCLUDE_EXTENSIONS) -> DataFrame:
        """path, mtime; the scan reads no other column than these."""
        kept = keep_files(self.table, extensions, self.excluded)
        return kept.select("path", F.col("mtime").cast("double").alias("mtime"))

    def _texts(self) -> DataFrame:
        if "text" in self.table.columns:
            text = F.col("text")
        else:
            text = decode_utf8(F.col("content"))
        return self.table.select("path", unix_newlines(text).alias("text"))

    def read(self, files: DataFrame) -> DataFrame:
        """`files` (with a unique `path`) plus `text`; null content stays null.

        Files that a written table lists are broadcast when Spark sees that it
        is small, so a run that touches little shuffles no other text.
        """
        return files.join(self._texts(), "path")

    def read_touched(self, touched: DataFrame, extensions: Iterable[str], all_of_them: bool) -> DataFrame:
        """path, text of the touched files.

        Where all files of the listing are touched, none needs to be looked up
        and the scan is all there is. Else the list is joined: broadcast while
        Spark sees that it is small, so that other text stays put.
        """
        if all_of_them:
            return keep_files(self._texts(), extensions, self.excluded)
        return touched.select("path").join(self._texts(), "path")
