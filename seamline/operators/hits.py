"""Hits to result rows: chunk, file, text, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamline.fixed_values import READ_ERROR
from seamline.functions.text import join_range, preview, split_lines, text_block

RESULT_COLUMNS = (
    "query_id", "rank", "file_path", "start_line", "end_line", "score", "language", "content",
)


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the chunk of their vector; a hit without one is dropped.

    Hits are few and narrow. When they are a written table the planner knows
    their size and broadcasts them below its threshold, so chunk text is not
    shuffled; above it this is an ordinary shuffle join.
    """
    return hits.join(chunks, "vector_id")


def with_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with the language of their file; dropped unless the file is there
    in the version the chunk was cut from."""
    key = ["path", "file_version"]
    return found.join(files.select(*key, "language"), key)


def hydrate(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    return with_files(with_chunks(hits, chunks), files)


def attach_content(found: DataFrame, source: DataFrame) -> DataFrame:
    """Content by stored line numbers from the texts as they are now.

    source: path, text. A path that is gone, or whose text is null, gives an
    error text, a range past the end gives "". A path's distinct ranges form one
    array, so that its text is joined and split once; what is joined back is the
    cut-out.
    """
    spot = ["path", "start_line", "end_line"]
    ranges = found.groupBy("path").agg(F.collect_set(F.struct("start_line", "end_line")).alias("ranges"))
    split = source.where(F.col("text").isNotNull()).join(ranges, "path").select(
        "path", "ranges", split_lines(F.col("text")).alias("lines"), F.col("text").endswith("\n").alias("closed")
    )

    def cut(spot: Column) -> Column:
        start, end = spot["start_line"], spot["end_line"]
        content = join_range(F.col("lines"), start, end, F.col("closed"))
        return F.struct(start.alias("start_line"), end.alias("end_line"), content.alias("content"))

    cut_out = split.select("path", F.inline(F.transform("ranges", cut)))
    lost = F.format_string(READ_ERROR, F.concat(F.lit("cannot read "), F.col("path")))
    others = [c for c in found.columns if c != "content"]
    return found.select(*others).join(cut_out, spot, "left").select(
        *others, F.coalesce("content", lost).alias("content")
    )


def result_rows(found: DataFrame) -> DataFrame:
    """The public columns of a result."""
    renamed = found.withColumnRenamed("path", "file_path")
    if "content" not in renamed.columns:
        renamed = renamed.withColumnRenamed("text", "content")
    return renamed.select(*RESULT_COLUMNS)


def json_rows(results: DataFrame) -> DataFrame:
    """Result rows with the score to four places, for a JSON sink."""
    return results.withColumn("score", F.round("score", 4))


def text_rows(results: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Adds `block`, the printable form with content cut to `max_lines`."""
    content: Column = preview(F.col("content"), max_lines)
    return results.withColumn(
        "block",
        text_block(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("score"), content),
    )


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object per result, in query and rank order."""
    fields = ["file_path", "start_line", "end_line", "score", "language", "content"]
    ordered = json_rows(results).orderBy("query_id", "rank")
    ordered.select("query_id", "rank", *fields).write.option("ignoreNullFields", "false").json(path)


def write_text(results: DataFrame, path: str, max_lines: int | None = None) -> None:
    """Printable blocks as text files, in query and rank order."""
    ordered = text_rows(results, max_lines).orderBy("query_id", "rank")
    ordered.select("block").write.text(path)
