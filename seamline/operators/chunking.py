"""Files to overlapping line-range chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamline.functions.text import count_lines, join_range, split_lines


def check_sizes(size: int, overlap: int, first_only: bool) -> None:
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    if first_only != (size <= overlap):
        raise ValueError("first_only is for, and needed with, a size that does not exceed the overlap")


def chunk_count(n_lines: Column, size: int, overlap: int, first_only: bool = False) -> Column:
    """How many chunks `chunk_lines` makes of a file with that many lines."""
    check_sizes(size, overlap, first_only)
    if first_only:
        return F.when(n_lines > 0, 1).otherwise(0)
    return F.ceil(n_lines / (size - overlap)).cast("int")


def count_chunks(files: DataFrame, size: int, overlap: int, first_only: bool = False) -> DataFrame:
    """Replaces `text` by `n_chunks`; counts newline bytes, splits nothing."""
    others = [c for c in files.columns if c != "text"]
    n_lines = count_lines(F.col("text"))
    return files.select(*others, chunk_count(n_lines, size, overlap, first_only).alias("n_chunks"))


def chunk_lines(files: DataFrame, size: int, overlap: int, first_only: bool = False) -> DataFrame:
    """Replaces `text` by chunk_no, start_line, end_line, text; one row per chunk.

    Chunks start every size - overlap lines as long as lines remain, so the
    last may lie inside the one before. A size that does not exceed the overlap
    leaves all lines after the first chunk out, so it is refused unless
    `first_only` asks for that. Null or empty text gives no row.

    A file's chunks are built as one array and then inlined: the generator
    hands on only finished chunks. Exploding start numbers and slicing
    afterwards would copy the whole file into every one of its chunk rows.
    """
    check_sizes(size, overlap, first_only)
    others = [c for c in files.columns if c != "text"]
    lines = F.col("_lines")
    n = F.size(lines)
    if first_only:
        starts = F.array(F.lit(1))
    else:
        starts = F.sequence(F.lit(1), n, F.lit(size - overlap))

    def chunk(start: Column, number: Column) -> Column:
        end = F.least(start + (size - 1), n)
        return F.struct(
            number.alias("chunk_no"),
            start.alias("start_line"),
            end.alias("end_line"),
            join_range(lines, start, end, F.col("_closed")).alias("text"),
        )

    chunks = F.when(n > 0, F.transform(starts, chunk))
    split = files.select(
        *others, split_lines(F.col("text")).alias("_lines"), F.col("text").endswith("\n").alias("_closed")
    )
    return split.select(*others, F.inline(chunks))
