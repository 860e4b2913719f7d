"""Texts in Arrow batches: slices of bounded size, words and their hashes in numpy."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

#: A task works on about so many bytes of text at once; one longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: Texts, whole sets and prefixes go to the tasks in batches of so many rows and bytes, where memory is short.
ROWS_AT_ONCE = 500
_BATCH_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores until no column has it."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


@contextmanager
def small_batches(spark):
    """Rows that carry texts or whole sets are long: what is written inside sends few of them to Python at once."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_AT_ONCE, "spark.sql.execution.arrow.maxBytesPerBatch": _BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def tidy(function):
    """A function over batches that gives its memory back when it ends: Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def pieces(text: bytes, unit: re.Pattern, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that cut no run of `unit` (one byte of a run)."""
    first = 0
    while first < len(text):
        last = min(len(text), first + size)
        if last < len(text) and unit.match(text, last - 1):
            while last < len(text) and unit.match(text, last):
                last += 1
        yield text[first:last]
        first = last


def text_slices(
    batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, rows: int | None = None
) -> Iterator[pa.RecordBatch]:
    """The batch in slices that hold at most `most` bytes of text, or one row, and at most `rows` rows."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first, before = 0, 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        last = min(last, first + rows) if rows else last
        yield batch.slice(first, last - first)
        first, before = last, int(ends[last - 1])


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes, and where each begins (one more entry for the end); null is empty."""
    texts = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


class RangeHash:
    """Hashes of any byte ranges of an array, each from two prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.empty(n + 1, np.uint64)
        powers[0] = 1
        powers[1:] = _BASE
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])
        powers[0] = 1
        powers[1:] = _BASE_INVERSE
        np.multiply.accumulate(powers, out=powers)
        self.inverse = powers

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + lengths)


def _white() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return white


_WHITE = _white()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ and, per text, the number of its first word."""
    inside = ~_WHITE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (A-Z as a-z), and per text the number of its first word."""
    data = _LOWER[data] if lower else data
    begin, end, first = word_ranges(data, offsets)
    return RangeHash(data).of(begin, end), first
