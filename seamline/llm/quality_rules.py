"""Quality rules: base counts of words and lines, then compression bands.

A text is compressed by zstandard as a whole and in fixed chunks. The ratio
(compressed / plain bytes) of text that repeats itself is low, that of text
without structure is high; which ratios are normal depends on the length, so
each band of lengths has its own limits. Two sets of limits hold together: wide
ones that are given, and ones fitted to the table, a band for each power of two
of bytes and one for full chunks.

A fitted band reaches beyond the middle half of the ratios of its texts on both
sides. It learns from every distinct text that passes the base rules, from exact
counts by thousandths, so limits are the same in every run and do not move with
the number of copies. The texts are read once; what is measured (a few numbers a
text and one a chunk) is written, and the rest is counted and compared there.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from seamline.llm.texts import small_batches, text_slices
from seamline.work import written

_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, ratio double, lowest_chunk double, highest_chunk double, n_bytes bigint, text_hash bigint, chunks array<double>"
)

#: A fitted band reaches so many spreads (the middle half of the ratios) beyond that half; a spread counts as LEAST_SPREAD at least.
FENCE = 4.0
LEAST_SPREAD = 0.03
#: Quartiles of n texts are known to about 1 / sqrt(n) of the ratios: so much of that is added.
UNKNOWN = 0.5
_CHUNKS = -1


@dataclass(frozen=True)
class Bands:
    """Length limits: texts (or chunks) of at least `bytes_from` may have ratios from `low` to `high`."""

    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0),
        (64, 0.40, 1.30),
        (256, 0.35, 1.10),
        (1024, 0.30, 0.95),
        (4096, 0.25, 0.90),
        (32768, 0.20, 0.85),
    )
    chunk_bytes: int = 4096
    #: A document is rejected when more than this share of its full chunks is out of band.
    bad_chunks: float = 0.25
    level: int = 3
    #: Limits of full chunks; without them those of texts of that length hold.
    chunk: tuple[float, float] | None = None

    def outside(self, n_bytes: Column, ratio: Column, chunks: Column) -> Column:
        """Whether a text is out of band, as a whole or in too many chunks; below all bands nothing is."""
        whole, own = F.lit(False), (0.0, math.inf)
        for least, low, high in self.bands:
            whole = F.when(n_bytes >= least, (ratio < low) | (ratio > high)).otherwise(whole)
            own = (low, high) if self.chunk_bytes >= least else own
        low, high = self.chunk or own
        bad = F.size(F.filter(chunks, lambda r: (r < low) | (r > high)))
        return F.coalesce(whole | (bad > self.bad_chunks * F.size(chunks)), F.lit(False))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        counts, reach = Counter(windows), 0
        for at, window in enumerate(windows):
            if counts[window] > 1:
                repeat += at + 3 - max(at, reach)
                reach = at + 3
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat


def quality_rules(documents: DataFrame, bands: Bands = Bands(), fitted: bool = True) -> DataFrame:
    """The base counts, base_failed, kept, the ratios and bands_failed of every document.

    A null text counts as empty: no words, so base_failed. Base rules fail a
    text of under 50 words, or with more than half of its words in repeated
    3-word windows. Ratios of an empty text, and of chunks where there is no
    full chunk, are null, and no band rejects them. bands_failed does not depend
    on the base rules; with `fitted` the limits fitted to the table count as
    well as `bands`. Repeated rows each get a row. On a table where no text
    passes the base rules nothing is fitted.
    """
    limits = [bands]
    with small_batches(documents.sparkSession):
        measured = written(measure(documents, bands)) if fitted else measure(documents, bands)
    if fitted:
        limits.append(fit_bands(measured, bands))
    failed = F.lit(False)
    for own in limits:
        failed = failed | own.outside(F.col("n_bytes"), F.col("ratio"), F.col("chunks"))
    return measured.withColumn("bands_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("bands_failed")).alias("kept"), "ratio", "lowest_chunk", "highest_chunk", "bands_failed",
    )


def measure(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """What both rules need of every text; reads texts once."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part in text_slices(batch):
                rows = [_measured(text or "", bands, press) for text in part.column("text").to_pylist()]
                *numbers, chunks = map(list, zip(*rows))
                columns = [part.column("doc_id"), *numbers, part.column("text_hash"), chunks]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(measured, SCHEMA)


def _measured(text: str, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    counts = base_counts(text)
    n_words, repeat = counts[0], counts[4]
    failed = n_words < 50 or 100 * repeat > 50 * n_words
    data = text.encode()
    if not data:
        return *counts, failed, None, None, None, 0, []
    size = bands.chunk_bytes
    chunks = [len(press.compress(data[at : at + size])) / size for at in range(0, len(data) - size + 1, size)]
    ratio = len(press.compress(data)) / len(data)
    return *counts, failed, ratio, min(chunks, default=None), max(chunks, default=None), len(data), chunks


def fit_bands(measured: DataFrame, bands: Bands = Bands()) -> Bands:
    """Limits for each power of two of bytes, and for full chunks, from the distinct texts that pass the base rules."""
    texts = measured.where("not base_failed").select("text_hash", "n_bytes", "ratio", "chunks").dropDuplicates(["text_hash"])
    band = (F.length(F.bin("n_bytes")) - 1).alias("band")

    def thousandths(ratio):
        return F.round(ratio * 1000).cast("int").alias("thousandths")

    whole = texts.select(band, thousandths(F.col("ratio")))
    parts = texts.select(F.lit(_CHUNKS).alias("band"), F.explode("chunks").alias("ratio")).select("band", thousandths(F.col("ratio")))
    # At most a few thousand different ratios in each of some thirty bands.
    counts = defaultdict(list)
    for row in whole.unionAll(parts).groupBy("band", "thousandths").agg(F.count("*").alias("n")).collect():
        counts[row["band"]].append((row["thousandths"], row["n"]))
    limits = {band: fences(sorted(own)) for band, own in counts.items()}
    chunk = limits.pop(_CHUNKS, (0.0, math.inf))
    return Bands(tuple((1 << b, *limits[b]) for b in sorted(limits)), bands.chunk_bytes, bands.bad_chunks, bands.level, chunk)


def fences(counts: list[tuple[int, int]]) -> tuple[float, float]:
    """The limits of a band, from (thousandths, number) in ascending order."""
    n, quartiles, seen = sum(c for _, c in counts), [], 0
    for value, count in counts:
        seen += count
        while len(quartiles) < 2 and 4 * seen >= (1, 3)[len(quartiles)] * n:
            quartiles.append(value / 1000)
    reach = FENCE * max(quartiles[1] - quartiles[0], LEAST_SPREAD) + UNKNOWN / math.sqrt(n)
    return quartiles[0] - reach, quartiles[1] + reach


_KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (field.split() for field in SCHEMA.split(", "))])
