"""Quality by a vote of nearest neighbours in a latent-semantic space.

Terms of a text are hashed byte trigrams and levels of its structure (shares of
repeated word triples, of capitals, of symbols and the like). Weights are
(1 + log tf) idf with document counts over the whole table; trigrams and
structure are scaled to equal length. The singular vectors of a bounded labelled
sample span the latent space. The sample's vectors are broadcast; each document
is compared with all of them, in blocks of matrix products, and its score is the
similarity-weighted share of label 1 among its nearest neighbours.

Products are taken of whole numbers small enough to be exact in double precision
in any order of addition, so a score depends on the text alone and not on the
rows that happen to share its batch; equal similarities go to the sampled
document with the lowest doc_id first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.labelled import binary_labels, fold, sampled_ids, sampled_texts, summed
from seamline.llm.texts import text_slices, tidy, utf8_bytes, word_hashes

N_GRAMS = 2048
LEVELS = 8
MEASURES = 8
N_TERMS = N_GRAMS + LEVELS * MEASURES

#: Bounds of the fit: sampled documents per label (two labels), dimensions, neighbours that vote.
PER_LABEL = 1000
DIMENSIONS = 64
NEIGHBOURS = 15
#: A sample has fewer documents than 2 to this power.
SAMPLE_BITS = 14

HELD_OUT = 1
ACCEPT = 0.5

#: Texts whose terms are held as dense rows at once.
_ROWS = 512
#: Coordinates of unit vectors are rounded to this part of 1: sums of products of two stay below 2^53.
_GRID = 2.0**24

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of all terms, a row per text; a null text has those of the empty text."""
    data, offsets = utf8_bytes(texts)
    words, first = word_hashes(data, offsets, lower=False)
    triples = words[:-2] + np.uint64(3) * words[1:-1] + np.uint64(7) * words[2:] if len(words) > 2 else words[:0]
    wide = data.astype(np.uint32)
    grams = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16) if len(data) > 2 else wide[:0]
    grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
    classes = [np.concatenate(([0], np.cumsum(table[data]))) for table in (_CAPITAL, _LETTER, _DIGIT, _SPACE)]
    counts = np.zeros((len(texts), N_TERMS), np.float32)
    for i in range(len(texts)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a > 2:
            counts[i, :N_GRAMS] = np.bincount(grams[a : b - 2], minlength=N_GRAMS)
        n_words, n = int(first[i + 1] - first[i]), max(b - a, 1)
        capital, letter, digit, space = (int(c[b] - c[a]) for c in classes)
        own = triples[first[i] : max(first[i], first[i + 1] - 2)]
        repeated = 1 - len(np.unique(own)) / len(own) if len(own) else 0.0
        kinds = len(np.unique(words[first[i] : first[i + 1]]))
        shares = (
            repeated, capital / max(letter, 1), min(1.0, 3 * (n - letter - digit - space) / n), min(1.0, 3 * digit / n),
            min(1.0, 3 * space / n), 1 - kinds / max(n_words, 1), min(1.0, n_words / 80), min(1.0, n / max(n_words, 1) / 25),
        )
        for m, share in enumerate(shares):
            at = N_GRAMS + m * LEVELS
            counts[i, at : at + LEVELS] = np.arange(LEVELS) < round(share * LEVELS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + log tf) idf, trigrams and structure each scaled to unit length."""
    values = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    for block in (values[:, :N_GRAMS], values[:, N_GRAMS:]):
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    return values


def on_grid(values: np.ndarray) -> np.ndarray:
    """Values of at most about 1 as whole numbers, parts of 2^24."""
    return np.rint(values.astype(np.float64) * _GRID)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def document_counts(documents: DataFrame) -> np.ndarray:
    """In how many documents of the whole table each term occurs; at the end, the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_TERMS + 1)
        for batch in batches:
            for part in text_slices(batch, rows=_ROWS):
                total[:N_TERMS] += (term_counts(part.column("text")) > 0).sum(axis=0)
                total[N_TERMS] += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])

    return np.array(summed(documents.select("text").mapInArrow(tidy(count), "term int, n double"), N_TERMS + 1))


@dataclass
class Neighbours:
    """What a task needs to score texts; its size is set by the bounds of the fit."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        rows = unit(on_grid(weighted(term_counts(texts), self.idf)) @ on_grid(self.axes))
        near = (on_grid(rows) @ on_grid(self.vectors).T).astype(np.int64)
        n = near.shape[1]
        k = min(NEIGHBOURS, n)
        # Similarity first, then the lower place: no two keys of a row are equal.
        keys = near * (1 << SAMPLE_BITS) + np.arange(n - 1, -1, -1)
        best = np.argpartition(-keys, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(keys, best, axis=1), axis=1), axis=1)
        weights = np.maximum(np.take_along_axis(near, best, axis=1) / _GRID**2, 0) ** 4 + 1e-9
        return (weights * self.labels[best]).sum(axis=1) / weights.sum(axis=1)


def fit_neighbours(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Neighbours:
    """Learn from at most `per_label` documents of each label outside the held-out fold.

    Without any labelled document every score is 0.5.
    """
    if 2 * per_label >= 1 << SAMPLE_BITS:
        raise ValueError(f"per_label must be below {1 << SAMPLE_BITS - 1}")
    counted = document_counts(documents)
    idf = (np.log((counted[-1] + 1) / (counted[:-1] + 1)) + 1).astype(np.float32)
    ids = sampled_ids(binary_labels(labels, "quality", HELD_OUT), per_label, 2 * per_label)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, rows=_ROWS):
                packed = [row.astype(np.float16).tobytes() for row in weighted(term_counts(part.column("text")), idf)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "row"]
                )

    sample = sampled_texts(documents, ids).mapInArrow(tidy(rows), "doc_id bigint, label int, row binary")
    # Bounded by the parameter: 2 x per_label rows of N_TERMS half floats.
    table = sample.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    if not table.num_rows:
        return Neighbours(idf, np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    matrix = np.frombuffer(b"".join(table.column("row").to_pylist()), np.float16).reshape(-1, N_TERMS).astype(np.float32)
    values, vectors = np.linalg.eigh(matrix @ matrix.T)
    top = np.argsort(values)[::-1][: min(DIMENSIONS, len(values))]
    top = top[values[top] > 1e-6 * values.max()]
    axes = (matrix.T @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
    return Neighbours(idf, axes, unit(matrix @ axes), table.column("label").to_numpy().astype(np.float64))


def with_scores(documents: DataFrame, model: Neighbours, name: str) -> DataFrame:
    """All columns of `documents` and the score under `name`, which must not be one of them."""
    fields = documents.select("*", F.lit(0.0).alias(name)).schema
    shared = documents.sparkSession.sparkContext.broadcast((model.idf, model.axes, model.vectors, model.labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Neighbours(*shared.value)
        for batch in batches:
            for part in text_slices(batch, rows=_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own.scores(part.column("text")), pa.float64())], [*part.schema.names, name]
                )

    return documents.mapInArrow(tidy(score), fields)


def quality_scores(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, empty and null texts too.

    Equal texts get equal scores, wherever they stand. Repeated rows each get a row. held_out is null
    where doc_id is.
    """
    model = fit_neighbours(documents, labels, per_label)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return with_scores(rows, model, "score").select(
        "doc_id", (fold(F.col("doc_id"), 3) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )
