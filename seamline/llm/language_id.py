"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters over lower-cased letters
(everything else is one space), weighted by TF-IDF and scaled to unit length.
Weights are trained with follow-the-regularised-leader (proximal, per-coordinate
rates) under an elastic-net penalty, then a temperature is fitted on a part of
the sample that training has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.labelled import fold, sampled_ids, sampled_texts, summed
from seamline.llm.texts import text_slices

#: Hashed features, and weights (features x languages) of a model: with many languages it has fewer features.
BITS = 14
MOST_WEIGHT_BITS = 24
UNKNOWN = "und"
HELD_OUT = 2

#: Bounds of the fit: sampled documents per language, and of all languages together.
PER_LANGUAGE = 400
SAMPLE = 80_000

EPOCHS = 5
#: FTRL: learning rate, its smoothing, and the penalties on |w| and w^2.
ALPHA, BETA, LASSO, RIDGE = 0.5, 1.0, 0.02, 0.05

_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def feature_bits(n_languages: int) -> int:
    """How many bits name a feature, so that the weights of all languages keep to their bound."""
    return min(BITS, MOST_WEIGHT_BITS - max(n_languages - 1, 0).bit_length())


class Features:
    """n-gram counts of texts; keeps a table of which characters are letters."""

    def __init__(self, bits: int = BITS):
        self.size, self.shift = 1 << bits, np.uint32(32 - bits)
        self.letter = np.array([chr(c).isalpha() for c in range(0x110000)])

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Features and how often each occurs; None if the text has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letter[codes]
        if not letters.any():
            return None
        codes = np.where(letters, codes, np.uint32(32))
        space = codes == 32
        codes = np.concatenate(([32], codes[~(space & np.concatenate(([True], space[:-1])))], [32])).astype(np.uint32)
        one = codes * _MULTIPLIERS[0]
        two = (one[:-1] ^ one[1:] << np.uint32(7) ^ np.uint32(1)) * _MULTIPLIERS[1]
        three = (two[:-1] ^ one[2:] << np.uint32(13) ^ np.uint32(2)) * _MULTIPLIERS[2]
        every = np.bincount(np.concatenate((one, two, three)) >> self.shift, minlength=self.size)
        at = np.flatnonzero(every)
        return at, every[at]


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[at]
    return values / np.linalg.norm(values)


@dataclass
class LanguageModel:
    """Weights, at most 2 ** MOST_WEIGHT_BITS, and what goes with them."""

    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    idf: np.ndarray = field(default_factory=lambda: np.ones(1 << BITS))
    temperature: float = 1.0

    def features(self) -> Features:
        return Features(len(self.idf).bit_length() - 1)

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.bias


def softmax(rows: np.ndarray) -> np.ndarray:
    raised = np.exp(rows - rows.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


class Leader:
    """FTRL-proximal state: z and squared gradients of every weight; weights follow from them."""

    def __init__(self, n_features: int, n_classes: int):
        self.z = np.zeros((n_features + 1, n_classes))
        self.n = np.zeros((n_features + 1, n_classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - LASSO, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + RIDGE)

    def learn(self, at: np.ndarray, values: np.ndarray, target: int) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        error = softmax(values @ w)
        error[target] -= 1
        gradient = values[:, None] * error
        squares = gradient**2
        self.z[at] += gradient - (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += squares


def fitted_temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature, of a fixed grid, at which held-back documents are likeliest."""
    if not len(targets):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 80))
    losses = [-np.log(softmax(logits / t)[np.arange(len(targets)), targets] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def feature_counts(training: DataFrame, bits: int) -> np.ndarray:
    """In how many of all training documents each feature occurs; at the end, their number."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(bits), np.zeros(size + 1)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = features.counts(text or "")
                if found:
                    total[found[0]] += 1
                total[size] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])

    return np.array(summed(training.select("text").mapInArrow(count, "term int, n double"), size + 1))


def fit_languages(documents: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from texts and non-null languages outside the held-out fold.

    Document counts cover all of these; weights are fitted on at most
    `per_language` documents of each language and about `SAMPLE` documents of all.
    """
    doc_id = F.col("doc_id").cast("bigint")
    training = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(doc_id, 4) != HELD_OUT))
    training = training.select(doc_id.alias("doc_id"), "text", F.col("lang").cast("string").alias("label"))
    ids = sampled_ids(training.select("doc_id", "label"), per_language, SAMPLE).dropDuplicates(["doc_id"])
    bits = feature_bits(ids.select("label").distinct().count())
    counted = feature_counts(training, bits)
    idf = np.log((counted[-1] + 1) / (counted[:-1] + 1)) + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            for part in text_slices(batch):
                found = [features.counts(text or "") for text in part.column("text").to_pylist()]
                at = [None if f is None else f[0].astype(np.int32).tobytes() for f in found]
                n = [None if f is None else f[1].astype(np.int32).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                    ["doc_id", "label", "at", "n"],
                )

    sample = sampled_texts(training.drop("label"), ids).mapInArrow(rows, "doc_id bigint, label string, at binary, n binary")
    # Bounded by the parameters: SAMPLE documents of at most 2 ** BITS features.
    table = sample.where(F.col("at").isNotNull()).dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id").to_pylist()
    languages = sorted({row["label"] for row in table})
    if not languages:
        return LanguageModel()
    examples = []
    for row in table:
        at = np.frombuffer(row["at"], np.int32)
        examples.append((at, tf_idf(at, np.frombuffer(row["n"], np.int32), idf), languages.index(row["label"])))
    order = np.random.default_rng(7).permutation(len(examples))
    held = set(order[: len(order) // 5].tolist()) if len(order) >= 20 else set()
    leader = Leader(1 << bits, len(languages))
    for _ in range(EPOCHS):
        for i in order:
            if int(i) not in held:
                leader.learn(*examples[i])
    weights = leader.weights(slice(None))
    model = LanguageModel(languages, weights[:-1].astype(np.float32), weights[-1], idf)
    seen = [examples[i] for i in sorted(held)]
    if seen:
        model.temperature = fitted_temperature(np.stack([model.logits(a, v) for a, v, _ in seen]), np.array([t for *_, t in seen]))
    return model


def predict_languages(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the calibrated probability) of every document.

    A null text, and one without a letter, is `und` with score 0; so is every
    text if there is nothing to learn from. Repeated rows each get a row.
    """
    model = fit_languages(documents, per_language)
    state = (model.languages, model.weights, model.bias, model.idf, model.temperature)
    shared = documents.sparkSession.sparkContext.broadcast(state)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        features = own.features()
        for batch in batches:
            for part in text_slices(batch):
                names, scores = [], []
                for text in part.column("text").to_pylist():
                    found = features.counts(text) if text and own.languages else None
                    if found is None:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    p = softmax(own.logits(found[0], tf_idf(*found, own.idf)) / own.temperature)
                    names.append(own.languages[int(p.argmax())])
                    scores.append(float(p.max()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = rows.mapInArrow(predict, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"), "lang_pred", "score")
