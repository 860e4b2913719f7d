"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: compatibility forms, look-alike letters and digits that
stand for letters become the plain letter, invisible characters go. The lexicon
is learned from a bounded labelled sample: folded words whose share among toxic
documents exceeds that among others beyond chance, weighted by the log ratio.
Matches count as whole words and not inside an exception phrase; their summed
weight per word of text goes through a logistic curve fitted on the sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.labelled import binary_labels, fold, sampled_ids, sampled_texts
from seamline.llm.texts import text_slices

HELD_OUT = 1
FLAG = 0.7

#: Bounds of the fit: sampled documents per label, words of the lexicon.
PER_LABEL = 4000
LEXICON = 5000
#: A word enters the lexicon with at least this log ratio, if that is above 0 by so many standard errors and it
#: followed so many different words.
ERRORS = 2.2
LEAST_RATIO = 3.0
LEAST_CONTEXTS = 8
#: A match in a text of fewer words counts as in one of so many.
LEAST_WORDS = 50

#: Look-alikes of Latin letters in other scripts, digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o", "հ": "h",
}
LETTER_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"

#: Phrases in which a word of the lexicon does no harm.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "not stupid", "pond scum", "sore loser")

_FOLDED = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE, ""))
_SIGNS = str.maketrans(LETTER_SIGNS)
#: A word of letters and signs that stand for letters; signs at its end are punctuation.
_WRITTEN = re.compile(r"(?=[\d@$!|]*[^\W\d_])[\w@$!|]*\w|[@$!|]+(?=[^\W\d_])")
_SIGN = re.compile(r"[\d@$!|]")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case, look-alikes as the Latin letter, and signs inside words as letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_FOLDED)
    else:
        text = text.lower()
    if _SIGN.search(text):
        text = _WRITTEN.sub(lambda found: found[0].translate(_SIGNS), text)
    return text


@dataclass
class Lexicon:
    """Weights of words, and the curve: score = 1 / (1 + exp(-(bias + slope * log(1 + weight per 100 words))))."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slope: float = 3.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(folded(phrase), (len(folded(phrase)), None))
        for word, weight in self.weights.items():
            # "1" is folded to "i" and may have stood for "l".
            for form in {word, word.replace("l", "i")}:
                if form not in found:
                    found.add_word(form, (len(form), weight))
        found.make_automaton()
        return found


def matched_weight(text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """Summed weight of whole-word matches outside exception phrases, and the number of words."""
    text = folded(text)
    n_words = text.count(" ") + text.count("\n") + 1
    if not len(automaton):
        return 0.0, n_words
    hits, spared = [], []
    for end, (length, weight) in automaton.iter(text):
        start, end = end - length + 1, end + 1
        if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            continue
        (spared if weight is None else hits).append((start, end, weight))
    total = sum(w for a, b, w in hits if not any(c <= a and b <= d for c, d, _ in spared))
    return total, n_words


def density(total: float, n_words: int) -> float:
    return math.log1p(100 * total / max(n_words, LEAST_WORDS))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature, classes weighted alike, with a small quadratic penalty."""
    if not len(y) or y.min() == y.max():
        return Lexicon.bias, Lexicon.slope
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    columns, at = np.stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ columns, -30, 30)))
        slope = columns @ (weight * (p - y)) + 1e-3 * at
        curve = (columns * (weight * p * (1 - p))) @ columns.T + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(curve, slope)
    return float(at[0]), float(max(at[1], 0.0))


def fit_lexicon(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Lexicon:
    """Learn from at most `per_label` documents of each label outside the held-out fold.

    A word counts once per label and word before it: copies of a document add
    nothing, and a word that toxic texts use has many neighbours.
    """
    ids = sampled_ids(binary_labels(labels, "toxic", HELD_OUT), per_label, 2 * per_label)
    sizes = {row["label"]: row["n"] for row in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for label, text in zip(part.column("label").to_pylist(), part.column("text").to_pylist()):
                    own = _WORD.findall(folded(text or ""))
                    rows.append({"label": label, "pairs": list({f"{b} {a}" for a, b in zip(["", *own], own)})})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.int32()), ("pairs", pa.list_(pa.string()))]))

    texts = sampled_texts(documents, ids).dropDuplicates(["doc_id"])
    seen = texts.mapInArrow(words, "label int, pairs array<string>").select("label", F.explode("pairs").alias("pair")).distinct()
    counts = seen.groupBy(F.split("pair", " ")[0].alias("word")).agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )
    ratio = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    chosen = counts.where((F.col("a") >= LEAST_CONTEXTS) & (ratio >= LEAST_RATIO) & (ratio - ERRORS * error > 0)).select("word", ratio.alias("weight"))
    # The lexicon has a bound, not the result: the heaviest words of the sample.
    heaviest = chosen.orderBy(F.desc("weight"), "word").limit(LEXICON).collect()
    lexicon = Lexicon({row["word"]: row["weight"] for row in heaviest})
    scored = texts.mapInArrow(densities(lexicon.weights, lexicon.exceptions, ["label"]), "label int, x double").toArrow()
    x, y = scored.column("x").to_numpy(), scored.column("label").to_numpy().astype(float)
    lexicon.bias, lexicon.slope = fit_curve(x, y)
    return lexicon


def densities(weights: dict[str, float], exceptions: tuple[str, ...], keep: list[str]):
    """A function over batches: the columns `keep` and the matched weight by length of each text as x."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(weights, exceptions).automaton()
        for batch in batches:
            for part in text_slices(batch):
                x = [density(*matched_weight(text or "", automaton)) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(x, pa.float64())], [*keep, "x"])

    return measure


def toxicity_scores(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    A null or empty text has no match and the score of any text without one.
    Repeated rows each get a row. held_out is null where doc_id is.
    """
    lexicon = fit_lexicon(documents, labels, per_label)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    measured = rows.mapInArrow(densities(lexicon.weights, lexicon.exceptions, ["doc_id"]), "doc_id bigint, x double")
    score = 1 / (1 + F.exp(-(F.lit(lexicon.bias) + F.lit(lexicon.slope) * F.col("x"))))
    return measured.select(
        "doc_id", (fold(F.col("doc_id"), 3) == HELD_OUT).alias("held_out"), score.alias("score"),
        (score >= FLAG).cast("int").alias("predicted"),
    )
