"""Embedding text in Arrow batches with any model, and the built-in hashing model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from seamline.fixed_values import BATCH_SIZE, DOCUMENT_PREFIX, QUERY_PREFIX

Model = Callable[[list[str]], np.ndarray]

_WORD = re.compile("[a-z0-9_]+")
_CACHE_WORDS = 500_000


class _WordPlaces(dict):
    """Word to bucket, plus `dim` for a negative sign; filled on first use."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        turn, bucket = divmod(int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big"), self.dim)
        place = self[word] = bucket + self.dim * (turn % 2)
        return place


def hashing_model(dim: int, max_tokens: int | None = None) -> Callable[[], Model]:
    """Factory of a model that adds up signed word buckets; needs no weights.

    A word's hash is the first 32 bits of its md5: bucket = hash mod dim, and
    the sign is negative when hash div dim is odd. `max_tokens` keeps only the
    leading words of a text, as a model with a bounded input does.
    """

    def load() -> Model:
        places = _WordPlaces(dim)

        def embed(texts: list[str]) -> np.ndarray:
            found = [
                list(map(places.__getitem__, _WORD.findall(text.lower())[:max_tokens]))
                for text in texts
            ]
            rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            flat = np.fromiter(chain.from_iterable(found), np.int64, len(rows))
            sums = np.bincount(rows * (2 * dim) + flat, minlength=len(texts) * 2 * dim)
            plus_minus = sums.reshape(len(texts), 2, dim)
            return plus_minus[:, 0] - plus_minus[:, 1]

        return embed

    load.model_name = f"hashed words, {dim} buckets" + (f", {max_tokens} words" if max_tokens else "")
    return load


def model_name(load_model: Callable[[], Model]) -> str:
    """What an index calls its model: the loader's `model_name`, or where the loader is defined."""
    own = getattr(load_model, "model_name", None)
    return own or f"{getattr(load_model, '__module__', '')}.{getattr(load_model, '__qualname__', type(load_model).__qualname__)}"


def cut_and_normalise(rows: np.ndarray, dim: int) -> np.ndarray:
    rows = np.asarray(rows)[:, :dim].astype(np.float64)
    if rows.shape[1] != dim:
        raise ValueError(f"the model gives {rows.shape[1]} components, {dim} are asked for")
    if not np.isfinite(rows).all():
        raise ValueError("the model gives components that are not finite")
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    norms[norms == 0] = 1.0
    return (rows / norms[:, None]).astype(np.float32)


def _embed(text: Column, load_model: Callable[[], Model], dim: int, batch_size: int) -> Column:
    if batch_size < 1:
        raise ValueError("batch_size must be positive")

    @F.arrow_udf("array<float>")
    def embed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()
        for texts in batches:
            flat = np.empty((len(texts), dim), dtype=np.float32)
            for start in range(0, len(texts), batch_size):
                part = texts.slice(start, batch_size).to_pylist()
                flat[start : start + len(part)] = cut_and_normalise(model(part), dim)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * dim
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

    return embed_batches(text)


def embed_documents(
    text: Column, load_model: Callable[[], Model], dim: int, batch_size: int = BATCH_SIZE
) -> Column:
    """Unit vectors of chunk texts; the model is loaded once per task."""
    return _embed(F.concat(F.lit(DOCUMENT_PREFIX), text), load_model, dim, batch_size)


def embed_queries(
    query: Column, load_model: Callable[[], Model], dim: int, batch_size: int = BATCH_SIZE
) -> Column:
    return _embed(F.concat(F.lit(QUERY_PREFIX), query), load_model, dim, batch_size)
