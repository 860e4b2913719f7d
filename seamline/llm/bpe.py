"""Byte-pair encoding and decoding with the vocabulary of a tokenizer file.

Method: the symbols of a pre-token form a doubly linked list; a priority queue
holds (merge rank, place) of adjacent pairs. The lowest rank is merged first,
the leftmost of equals; an entry whose pair has changed meanwhile is stale and
skipped. Decoding concatenates the byte strings of the ids.

The tokenizer file is read once by the driver and broadcast: its size is that of
the vocabulary and does not depend on the data.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Encodings that a task remembers; the memory is emptied when it is full.
REMEMBERED = 300_000
REMEMBERED_LENGTH = 64
REMEMBERED_TAILS = 10_000

#: Below this character all libraries agree on what a letter is.
LATIN_END = "\u0250"
#: ASCII signs that are neither letters nor digits; after letters a run of them is one pre-token.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: A pre-token may have so many bytes: 2^40.
PLACE_BITS = 40
PLACES = (1 << PLACE_BITS) - 1

#: Fixed value: the splitting pattern of byte-level tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space between other white space.
_CROWDED = re.compile(r" (?<=\s )\s")

#: Characters whose class may differ between the Unicode versions of two libraries.
_UNASSIGNED = regex.compile(r"\p{Cn}")

ENCODED = "doc_id bigint, ids binary"


def spaced_units(text: str) -> list[str] | None:
    """The text cut at each single space, or None where spaces and other white space meet.

    The pattern lets a pre-token hold a space only as its first character, so
    each part, with its space before it, splits the same way alone.
    """
    crowded = "  " in text or (text[:1] == " " and text[:2].isspace()) or (text[-1:] == " " and text[-2:].isspace())
    return None if crowded or _CROWDED.search(text) else text.split(" ")


def library_tokens(text: str) -> list[str]:
    """Pre-tokens as the tokenizers library cuts them, for texts with characters too new for one of the two."""
    from tokenizers.pre_tokenizers import ByteLevel

    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


def byte_letters() -> dict[int, str]:
    """Each byte as the printable character that stands for it in the vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (byte for byte in range(256) if byte not in plain)
    return {byte: chr(byte) for byte in plain} | {byte: chr(0x100 + i) for i, byte in enumerate(rest)}


class BytePairs:
    """Encoder and decoder of one tokenizer file (its JSON)."""

    def __init__(self, file: str):
        described = json.loads(file)
        model, before = described["model"], described["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model.get("type", "BPE") != "BPE" or described.get("normalizer") or not plain or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without a normaliser or prefix space")
        added = described.get("added_tokens") or []
        if any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space with them are not supported")
        vocabulary, letters = model["vocab"], byte_letters()
        self.first = [vocabulary[letters[byte]] for byte in range(256)]
        self.size = max([*vocabulary.values(), *(t["id"] for t in added)]) + 1
        #: Pair of ids to its rank, shifted to leave room for a place; rank to the id of the merged pair.
        self.ranks: dict[int, int] = {}
        self.products: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocabulary[left] * self.size + vocabulary[right], rank << PLACE_BITS)
            self.products.append(vocabulary[left + right])
        of_letter = {letter: byte for byte, letter in letters.items()}
        self.strings = [b""] * self.size
        for token, i in vocabulary.items():
            self.strings[i] = bytes(of_letter[c] for c in token)
        self.special = {t["content"]: t["id"] for t in added}
        for content, i in self.special.items():
            self.strings[i] = content.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest_first))) if self.special else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The ids that remain of a pre-token's bytes when no merge applies any more."""
        get, size, n = self.ranks.get, self.size, len(symbols)
        queue = [r + i for i, r in enumerate(map(get, [a * size + b for a, b in zip(symbols, symbols[1:])])) if r is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            place = entry & PLACES
            right, left = after[place], symbols[place]
            if left < 0 or right >= n or get(left * size + symbols[right]) != entry - place:
                continue  # stale: one of the two was merged with another
            symbols[place] = product = self.products[entry >> PLACE_BITS]
            symbols[right] = -1
            right = after[place] = after[right]
            if right < n:
                before[right] = place
                rank = get(product * size + symbols[right])
                if rank is not None:
                    heapq.heappush(queue, rank + place)
            left = before[place]
            if left >= 0:
                rank = get(symbols[left] * size + product)
                if rank is not None:
                    heapq.heappush(queue, rank + left)
        return [s for s in symbols if s >= 0]

    def _token(self, token: str) -> bytes:
        first = self.first
        ids = self.merged([first[byte] for byte in token.encode()])
        return struct.pack(f"<{len(ids)}I", *ids)

    def _tokens(self, text: str) -> bytes:
        if not text.isascii() and _UNASSIGNED.search(text):
            return b"".join(map(self._token, library_tokens(text)))
        return b"".join(map(self._token, self.split.findall(text)))

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit, its space before it; letters alone are one pre-token."""
        word = unit.rstrip(PUNCTUATION)
        if not word.isalpha() or max(word) >= LATIN_END:
            ids = self._tokens(" " + unit)
        elif len(word) < len(unit):
            ids = (self.known.get(word) or self._unit(word)) + self._tail(unit[len(word) :])
        else:
            ids = self._token(" " + unit)
        if len(unit) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[unit] = ids
        return ids

    def _tail(self, signs: str) -> bytes:
        """Ids of punctuation after letters: one pre-token."""
        ids = self.tails.get(signs)
        if ids is None:
            ids = self._token(signs)
            if len(self.tails) < REMEMBERED_TAILS:
                self.tails[signs] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        units = spaced_units(text)
        if units is None:
            return self._tokens(text)
        known, unknown = self.known.get, self._unit
        return self._tokens(units[0]) + b"".join([known(u) or unknown(u) for u in units[1:]])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special_pattern or not self.special_pattern.search(text):
            return self._plain(text)
        parts, at = [], 0
        for found in self.special_pattern.finditer(text):
            parts += [self._plain(text[at : found.start()]), struct.pack("<I", self.special[found[0]])]
            at = found.end()
        return b"".join([*parts, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def worker_memory(df: DataFrame, tokenizer_path: str):
    """The tokenizer file, broadcast in a dict where each Python worker keeps what it makes of it."""
    return df.sparkSession.sparkContext.broadcast({"file": read_tokenizer(tokenizer_path)})


def remembered(memory: dict, make):
    """What `make` makes of the file, once for a worker and all its tasks."""
    if "made" not in memory:
        memory["made"] = make(memory["file"])
    return memory["made"]


def encode_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids, the packed token ids of the whole text.

    A null or empty text has no ids (an empty binary). Repeated rows and null
    doc_ids give a row each, as many as come in. Text that spells a special
    token becomes that token, as the file asks.
    """
    shared = worker_memory(documents, tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = remembered(shared.value, BytePairs)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [pairs.encode(text) if text else b"" for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        pairs.known.clear()  # the worker goes on to other tasks

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, ENCODED)


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, text: the text that the ids stand for; null ids give the empty text."""
    shared = worker_memory(encoded, tokenizer_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = remembered(shared.value, BytePairs)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [pairs.decode(ids) if ids else "" for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"{ENCODED}, text string")


def bpe_digests(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""
    decoded = decode_documents(encode_documents(documents, tokenizer_path), tokenizer_path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
