"""Token ids by the tokenizers library, which is asked once for each distinct unit of text."""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterable

import numpy as np
from tokenizers import Tokenizer

from seamline.llm.bpe import LATIN_END, PUNCTUATION, REMEMBERED_LENGTH, REMEMBERED_TAILS, byte_letters, spaced_units

#: Encodings that a task remembers; the memory is emptied when it is full.
REMEMBERED = 300_000


class LibraryEncoder:
    """Encodes as Tokenizer.encode(text, add_special_tokens=False) with truncation and padding off.

    Byte-level pre-tokens never hold a space but as their first character, so a
    text is the sum of its units (see `spaced_units`), and ids of units seen
    before are remembered. A new unit of letters is one pre-token and goes
    straight to the library's model; any other goes through its whole encoder,
    and so do texts in which a special token may be spelled, or in which spaces
    meet other white space.
    """

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        if sys.byteorder != "little":
            raise ValueError("ids are packed as this machine orders bytes, which must be little-endian")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = str.maketrans({chr(byte): letter for byte, letter in byte_letters().items()})
        self.space = byte_letters()[ord(" ")]
        before = json.loads(file)["pre_tokenizer"] or {}
        self.by_unit = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.line_end = self._library("\n")
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, spelled: str) -> bytes:
        """Ids of one pre-token, spelled in the vocabulary's letters."""
        return array(self.code, [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit, its space before it."""
        above, line_end, below = unit.partition("\n")
        if unit.isascii() and unit.isalpha():
            ids = self._word(self.space + unit)
        elif line_end and above and below and not above[-1].isspace() and not below[0].isspace():
            ids = (self.known.get(above) or self._unit(above)) + self.line_end + self._start(below)
        else:
            word = unit.rstrip(PUNCTUATION)
            if not word.isalpha() or max(word) >= LATIN_END:
                ids = self._library(" " + unit)
            elif len(word) < len(unit):
                ids = (self.known.get(word) or self._unit(word)) + self._tail(unit[len(word) :])
            else:
                ids = self._word(self.space + unit.encode().decode("latin-1").translate(self.letters))
        if len(unit) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[unit] = ids
        return ids

    def _start(self, text: str) -> bytes:
        """Ids of what stands at the start of a line, up to a space."""
        word = text.rstrip(PUNCTUATION)
        if word.isascii() and word.isalpha():
            return self._word(word) + (self._tail(text[len(word) :]) if len(word) < len(text) else b"")
        return self._library(text)

    def _tail(self, signs: str) -> bytes:
        """Ids of punctuation after letters: one pre-token."""
        ids = self.tails.get(signs)
        if ids is None:
            ids = self._library(signs)
            if len(self.tails) < REMEMBERED_TAILS:
                self.tails[signs] = ids
        return ids

    def _text(self, text: str | None) -> bytes:
        if not text:
            return b""
        units = spaced_units(text) if self.by_unit and not any(s in text for s in self.special) else None
        if units is None:
            return self._library(text)
        known, unknown = self.known.get, self._unit
        head = self._library(units[0]) if units[0] else b""
        return head + b"".join([known(u) or unknown(u) for u in units[1:]])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Packed ids of each text, in the encoder's `kind`; null is empty."""
        return [self._text(text) for text in texts]
