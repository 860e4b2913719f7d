"""Licence scans by a positional index of rare licence words.

One pass over the texts keeps, per document, the number of words and the places
of licence words (words of the templates): the positional postings. Everything
else is worked out on these. Document frequencies over the whole table give each
licence word its IDF.

A template has mandatory key phrases, each at its place in the template. For
every file the mandatory words of a template are looked up from the highest IDF
down; each occurrence names an offset (its place less the place in the
template), and offsets that some looked-up word does not name nearby are dropped.
At the offsets that are left the key phrases are verified word by word. No match
can be lost: a file that holds all key phrases near one offset holds all their
words there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.labelled import summed
from seamline.llm.texts import pieces
from seamline.work import written

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licences, each with its label and the phrases that must be there.
NOTICES = (
    ("mit", "released under the MIT License", ("under the mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
     ("redistribute it and or modify it", "gnu general public license", "either version 3")),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
     ("redistribute it and or modify it", "gnu general public license", "either version 2")),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met",
     ("redistribution and use in source and binary forms", "permitted provided that the following conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify and", "distribute this software for any purpose with or without fee is hereby granted")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ("subject to the terms of the mozilla public license", "2 0")),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ("free and unencumbered software released into the public domain",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
)

#: Key phrases may lie so many words nearer or farther than in the template.
SLACK = 12
#: How many mandatory words are looked up, those of highest IDF, before phrases are verified.
LOOKED_UP = 4
#: The least score of a document with a base label.
BASE_SCORE = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]")

POSTINGS = "doc_id bigint, n_words bigint, places binary, words binary"
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return _WORD.findall(text.encode().lower())


@dataclass
class Template:
    label: str
    words: np.ndarray
    #: Key phrases as word numbers, and their places in the template.
    phrases: list[tuple[np.ndarray, int]]
    must: frozenset[int]
    #: For each mandatory word its places in the template, inside key phrases.
    postings: dict[int, np.ndarray]


@dataclass
class Rules:
    """Templates and base phrases over one numbering of licence words."""

    notices: tuple = NOTICES
    base: dict = field(default_factory=lambda: dict(BASE))
    slack: int = SLACK

    def __post_init__(self):
        texts = [n[1] for n in self.notices] + list(self.base)
        self.numbers = {word: i for i, word in enumerate(sorted({w for t in texts for w in words_of(t)}))}
        self.phrases = [(self._numbers(phrase), label) for phrase, label in self.base.items()]
        self.templates = [self._template(*notice) for notice in self.notices]

    def _numbers(self, text: str) -> np.ndarray:
        return np.array([self.numbers[w] for w in words_of(text)], np.int16)

    def _template(self, label: str, text: str, keys: tuple[str, ...]) -> Template:
        words, phrases, postings = self._numbers(text), [], {}
        for key in keys:
            own = self._numbers(key)
            at = next((i for i in range(len(words) - len(own) + 1) if (words[i : i + len(own)] == own).all()), None)
            if at is None:
                raise ValueError(f"the notice of {label!r} does not hold its phrase {key!r}")
            phrases.append((own, at))
            for i, word in enumerate(own.tolist()):
                postings.setdefault(word, set()).add(at + i)
        return Template(label, words, phrases, frozenset(postings), {w: np.array(sorted(p)) for w, p in postings.items()})


def phrase_starts(places: np.ndarray, words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand consecutively; all its words are licence words."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return places[:0]
    found = np.flatnonzero(words[:n] == phrase[0])
    for i in range(1, len(phrase)):
        found = found[(words[found + i] == phrase[i]) & (places[found + i] == places[found] + i)]
    return places[found]


def near(offsets: np.ndarray, others: np.ndarray, reach: int) -> np.ndarray:
    """Which of `offsets` have one of `others` (ascending) within `reach`."""
    return np.searchsorted(others, offsets + reach, "right") > np.searchsorted(others, offsets - reach, "left")


def windows(template: Template, places: np.ndarray, words: np.ndarray, idf: np.ndarray, slack: int) -> list[int]:
    """Lowest offsets of the windows (of 2 * slack + 1 offsets) that hold an offset of each key phrase."""
    reach, left = 2 * slack, None
    for word in sorted(template.must, key=lambda w: (-idf[w], w))[:LOOKED_UP]:
        named = np.unique((places[words == word][:, None] - template.postings[word]).ravel())
        left = named if left is None else left[near(left, named, reach)]
        if not len(left):
            return []
    offsets = [phrase_starts(places, words, phrase) - at for phrase, at in template.phrases]
    starts = np.unique(np.concatenate(offsets))
    for own in offsets:
        if not len(own):
            return []
        starts = starts[np.searchsorted(own, starts + reach, "right") > np.searchsorted(own, starts, "left")]
    return starts.tolist()


def coverage(template: Template, places: np.ndarray, words: np.ndarray, idf: np.ndarray, start: int, slack: int) -> float:
    """Share, by IDF, of the template's words that the file has at an offset in the window."""
    first, last = np.searchsorted(places, (start, start + 2 * slack + len(template.words)))
    near_by: dict[int, list[int]] = {}
    for place, word in zip(places[first:last].tolist(), words[first:last].tolist()):
        near_by.setdefault(word, []).append(place)
    found = [any(start <= p - at <= start + 2 * slack for p in near_by.get(w, ())) for at, w in enumerate(template.words.tolist())]
    weights = idf[template.words]
    return float(weights[np.array(found)].sum() / weights.sum())


def scan(rules: Rules, idf: np.ndarray, n_words: int, places: np.ndarray, words: np.ndarray) -> tuple:
    """The row of one document but for its id."""
    starts, base, labels, score = [], set(), set(), 0.0
    present = frozenset(words.tolist())
    for phrase, label in rules.phrases:
        if present.issuperset(phrase.tolist()):
            own = phrase_starts(places, words, phrase)
            if len(own):
                starts.append(own)
                base.add(label)
    for template in rules.templates:
        if template.must <= present:
            for start in windows(template, places, words, idf, rules.slack):
                labels.add(template.label)
                score = max(score, coverage(template, places, words, idf, start, rules.slack))
    at = np.concatenate(starts) if starts else np.empty(0, np.int64)
    ends = (int(at.min()), int(at.max())) if len(at) else (None, None)
    if base:
        score = max(score, BASE_SCORE)
    return n_words, len(at), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), min(score, 1.0)


def licence_postings(documents: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, n_words, and the places and numbers of licence words of every document (packed, 32 and 16 bits)."""
    numbers = rules.numbers

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column("text").cast(pa.large_binary()), []
            for text in texts:
                n, places, words = 0, [], []
                for piece in pieces(text.as_py() or b"", _IN_WORD):
                    found = list(map(numbers.get, _WORD.findall(piece.lower())))
                    at = [i for i, number in enumerate(found) if number is not None]
                    places.append(np.array(at, np.int32) + np.int32(n))
                    words.append(np.array([found[i] for i in at], np.int16))
                    n += len(found)
                packed = [np.concatenate(parts).tobytes() if parts else b"" for parts in (places, words)]
                rows.append((n, *packed))
            columns = list(zip(*rows)) or [(), (), ()]
            kinds = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.split()[0] for f in POSTINGS.split(", ")]
            )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(post, POSTINGS)


def unpacked(places: pa.Scalar, words: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places.as_buffer(), np.int32).astype(np.int64), np.frombuffer(words.as_buffer(), np.int16)


def licence_idf(postings: DataFrame, rules: Rules) -> np.ndarray:
    """1 + ln((N + 1) / (df + 1)) of each licence word, over all documents of the table."""
    size = len(rules.numbers) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total[-1] += batch.num_rows
            for packed in batch.column("words"):
                total[np.unique(np.frombuffer(packed.as_buffer(), np.int16))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])

    total = np.array(summed(postings.select("words").mapInArrow(count, "term int, n double"), size))
    return 1 + np.log((total[-1] + 1) / (total[:-1] + 1))


def scan_licences(documents: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Words are runs of ASCII letters and digits (A-Z as a-z) and of bytes beyond
    ASCII. n_base counts all places of base phrases, overlapping ones too;
    first_word and last_word are their least and greatest start, null without
    one. A template's label is given where all its key phrases stand within one
    window of 2 * slack + 1 offsets. score is the greatest share, by IDF, of a
    template's words found in such a window, at least BASE_SCORE with a base
    label, and 0 without any. A text that is null or has no words has 0 words and
    empty labels. Repeated rows each get a row, a null doc_id stays null, other
    columns are ignored; no rows, no result.
    """
    rules = rules or Rules()
    postings = written(licence_postings(documents, rules))
    shared = documents.sparkSession.sparkContext.broadcast((rules, licence_idf(postings, rules)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, idf = shared.value
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = zip(batch.column("n_words").to_pylist(), batch.column("places"), batch.column("words"))
            found = [scan(own, idf, n, *unpacked(places, words)) for n, places, words in rows]
            columns = list(zip(*found)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names)

    return postings.mapInArrow(find, SCHEMA)
