"""Benchmark decontamination: CGK embeddings of word windows, bit-sampling LSH, edit verification.

Words are runs of letters, marks and digits by Unicode class, case folded and
composed; each character of a script written without spaces is a word, with the
marks that follow it. Invisible format characters are skipped. The CGK random
walk reads a window of words: at step j it emits the word under its
pointer and moves on by a random bit of (j, word), so few edits between two
windows leave few steps that differ. A repetition has its own bits and its own
sample of steps; the sampled words of a window are its key.

Pieces of an item take the place of windows of the item's size, whose walks
drift apart with several edits. An item that may have e edits is cut into more
than e disjoint pieces of one size, so one piece at least has no edit, and its
window has the same key in every repetition: all words of an item within the
share lead to it, at any length, so the recall by words is 1. A window of a
piece's size starts at every word of every document. Walks of all windows of a slice run side by
side, and a window leaves as soon as the words sampled so far begin no key of an
item. Matching keys are verified by the exact edit distance between the item and
the text around the window.

Items are a stated set: they are taken in blocks of bounded size, one scan of the
documents each, so that what is broadcast has a bound.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.suffix_dedup import keyed_texts
from seamline.llm.texts import RangeHash, free_name, mixed, small_batches, text_slices, tidy, utf8_bytes, word_ranges
from seamline.work import written

#: Items of a block, which goes to every task; with an average of over 500 characters there are more blocks.
BLOCK_ITEMS = 20_000
#: The largest piece in words; a smaller share of edits than EDIT_SHARE allows larger pieces.
LARGEST_PIECE = 12
#: A key samples so many steps more than its piece has words.
EXTRA_STEPS = 1
#: A piece without an edit collides in every repetition, so one is enough.
REPETITIONS = 1
#: An item is in a text if a window is within this share of its words in edits.
EDIT_SHARE = 0.15

_TABLE_BITS = 20

_PLAIN = np.full(256, 32, np.uint8)
for _a, _b, _shift in (("0", "9", 0), ("a", "z", 0), ("A", "Z", 32)):
    _PLAIN[ord(_a) : ord(_b) + 1] = np.arange(ord(_a), ord(_b) + 1) + _shift


def piece_size(n: int, share: float) -> int:
    """Words of a piece of an item of n words: more pieces fit than edits are allowed, so one has no edit."""
    return max(1, min(LARGEST_PIECE, n // (int(share * n) + 1)))


#: Blocks of scripts written without spaces between words.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF),
    (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303C), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x323AF),
)
_BETWEEN, _LETTER, _ALONE, _MARK, _SKIPPED = range(5)


#: Filled by the first call: a plain list goes to tasks by value, so they need no copy of the package.
_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """A class for every code point."""
    if not _classes:
        _classes.append(_made_classes())
    return _classes[0]


def _made_classes() -> np.ndarray:
    classes = np.full(0x110000, _LETTER, np.uint8)
    of_category = {"P": _BETWEEN, "S": _BETWEEN, "Z": _BETWEEN, "M": _MARK}
    for code in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0x20000), *range(0xE0000, 0xE0200)):
        category = unicodedata.category(chr(code))
        classes[code] = {"Cc": _BETWEEN, "Cf": _SKIPPED}.get(category, of_category.get(category[0], _LETTER))
    for a, b in UNSPACED:
        own = classes[a : b + 1]
        own[own == _LETTER] = _ALONE
        # Numbers are runs in these scripts too.
        own[[unicodedata.category(chr(c)) == "Nd" for c in range(a, b + 1)]] = _LETTER
    return classes


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and per text the number of its first word."""
    data, offsets = utf8_bytes(texts)
    if len(data) and data.max() >= 0x80:
        return unicode_words(texts)
    data = _PLAIN[data]
    begin, end, first = word_ranges(data, offsets)
    return RangeHash(data).of(begin, end), first


def unicode_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As `plain_words`, for texts with characters beyond ASCII; words of ASCII have the same hashes."""
    plain = [unicodedata.normalize("NFC", (text or "").casefold()) for text in texts.to_pylist()]
    codes = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
    offsets = np.cumsum([0, *map(len, plain)])
    classes = character_classes()[codes]
    shown = classes != _SKIPPED
    if not shown.all():
        offsets = np.concatenate(([0], np.cumsum(shown)))[offsets]
        codes, classes = codes[shown], classes[shown]
    n = len(codes)
    # A mark belongs to what it follows; at the beginning, or behind a space, it is a letter.
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    mark = (classes == _MARK) & ~opens[:n]
    base = np.maximum.accumulate(np.where(mark, 0, np.arange(n))) if n else np.empty(0, np.int64)
    kind = classes[base]
    mark &= kind != _BETWEEN
    kind = np.where(kind == _MARK, _LETTER, np.where((kind == _BETWEEN) & (classes == _MARK), _LETTER, kind))
    before = np.concatenate(([_BETWEEN], kind[:-1])) if n else kind
    starts = (kind != _BETWEEN) & ~mark & (opens[:n] | (kind == _ALONE) | (before != _LETTER))
    starts |= (classes == _MARK) & ~mark & (before == _BETWEEN)
    begin = np.flatnonzero(starts)
    # A word ends where the next one, a space or the next text begins.
    stops = np.flatnonzero(np.concatenate((starts | (kind == _BETWEEN), [True])) | opens)
    end = stops[np.searchsorted(stops, begin, "right")]
    return RangeHash(codes).of(begin, end), np.searchsorted(begin, offsets)


@dataclass
class Walk:
    """One repetition for pieces of `size` words: its random bits and its sampled steps."""

    size: int
    seed: int
    multipliers: np.ndarray = field(init=False)
    sampled: np.ndarray = field(init=False)

    def __post_init__(self):
        random = np.random.default_rng([self.size, self.seed])
        steps = 2 * self.size
        self.multipliers = random.integers(1 << 63, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sampled = np.sort(random.choice(steps, min(self.size + EXTRA_STEPS, steps), replace=False))

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: list["Known"] | None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the windows at `starts` (none reads beyond its `ends`), and which windows they are.

        With `known` (a filter for each sampled step) only windows whose words so
        far begin a known key go on.
        """
        kept = np.arange(len(starts))
        at, last = starts.copy(), np.minimum(starts + self.size, ends)
        key = np.zeros(len(starts), np.uint64)
        sample = 0
        for step in range(int(self.sampled[-1]) + 1):
            past = at >= last
            word = words[np.minimum(at, len(words) - 1)]
            if past.any():
                word = np.where(past, np.uint64(0), word)
            if step == self.sampled[sample]:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(sample + 1))
                if known:
                    stay = known[sample].may_have(key)
                    kept, at, last, key, word = kept[stay], at[stay], last[stay], key[stay], word[stay]
                    if not len(kept):
                        break
                sample += 1
            at = at + ((word * self.multipliers[step]) >> np.uint64(63)).astype(np.int64)
        return key, kept


class Known:
    """A set of keys: a table of their last bits first, then the keys themselves."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.keys & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        return self.table[(keys & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys


class Items:
    """A block of items, cut into pieces, with the keys of every repetition."""

    def __init__(self, ids: list[int], texts: list[str], repetitions: int = REPETITIONS, share: float = EDIT_SHARE):
        words, first = plain_words(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(first[:-1], first[1:])]
        pieces: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, own in enumerate(self.words):
            if len(own):
                size = piece_size(len(own), share)
                pieces[size] += [(i, place) for place in range(0, len(own) - size + 1, size)]
        self.walks = []
        for size, own in sorted(pieces.items()):
            starts = np.array([first[i] + place for i, place in own])
            for seed in range(repetitions):
                walk, filters = Walk(size, seed), []
                for sample in range(len(walk.sampled)):
                    part = Walk(size, seed)
                    part.sampled = walk.sampled[: sample + 1]
                    keys, _ = part.keys(words, starts, starts + size, None)
                    filters.append(Known(keys))
                of_key = defaultdict(list)
                for key, piece in zip(keys.tolist(), own):
                    of_key[key].append(piece)
                self.walks.append((walk, filters, dict(of_key)))

    def candidates(self, words: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, word at which the item would begin, from the text's first word) for all matching keys."""
        found = set()
        if not len(words):
            return found
        starts, ends = np.arange(len(words)), np.repeat(first[1:], np.diff(first))
        for walk, filters, of_key in self.walks:
            able = ends - starts >= max(1, walk.size // 2)
            own = starts[able]
            keys, kept = walk.keys(words, own, ends[able], filters)
            exact = filters[-1].has(keys)
            places = own[kept[exact]]
            texts = np.searchsorted(first, places, "right") - 1
            for key, place, text in zip(keys[exact].tolist(), places.tolist(), texts.tolist()):
                for item, offset in of_key[key]:
                    found.add((text, item, place - offset - int(first[text])))
        return found

    def matches(self, words: np.ndarray, first: np.ndarray, share: float) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) to the fewest edits and the word where that window begins, for all within the share."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, begin in sorted(self.candidates(words, first)):
            own = self.words[item]
            most = int(share * len(own))
            known = best.get((text, item))
            if known and known[0] == 0:
                continue
            a = max(0, begin - most)
            around = words[first[text] + a : min(first[text] + max(begin, 0) + len(own) + most, first[text + 1])]
            if len(own) - np.isin(own, around).sum() > most:
                continue
            edits, start = window_edits(own, around)
            if edits <= most and (known is None or edits < known[0]):
                best[text, item] = (edits, a + start)
        return best


def window_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance between the item and any window of the text, and where that window begins."""
    n = len(text)
    costs, begins, ramp = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for i, word in enumerate(item.tolist()):
        swap = costs[:-1] + (text != np.uint64(word))
        drop = costs[1:] + 1
        new = np.concatenate(([i + 1], np.minimum(swap, drop)))
        came = np.concatenate(([0], np.where(swap <= drop, begins[:-1], begins[1:])))
        # A word of the text too many costs one more than the cell before it.
        lowest = np.minimum.accumulate(new - ramp)
        source = np.maximum.accumulate(np.where(new - ramp == lowest, ramp, 0))
        costs, begins = lowest + ramp, came[source]
    end = int(np.argmin(costs))
    return int(costs[end]), int(begins[end])


def find_items(documents: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, repetitions: int = REPETITIONS) -> DataFrame:
    """doc_id, item_id, item_words, edits, first_word for every benchmark item found in a document.

    One row for a document and an item, with the fewest edits of any window (the
    first such window). Null and empty texts on either side match nothing, as do
    items without a word. Rows that repeat a doc_id or an item_id count as one,
    and so do all rows with a null doc_id, which are searched like others.
    """
    found = found_rows(documents, benchmark, share, repetitions)
    least = F.min(F.struct("edits", "first_word", "item_words"))
    return written(
        found.groupBy("doc_id", "item_id").agg(least.alias("least"))
        .select("doc_id", "item_id", "least.item_words", "least.edits", "least.first_word")
    )


_FOUND = "doc_id bigint, text_hash bigint, item_id bigint, item_words int, edits int, first_word int"


def found_rows(documents: DataFrame, benchmark: DataFrame, share: float, repetitions: int = REPETITIONS) -> DataFrame:
    """doc_id, text_hash and what `find_items` tells, for every row of `documents` and item found in it."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    # Blocks by item: as many as rows and characters ask for; a block is what one scan compares with.
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["chars"] or 0) // (BLOCK_ITEMS * 500)))
    rows = keyed_texts(documents)
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct()
        listed = own.orderBy("item_id", "text").toArrow()
        shared = documents.sparkSession.sparkContext.broadcast(
            (listed.column("item_id").to_pylist(), listed.column("text").to_pylist())
        )
        part = rows.mapInArrow(tidy(finder(shared, share, repetitions)), _FOUND)
        found = part if found is None else found.unionAll(part)
    return found


def finder(shared, share: float, repetitions: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value, repetitions, share)
        for batch in batches:
            for part in text_slices(batch):
                matches = items.matches(*plain_words(part.column("text")), share)
                ids, hashes = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
                rows = [(ids[t], hashes[t], items.ids[i], len(items.words[i]), edits, at) for (t, i), (edits, at) in matches.items()]
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _FOUND.split(", ")]
                )

    return find


def found_texts(documents: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """doc_id, text_hash (both as of `keyed_texts`) of the rows in whose text an item is found."""
    with small_batches(documents.sparkSession):
        return written(found_rows(documents, benchmark, share).select("doc_id", "text_hash").distinct())


def decontaminated(documents: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The rows of `documents`, all columns, without those in whose text an item is found.

    A row is told by doc_id (null is a value like others) and text, so a clean
    text stays though another row of its doc_id goes.
    """
    found = found_texts(documents, benchmark, share)
    doc, text_hash = (free_name(documents.columns, n) for n in ("found_doc", "found_hash"))
    own = found.toDF(doc, text_hash)
    same = documents["doc_id"].cast("bigint").eqNullSafe(own[doc]) & (F.xxhash64(documents["text"]) == own[text_hash])
    return documents.join(own, same, "left_anti").select(documents.columns)
