"""Suffix-array dedup: removes bytes of long strings that occur more than once.

A start is a place whose string of `length` bytes also starts anywhere else; bytes
that such strings cover are removed. Suffixes are compared in buckets:

1. The bucket of a suffix is its anchor: of the strings of `key` bytes inside the
   first `length` bytes, the one with the least hash. Equal strings have the same
   anchor at the same distance, so their suffixes meet in one bucket. Neighbouring
   starts share an anchor, so a run of them is one row: a segment. A segment that
   a text has several times (a text that goes round in a circle has each once a
   turn) is one row too.
2. Buckets with one segment are done. Segments that agree from the first to the
   last byte have the same fingerprint and are repeated whole; nothing of their
   text moves. For the others one copy of each text goes to the bucket.
3. Buckets are sorted one block after the other, with memory for one block. The
   text of a block is laid out with all anchors at multiples of PERIOD. Suffixes
   are ordered by their first PERIOD bytes; ties that go further are resolved by
   ranks of a difference-cover sample of the block, built beforehand by doubling:
   two suffixes reach sampled places after the same few bytes, and the ranks
   there stand for the next `reach` bytes each. Neighbours in this order that agree
   to `length` bytes are repeated.
4. Buckets of more than HOT segments are not sorted in one task: their suffixes
   go through a shuffle by fingerprint and are counted there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.texts import RangeHash, free_name, small_batches, text_slices, tidy, utf8_bytes
from seamline.work import discard, written

LENGTH = 400
#: Finding runs takes some 50 times the bytes of a slice; one longer text is a slice of its own.
RUN_BYTES = 250_000
PERIOD = 32
#: Text that a task sorts at once, if no single bucket is larger.
BLOCK_BYTES = 2_000_000
#: Segments of a bucket that one task sorts, of strings of LENGTH bytes; of shorter ones as many more.
HOT = 2000

RUNS = "anchor bigint, doc_id bigint, text_hash bigint, starts array<int>, n_starts int, lead int, print bigint"


@dataclass(frozen=True)
class Passages:
    """Repeated strings of `length` bytes, found by anchors of `key` bytes.

    With `words`, what such strings cover goes only where it is a run of so many
    words or of LENGTH bytes; words cut at the ends of the run count.
    """

    length: int = LENGTH
    key: int = LENGTH // 4
    words: int = 0

    def __post_init__(self):
        if self.length < 2 * PERIOD or not 0 < self.key <= self.length:
            raise ValueError(f"a passage has {2 * PERIOD} bytes at least, a key between 1 byte and the passage's")

    @property
    def reach(self) -> int:
        """Ranks of sampled places reach so far: PERIOD doubled as often as the string has room for."""
        reach = PERIOD
        while 2 * reach <= self.length - PERIOD:
            reach *= 2
        return reach


def difference_cover(period: int) -> list[int]:
    """Residues such that any two places reach sampled ones after the same number of bytes below `period`."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len(missing & {(s * (x - c)) % period for c in cover for s in (1, -1)})
        best = max(range(period), key=gain)
        missing -= {(s * (best - c)) % period for c in cover for s in (1, -1)}
        cover.append(best)
    return sorted(cover)


_COVER = difference_cover(PERIOD)
#: From each residue, the steps to the next sampled place.
_STEPS = np.array([min((c - r) % PERIOD for c in _COVER) for r in range(PERIOD)])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, rule: Passages = Passages()) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text, first start, number of starts, anchor's place, anchor hash, fingerprint."""
    n, span = len(data), rule.length - rule.key + 1
    if n < rule.length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    prints = RangeHash(data)
    places = np.arange(n - rule.key + 1)
    keys = prints.of(places, places + rule.key)
    least = (keys & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + rule.length <= offsets[text + 1]
    starts, text, anchor = starts[inside], text[inside], anchor[inside]
    if not len(starts):
        return anchor_runs(data[:0], offsets, rule)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    counts = np.diff(np.append(new, len(starts)))
    first = starts[new]
    return text[new], first, counts, anchor[new], keys[anchor[new]], prints.of(first, first + counts - 1 + rule.length)


def find_runs(batches: Iterator[pa.RecordBatch], rule: Passages) -> Iterator[pa.RecordBatch]:
    """A row for each text and each different segment of it, with all places where the segment begins."""
    for batch in batches:
        for part in text_slices(batch, most=RUN_BYTES):
            data, offsets = utf8_bytes(part.column("text"))
            text, first, counts, place, anchor, prints = anchor_runs(data, offsets, rule)
            segment = (text, anchor, place - first, prints, counts)
            order = np.lexsort((first, *segment[::-1]))
            new = np.ones(len(order), bool)
            new[1:] = False
            for key in segment:
                own = key[order]
                new[1:] |= own[1:] != own[:-1]
            begin = np.flatnonzero(new)
            one = order[begin]
            at = pa.array(text[one])
            starts = pa.array((first - offsets[text])[order].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[one].view(np.int64)), part.column("doc_id").take(at), part.column("text_hash").take(at),
                    pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), starts),
                    pa.array(counts[one].astype(np.int32)), pa.array((place - first)[one].astype(np.int32)),
                    pa.array(prints[one].view(np.int64)),
                ],
                [field.split()[0] for field in RUNS.split(", ")],
            )


def cover_ranks(text: np.ndarray, sampled: np.ndarray, most: int) -> np.ndarray:
    """For each place of the text, the rank of the `most` bytes from there if it is sampled (else 0)."""
    prints = RangeHash(text)
    ranks = np.zeros(len(text), np.uint64)
    ranks[sampled] = np.unique(prints.of(sampled, sampled + PERIOD), return_inverse=True)[1]
    reach = PERIOD
    while reach < most:
        pairs = ranks[sampled] << np.uint64(32) | ranks[sampled + reach]
        ranks[sampled] = np.unique(pairs, return_inverse=True)[1]
        reach *= 2
    return ranks


def repeated_starts(anchors: np.ndarray, leads: np.ndarray, segments: list[bytes], rule: Passages = Passages()) -> list[np.ndarray]:
    """Which starts of each segment (of one block, whole buckets) have a string of the rule's length that another has too."""
    length, reach = rule.length, rule.reach
    sizes = np.array([len(s) for s in segments])
    shift = (-leads) % PERIOD
    room = (shift + sizes + PERIOD - 1) // PERIOD * PERIOD
    base = np.concatenate(([0], np.cumsum(room)))[:-1] + shift
    text = np.zeros(int(room.sum()) + reach + PERIOD, np.uint8)
    for at, segment in zip(base.tolist(), segments):
        text[at : at + len(segment)] = np.frombuffer(segment, np.uint8)
    places = np.arange(len(text) - reach - PERIOD)
    ranks = cover_ranks(text, places[np.isin(places % PERIOD, _COVER)], reach)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(segments)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    p = base[owner] + np.arange(first[-1]) - first[owner]
    prints = RangeHash(text)
    tail = p + length - reach - PERIOD  # the second sampled place begins here at the earliest
    near, far = p + _STEPS[p % PERIOD], tail + _STEPS[tail % PERIOD]
    order_by = (
        anchors[owner].view(np.uint64), (p - base[owner] - leads[owner]).astype(np.uint64), prints.of(p, p + PERIOD),
        ranks[near], ranks[far], prints.of(p + length - PERIOD, p + length),
    )
    # Between the first sampled place's reach and the second sampled place nothing is left out: 2 * reach + PERIOD > length.
    order = np.lexsort(order_by[::-1])
    same = np.ones(len(order) - 1, bool)
    for key in order_by:
        own = key[order]
        same &= own[1:] == own[:-1]
    repeated = np.zeros(len(order), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return np.split(repeated, first[1:-1])


def sort_buckets(batches: Iterator[pa.RecordBatch], rule: Passages) -> Iterator[pa.RecordBatch]:
    """Segments in order of their anchor; whole buckets are gathered to blocks, a block sorted at a time."""
    names = ["anchor", "lead", "print", "n_starts"]
    held: list[dict] = []
    size = 0

    def done(rows: list[dict]) -> pa.RecordBatch:
        anchors = np.array([r["anchor"] for r in rows], np.int64)
        found = repeated_starts(anchors, np.array([r["lead"] for r in rows]), [r["data"] for r in rows], rule)
        masks = [np.packbits(mask).tobytes() for mask in found]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)), pa.array(masks, pa.binary())], [*names, "mask"]
        )

    for batch in batches:
        for row in batch.to_pylist():
            if size > BLOCK_BYTES and row["anchor"] != held[-1]["anchor"]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row["data"])
    if held:
        yield done(held)


def repeated_ranges(documents: DataFrame, rule: Passages = Passages()) -> DataFrame:
    """doc_id, text_hash, found: per document with repeats, its segments (starts, n_starts, mask; no mask: all repeated)."""
    with small_batches(documents.sparkSession):
        return _repeated_ranges(documents, rule)


def _repeated_ranges(documents: DataFrame, rule: Passages) -> DataFrame:
    keyed = keyed_texts(documents)
    everything = runs = written(keyed.mapInArrow(tidy(partial(find_runs, rule=rule)), RUNS))
    # What is joined by a key is written first: a join of two plain shuffles can split a key with many rows.
    times = F.sum(F.size("starts")).alias("n")
    shared = written(runs.groupBy("anchor").agg(times).where("n > 1").select("anchor"))
    runs = written(runs.join(shared, "anchor"))
    discard(everything)
    # One row for each text of a segment: how often it occurs, and one place to read it from.
    segment = ["anchor", "lead", "print", "n_starts"]
    place = F.struct("doc_id", "text_hash", F.col("starts")[0].alias("start"))
    kinds = written(runs.groupBy(*segment).agg(times, F.min(place).alias("place")))
    texts = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    mixed_buckets = kinds.join(texts, "anchor")
    wanted = mixed_buckets.groupBy("place.doc_id", "place.text_hash").agg(
        F.collect_list(F.struct(*segment, "kinds", F.col("place.start").alias("start"))).alias("wanted")
    )
    bytes_of = F.expr("transform(wanted, w -> named_struct('anchor', w.anchor, 'lead', w.lead, 'print', w.print, 'n_starts', w.n_starts, 'kinds', w.kinds, 'data', substring(bytes, w.start + 1, w.n_starts + %d)))" % (rule.length - 1))
    one = same_keys(keyed, wanted).dropDuplicates(["doc_id", "text_hash"])
    segments = one.withColumn("bytes", F.col("text").cast("binary")).select(F.inline(bytes_of))
    segments = written(segments)
    hot = F.col("kinds") > HOT * LENGTH // rule.length
    cold = segments.where(~hot).drop("kinds")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = cold.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(
        tidy(partial(sort_buckets, rule=rule)), "anchor bigint, lead int, print bigint, n_starts int, mask binary"
    )
    masks = written(masks.unionAll(hot_masks(segments.where(hot).drop("kinds"), rule.length)))
    # Segments that occur more than once are repeated whole, whatever else is in the bucket.
    results = kinds.select(*segment, "n").join(masks, segment, "left")
    results = results.select(*segment, F.when(F.col("n") > 1, None).otherwise(F.col("mask")).alias("mask"), (F.col("n") > 1).alias("whole"))
    results = written(results.where("whole or mask is not null").drop("whole"))
    found = runs.join(results, segment).select("doc_id", "text_hash", F.struct("starts", "n_starts", "mask").alias("run"))
    found = written(found.groupBy("doc_id", "text_hash").agg(F.collect_set("run").alias("found")))
    for read_out in (shared, runs, kinds, texts, segments, masks, results):
        discard(read_out)
    return found


def hot_masks(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """The masks of segments in large buckets: each suffix is a row, counted where equal ones meet."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                data, offsets = utf8_bytes(part.column("data"))
                counts = part.column("n_starts").to_numpy()
                prints = RangeHash(data)
                owner = np.repeat(np.arange(len(counts)), counts)
                own = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                p = offsets[owner] + own
                whole, half = prints.of(p, p + length), prints.of(p + 7, p + length - 7)
                rows = [part.column(c).take(pa.array(owner)) for c in ("anchor", "lead", "print", "n_starts")]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(own.astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(half.view(np.int64))],
                    ["anchor", "lead", "print", "n_starts", "own", "whole", "half"],
                )

    schema = "anchor bigint, lead int, print bigint, n_starts int, own int, whole bigint, half bigint"
    rows = written(segments.mapInArrow(tidy(suffixes), schema))
    key = ["anchor", "whole", "half"]
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    starts = rows.join(twice, key).groupBy("anchor", "lead", "print", "n_starts").agg(F.collect_set("own").alias("owns"))
    bits = F.expr(
        "unhex(array_join(transform(sequence(0, (n_starts + 7) div 8 - 1), b -> lpad(hex(aggregate(sequence(0, 7), 0, (v, i) -> v * 2 + "
        "if(array_contains(owns, b * 8 + i), 1, 0))), 2, '0')), ''))"
    )
    return starts.select("anchor", "lead", "print", "n_starts", bits.alias("mask"))


def keyed_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def same_keys(keyed: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join by doc_id (null is a value like others) and hash of the text."""
    own = other.withColumnsRenamed({"doc_id": "d_", "text_hash": "h_"})
    return keyed.join(own, keyed["doc_id"].eqNullSafe(own["d_"]) & (keyed["text_hash"] == own["h_"]), how).drop("d_", "h_")


def covered(size: int, found: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """Which bytes of a text of `size` bytes repeated strings cover."""
    edges = np.zeros(size + 1, np.int64)
    for run in found or ():
        first, n = np.array(run["starts"], np.int64), run["n_starts"]
        if run["mask"] is None:
            last = first + n - 1
        else:
            own = np.flatnonzero(np.unpackbits(np.frombuffer(run["mask"], np.uint8))[:n])
            first = last = (first[:, None] + own).ravel()
        np.add.at(edges, first, 1)
        np.add.at(edges, last + length, -1)
    return np.cumsum(edges)[:size] > 0


def runs_of(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of true values begin and end."""
    steps = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def keep_short(text: bytes, gone: np.ndarray, words: int) -> np.ndarray:
    """`gone` without its runs of fewer than `words` words and under LENGTH bytes."""
    for first, last in zip(*runs_of(gone)):
        if last - first < LENGTH and len(text[first:last].split()) < words:
            gone[first:last] = False
    return gone


MADE = ("kept_bytes", "n_bytes", "n_removed", "n_spans")


def remove_repeats(documents: DataFrame, made: tuple[str, str, str, str] = MADE, rule: Passages = Passages(), spared: DataFrame | None = None) -> DataFrame:
    """All columns of `documents` and the four of `made`, names that it must not have.

    They are the bytes kept, the number of bytes, of bytes removed and of maximal
    removed runs. Texts are UTF-8 bytes, a null text is empty. A repeat may lie
    in the same document, and may overlap; what is judged is the input, never
    what is left. Both of two rows with the same doc_id and text count. Texts of
    `spared` (doc_id, text_hash as of `keyed_texts`) count but are not cut.
    """
    columns = documents.columns
    found, doc, text_hash, d, h = (free_name([*columns, *made], n) for n in ("found", "found_doc", "found_hash", "found_d", "found_h"))
    own = repeated_ranges(documents, rule)
    own = (own if spared is None else same_keys(own, spared, "left_anti")).toDF(d, h, found)
    keyed = documents.withColumns({doc: F.col("doc_id").cast("bigint"), text_hash: F.xxhash64("text")})
    joined = keyed.join(own, F.col(doc).eqNullSafe(F.col(d)) & (F.col(text_hash) == F.col(h)), "left").select(*columns, found)
    zeros = [F.lit(0).cast("bigint").alias(c) for c in made[1:]]
    out = joined.select(*columns, F.lit(b"").alias(made[0]), *zeros).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                rows = []
                for text, own_runs in zip(texts, part.column(found).to_pylist()):
                    text = text or b""
                    if not own_runs:
                        rows.append((text, len(text), 0, 0))
                        continue
                    gone = covered(len(text), own_runs, rule.length)
                    gone = keep_short(text, gone, rule.words) if rule.words else gone
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    rows.append((kept, len(text), int(gone.sum()), len(runs_of(gone)[0])))
                results = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), *results], [*columns, *made]
                )

    return joined.mapInArrow(tidy(cut), out)


def dedup_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    cut = remove_repeats(documents.select("doc_id", "text"))
    return cut.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
