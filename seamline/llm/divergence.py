"""Divergence of a language's sources from each other and from the language, by in-mapper stripes.

Each task folds whole documents into a hash table of stripes: per language and
term its document frequency and its count in every source. A full table is
spilled as rows and begun anew. Stripes are merged by (language, term), which a
hot source cannot crowd: it is one entry of a stripe, whatever its share of the
rows. Terms that few documents hold are left out of the merged stripes.

Divergences come directly from the merged stripes: each task turns blocks of
them into matrices of smoothed shares, adds up the divergence of every pair of
sources, and keeps the best terms of every source. Equal stripes are worked out
once and counted. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seamline.llm.places import numbered
from seamline.llm.texts import pieces
from seamline.work import written

#: A term counts in a language from so many of its documents on.
LEAST_DOCUMENTS = 3
#: Terms reported for each source; pairs of sources are reported all.
REPORTED = 200
#: Shares are whole numbers of parts of this.
UNIT = 1_000_000_000

#: A task holds so many (term, source) entries before it spills its stripes.
HELD = 300_000
#: So many sources are sent to the tasks in one pass, and a task's sums of their pairs have its square of cells; more take several passes.
SOURCES_AT_ONCE = 2_000
#: Blocks of shares have about so many cells.
_CELLS = 1_000_000

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_STRIPE = "lang string, term string, df bigint, stripe array<struct<source:string,n:bigint>>"


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of one document, A-Z lower-cased."""
    counts: Counter = Counter()
    for piece in pieces(text, _LETTER):
        counts.update(_TERM.findall(piece.lower()))
    return counts


class Stripes:
    """Document frequency and source counts of terms, as far as a task has seen them."""

    def __init__(self, most: int):
        self.most, self.size, self.of = most, 0, {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        terms = self.of.setdefault(lang, {})
        for term, n in term_counts(text).items():
            stripe = terms.get(term)
            if stripe is None:
                terms[term] = [1, {source: n}]
                self.size += 1
            else:
                stripe[0] += 1
                counts = stripe[1]
                if source in counts:
                    counts[source] += n
                else:
                    counts[source] = n
                    self.size += 1

    def full(self) -> bool:
        return self.size >= self.most

    def spilled(self, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        """All stripes as batches of `rows` rows; the table is empty afterwards."""
        entry = pa.struct([("source", pa.string()), ("n", pa.int64())])
        for lang, terms in self.of.items():
            names = list(terms)
            for at in range(0, len(names), rows):
                some = names[at : at + rows]
                found = [terms[t] for t in some]
                sizes = np.array([0] + [len(f[1]) for f in found])
                entries = pa.StructArray.from_arrays(
                    [pa.array([s for f in found for s in f[1]], pa.string()), pa.array([n for f in found for n in f[1].values()], pa.int64())],
                    fields=list(entry),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                        pa.array([f[0] for f in found], pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), entries),
                    ],
                    ["lang", "term", "df", "stripe"],
                )
        self.size, self.of = 0, {}


def fold_stripes(documents: DataFrame, most: int = HELD) -> DataFrame:
    """Stripes as the tasks spill them: lang, term, df, stripe; null text, lang and source are ''."""
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes(most)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                held.add(lang, source, text.as_py())
                if held.full():
                    yield from held.spilled()
        yield from held.spilled()

    return rows.mapInArrow(fold, _STRIPE)


def merged_stripes(spilled: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One stripe per language and term, of terms in at least `least` documents.

    Spilled rows are dealt by (lang, term); within that dealing entries are
    added up per source by an aggregation that may spill, so no task holds more
    of a term than its sources.
    """
    dealt = spilled.repartition("lang", "term")
    # df rides on one entry of each spilled stripe.
    entries = dealt.select("lang", "term", F.posexplode("stripe").alias("i", "entry"), "df").select(
        "lang", "term", "entry.source", "entry.n", F.when(F.col("i") == 0, F.col("df")).otherwise(0).alias("df")
    )
    summed = entries.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    stripes = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("stripe"))
    return stripes.where(F.col("df") >= least)


def source_totals(documents: DataFrame, stripes: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs: number, own (N of the source), whole (N of the language), terms (V)."""
    by_source = stripes.select("lang", F.explode("stripe").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("own"))
    by_lang = stripes.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.expr("aggregate(stripe, 0L, (s, e) -> s + e.n)")).alias("whole"))
    groups = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    known = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("own", "whole", "terms")), F.lit(0).alias("all")
    )
    return written(numbered(written(known), "all", ["lang", "source"], "number", "n_groups").drop("all"))


def shares(counts: np.ndarray, own: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (N + V)), a few digits at a time so that nothing overflows below 9e17 occurrences."""
    total = own + terms
    step, digits = (1000, 3) if total.max(initial=0) < 9 * 10**15 else (10, 9)
    whole, rest = np.divmod(counts + 1, total)
    made = whole
    for _ in range(digits):
        rest = rest * step
        digit = rest // total
        rest = rest - digit * total
        made = made * step + digit
    return made + 1


@dataclass
class Totals:
    """A bounded run of consecutive rows of `source_totals`, as arrays; rows of a language are neighbours."""

    number: np.ndarray
    lang: list[str]
    source: list[str]
    own: np.ndarray
    whole: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> "Totals":
        table = table.sort_by("number")
        arrays = {c: table.column(c).to_numpy().astype(np.int64) for c in ("number", "own", "whole", "terms")}
        return cls(arrays["number"], table.column("lang").to_pylist(), table.column("source").to_pylist(), arrays["own"], arrays["whole"], arrays["terms"])

    def by_lang(self) -> dict[str, tuple[int, int, dict[str, int]]]:
        """Per language its first row, the row after its last, and the row of each source."""
        found: dict[str, tuple[int, int, dict[str, int]]] = {}
        for i, (lang, source) in enumerate(zip(self.lang, self.source)):
            first, _, rows = found.get(lang, (i, i, {}))
            rows[source] = i - first
            found[lang] = (first, i + 1, rows)
        return found


def _matrix(stripes: pa.ListArray, rows: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by stripe and source (those of `rows`), and of all sources together."""
    entries = stripes.flatten()
    of = np.repeat(np.arange(len(stripes)), stripes.value_lengths().to_numpy())
    n = entries.field("n").to_numpy()
    names = entries.field("source").dictionary_encode()
    place = np.array([rows.get(name, -1) for name in names.dictionary.to_pylist()] + [-1])[names.indices.to_numpy()]
    counts = np.zeros((len(stripes), len(rows)), np.int64)
    here = place >= 0
    counts[of[here], place[here]] = n[here]
    whole = np.zeros(len(stripes), np.int64)
    np.add.at(whole, of, n)
    return counts, whole


def pair_sums(p: np.ndarray, q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each column of p against each of q the sum over rows of floor((p - q)^2 / q), row i counted times[i] times."""
    sums = np.empty((p.shape[1], q.shape[1]), np.int64)
    for i in range(p.shape[1]):
        apart = p[:, i : i + 1] - q
        sums[i] = times @ (apart * apart // q)
    return sums


class Divergences:
    """What one task adds up from the stripes it sees: pairs of sources of `one` and `two`, and best terms of `one`."""

    def __init__(self, one: Totals, two: Totals, reported: int):
        self.one, self.two, self.reported = one, two, reported
        self.of_one, self.of_two = one.by_lang(), two.by_lang()
        self.same = one is two
        self.pairs: dict[str, np.ndarray] = {}
        self.best: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.n_best = 0

    def add(self, lang: str, names: pa.Array, stripes: pa.ListArray) -> None:
        if lang not in self.of_one or lang not in self.of_two:
            return
        (first, last, rows), (first2, last2, rows2) = self.of_one[lang], self.of_two[lang]
        here, there = slice(first, last), slice(first2, last2)
        counts, whole = _matrix(stripes, rows)
        counts2 = counts if self.same else _matrix(stripes, rows2)[0]
        kinds, at, times = np.unique(counts if self.same else np.hstack((counts, counts2)), axis=0, return_index=True, return_counts=True)
        p = shares(counts[at], self.one.own[here], self.one.terms[here])
        q = p if self.same else shares(counts2[at], self.two.own[there], self.two.terms[there])
        sums = pair_sums(p, q, times)
        self.pairs[lang] = self.pairs[lang] + sums if lang in self.pairs else sums
        if self.same:
            self._terms(first, here, counts, whole, names)

    def _terms(self, first: int, here: slice, counts: np.ndarray, whole: np.ndarray, names: pa.Array) -> None:
        q = shares(whole, self.one.whole[here][:1], self.one.terms[here][:1])
        p = shares(counts, self.one.own[here], self.one.terms[here])
        at, place = np.nonzero((counts > 0) & (p > q[:, None]))
        apart = p[at, place] - q[at]
        self.best.append((place + first, apart * apart // q[at], names.take(pa.array(at))))
        self.n_best += len(at)
        if self.n_best > 500_000:
            self._cut()

    def _cut(self) -> None:
        """Keeps the best terms of each source alone."""
        if not self.best:
            return
        group, value = (np.concatenate([b[i] for b in self.best]) for i in (0, 1))
        names = pa.concat_arrays([b[2] for b in self.best])
        table = pa.table({"group": group, "value": value, "name": names.cast(pa.binary())})
        order = pa.compute.sort_indices(table, [("group", "ascending"), ("value", "descending"), ("name", "ascending")]).to_numpy()
        group = group[order]
        kept = order[np.arange(len(order)) - np.searchsorted(group, group) < self.reported]
        self.best = [(table.column("group").to_numpy()[kept], value[kept], names.take(pa.array(kept)))]
        self.n_best = len(kept)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """number (of the source), other (number, for pairs), item (for terms), value; sums start anew."""
        for lang, sums in self.pairs.items():
            first, last, _ = self.of_one[lang]
            first2, last2, _ = self.of_two[lang]
            mine, other = self.one.number[first:last], self.two.number[first2:last2]
            n = sums.size
            yield _rows(np.repeat(mine, len(other)), np.tile(other, len(mine)), pa.nulls(n, pa.string()), sums.ravel())
        self.pairs = {}
        self._cut()
        for group, value, names in self.best:
            yield _rows(self.one.number[group], np.full(len(group), -1), names, value)
        self.best, self.n_best = [], 0


def _rows(number, other, item, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(number, pa.int64()), pa.array(other, pa.int64()), item, pa.array(value, pa.int64())],
        ["number", "other", "item", "value"],
    )


def emitted(stripes: DataFrame, one: Totals, two: Totals | None, reported: int) -> DataFrame:
    """Sums of pairs (number, other, null, value) and best terms (number, -1, item, value), as each task has them."""
    shared = stripes.sparkSession.sparkContext.broadcast((one, two))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        made = Divergences(one, two or one, reported)
        width = max([last - first for first, last, _ in made.of_one.values()] + [1])
        step = max(1, _CELLS // width)
        for batch in batches:
            langs = batch.column("lang")
            for lang in pa.compute.unique(langs).to_pylist():
                own = batch.filter(pa.compute.equal(langs, lang))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    made.add(lang, part.column("term"), part.column("stripe"))
        yield from made.rows()

    return stripes.select("lang", "term", "stripe").mapInArrow(emit, "number bigint, other bigint, item string, value bigint")


def source_divergence(documents: DataFrame, reported: int = REPORTED, at_once: int = SOURCES_AT_ONCE, most: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others and from the language.

    Terms are runs of ASCII letters (A-Z as a-z) and of bytes beyond ASCII; those
    in at least LEAST_DOCUMENTS documents of the language are kept. A share is
    1 + floor(UNIT * (count + 1) / (N + V)), a divergence floor((p - q)^2 / q).
    Part `pair`: item is each other source, value the sum over all kept terms, 0
    where there are none. Part `term`: item is a kept term that the source has
    and uses more than the language does, to `reported` ranks. Higher values rank
    first, then the lower item by bytes. Null text, lang and source are ''. A
    source without terms has pairs and no term rows; a language with one source
    has no pairs. Repeated rows count as often as they occur; no rows, no result.

    The tasks get the sources in runs of `at_once` rows; where a language has
    more, each pair of runs is a pass of its own over the stripes. A task spills
    its stripes at `most` entries.
    """
    stripes = written(merged_stripes(fold_stripes(documents, most)))
    groups = source_totals(documents, stripes)
    runs = groups.groupBy(F.expr(f"number div {at_once}").alias("run")).agg(
        F.min(F.struct("number", "lang")).alias("first"), F.max(F.struct("number", "lang")).alias("last")
    ).orderBy("run").collect()
    parts = []
    for a in runs:
        for b in runs:
            # Runs that share no language have no pairs.
            if a.run != b.run and not (a.first.lang <= b.last.lang and b.first.lang <= a.last.lang):
                continue
            one, two = (Totals.of(groups.where(F.expr(f"number div {at_once}") == r.run).toArrow()) for r in (a, b))
            parts.append(written(emitted(stripes, one, None if a.run == b.run else two, reported)))
    if not parts:
        parts = [emitted(stripes.limit(0), Totals.of(groups.toArrow()), None, reported)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionAll(more)
    names = groups.select("number", "lang", "source")
    pairs = rows.where("other >= 0 and number <> other").groupBy("number", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(names, "number").join(names.select(F.col("number").alias("other"), F.col("source").alias("item")), "other")
    # Sources of languages without kept terms have pairs of value 0.
    bare = groups.where("terms = 0").select("number", "lang", "source")
    bare = bare.join(bare.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), "lang").where("number <> other")
    pairs = pairs.select("lang", "source", "item", "value").unionAll(bare.select("lang", "source", "item", F.lit(0).cast("bigint").alias("value")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = rows.where("other < 0").join(names, "number").select("lang", "source", F.lit("term").alias("part"), "item", "value")

    def ranked(table: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        return table.withColumn("rank", F.row_number().over(order))

    return ranked(pairs).unionAll(ranked(terms).where(F.col("rank") <= reported))
