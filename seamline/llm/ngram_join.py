"""N-gram Jaccard join: grouped prefix join over sets of word shingles.

Sets are ordered by one global order, frequent shingles last. Two sets that are
similar enough share a shingle among the first `n - least overlap + 1` of each
(their prefixes). Documents with one set are one member; members with the same
prefix and size form one group, and only groups enter the join. Shared shingles
give pairs of groups, filtered by size and by how many shingles can still be
common after the first shared one; the pairs that are left are expanded to their
members and verified on whole sets.

Components need no pair whose ends are linked already, so the join runs in two
rounds: first every group against one pivot, then, after the links found so far
are contracted, all pairs between different components.
`jaccard_links` gives all links instead.

Counts for the order are heuristic where that is safe: any set of frequent
shingles gives a valid order, so they may come from counts inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.llm.components import components
from seamline.llm.texts import mixed, small_batches, text_slices, tidy, utf8_bytes, word_hashes
from seamline.work import discard, written

#: At most so many shingles are moved to the end of the order; their hashes (8 bytes each) are broadcast.
FREQUENT = 1 << 16
#: Shingles that a task remembers before it passes on those that it has met twice.
COUNTED = 1_000_000

_WEIGHTS = [mixed(np.array([i + 1], np.uint64))[0] for i in range(64)]


@dataclass(frozen=True)
class Similarity:
    """Shingles of `width` words; sets are similar when 100 |A & B| >= percent |A | B|."""

    width: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        """How many shingles, in the global order, must hold one that any similar set shares."""
        return n - -(-self.percent * n // 100) + 1 if n else 0


def document_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; empty without words."""
    data, offsets = utf8_bytes(texts)
    words, first = word_hashes(data, offsets)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        k = min(width, n)
        if not k:
            sets.append(np.empty(0, np.uint64))
            continue
        total = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            total = total + words[a + i : a + i + n - k + 1] * _WEIGHTS[i]
        sets.append(np.unique(mixed(total)))
    return sets


def frequent_shingles(documents: DataFrame, rule: Similarity) -> np.ndarray:
    """Hashes of the shingles that most documents have, as far as they recur inside a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often], pa.int64())], ["shingle", "n"]
            )

        for batch in batches:
            for part in text_slices(batch):
                for own in document_sets(part.column("text"), rule.width):
                    held.append(own)
                    size += len(own)
                if size > COUNTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = documents.select("text").mapInArrow(tidy(count), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = counts.where("n >= 8").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    return np.sort(most.column("shingle").to_numpy().view(np.uint64))


def member_sets(documents: DataFrame, rule: Similarity, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, two signatures of the set, its prefix in the global order, and how many at its end are frequent."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            for part in text_slices(batch):
                sets = document_sets(part.column("text"), rule.width)
                prefixes, ends = [], []
                for own in sets:
                    at = np.searchsorted(late, own)
                    often = late[np.minimum(at, len(late) - 1)] == own if len(late) else np.zeros(len(own), bool)
                    ordered = np.concatenate((own[~often], own[often]))
                    prefixes.append(ordered[: rule.prefix(len(own))].view(np.int64))
                    ends.append(max(0, len(prefixes[-1]) - int((~often).sum())))
                sums = [(int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ _WEIGHTS[7]).sum(dtype=np.uint64).view(np.int64))) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()),
                        pa.array(prefixes, pa.list_(pa.int64())), pa.array(ends, pa.int32()),
                    ],
                    ["doc_id", "n", "s1", "s2", "prefix", "late"],
                )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(rows.mapInArrow(tidy(describe), "doc_id bigint, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, late int"))


def most_common(p: np.ndarray, q: np.ndarray, n: int, m: int, late_p: int, late_q: int) -> int:
    """The most shingles that sets of n and m can share, given the upper halves of their prefixes in the global order.

    `late_p` and `late_q` at the ends are frequent. Before the last of the prefix
    that ends first all shingles of both are known; from there on at most the
    rest of the smaller remainder is common. Different shingles with one upper
    half can only make the bound larger.
    """
    end_late, end = min((late_p > 0, int(p[-1])), (late_q > 0, int(q[-1])))

    def known(values: np.ndarray, n_late: int) -> int:
        split = len(values) - n_late
        if end_late:
            return split + int(np.searchsorted(values[split:], np.uint32(end)))
        return int(np.searchsorted(values[:split], np.uint32(end)))

    a, b = known(p, late_p), known(q, late_q)
    return int(np.isin(p[:a], q[:b]).sum()) + min(n - a, m - b)


class Join:
    """The tables of one join."""

    def __init__(self, documents: DataFrame, rule: Similarity = Similarity()):
        self.documents, self.rule = documents, rule
        self.frequent = frequent_shingles(documents, rule)
        self.described = member_sets(documents, rule, self.frequent)
        known = self.described.where("n > 0 and doc_id is not null")
        # One member per set, one group per prefix and size.
        members = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("member"), F.count("*").alias("copies"))
        self.members = written(members)
        front = known.select("n", "s1", "s2", "doc_id", F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2"))
        placed = front.join(self.members, ["n", "s1", "s2"]).where("doc_id = member").distinct()
        groups = placed.groupBy("n", "p1", "p2").agg(F.min("member").alias("g"), F.sum("copies").alias("copies"))
        # Written: while they are few, Spark sends the groups to the prefixes, which then stay where they are.
        groups = written(groups)
        self.grouped = written(placed.join(groups.drop("copies"), ["n", "p1", "p2"]).select("g", "member", "n"))
        fronts = known.select(F.col("doc_id").alias("g"), "n", "prefix").join(groups.select("g", "n", "copies"), ["g", "n"])
        tokens = fronts.select("g", "n", "copies", F.posexplode("prefix").alias("pos", "shingle"))
        often = tokens.groupBy("shingle").agg(F.count("*").alias("groups")).where("groups > 1")
        # Size and place travel as one number.
        packed = tokens.select("shingle", "g", "copies", (F.shiftleft("n", 31) + F.col("pos")).alias("at"))
        kept = packed.join(often, "shingle")
        self.tokens = written(kept.select(
            "shingle", "g", "copies", F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND((1 << 31) - 1).cast("int").alias("pos")
        ))

    def _fits(self, n: str, m: str):
        p = self.rule.percent
        return (F.col(n) * 100 >= F.col(m) * p) & (F.col(m) * 100 >= F.col(n) * p)

    def pivot_pairs(self) -> DataFrame:
        """Each group with one other: of the pivots of its shingles, the one that most of them name."""
        most = F.struct("copies", (-F.col("g")).alias("order"), "g", "n")
        # A set near the middle of a cluster has few shingles of its own, so shared ones come early in its prefix.
        early, small = F.struct("pos", "g", "n"), F.struct("n", "g")
        pivots = self.tokens.groupBy("shingle").agg(F.max(most).alias("most"), F.min(early).alias("early"), F.min(small).alias("small"))
        each = [F.struct(F.col(f"{k}.g").alias("pg"), F.col(f"{k}.n").alias("pn")) for k in ("most", "early", "small")]
        listed = pivots.select("shingle", F.explode(F.array_distinct(F.array(*each))).alias("pivot")).select("shingle", "pivot.*")
        met = self.tokens.join(listed, "shingle").where(self._fits("n", "pn") & (F.col("g") != F.col("pg")))
        named = met.groupBy("g", "pg").agg(F.count("*").alias("times"))
        best = named.groupBy("g").agg(F.max(F.struct("times", (-F.col("pg")).alias("order"), "pg")).alias("best"))
        return best.select(F.least("g", "best.pg").alias("a"), F.greatest("g", "best.pg").alias("b")).distinct()

    def all_pairs(self, component: DataFrame | None) -> DataFrame:
        """All pairs of groups that share a shingle and may be similar; those of different components if given.

        A group without a row in `component` is torn: all its pairs count.
        """
        tokens = self.tokens
        if component is not None:
            own = component.withColumnRenamed("id", "g")
            # A torn group has no component here: some member of it differs from any other group's component.
            tokens = tokens.join(own, "g", "left")
            mixed_ones = tokens.groupBy("shingle").agg(
                F.min("component").alias("c1"), F.max("component").alias("c2"), F.max(F.col("component").isNull()).alias("torn")
            )
            tokens = tokens.join(mixed_ones.where("torn or c1 <> c2").select("shingle"), "shingle", "left_semi")
        else:
            tokens = tokens.withColumn("component", F.col("g"))
        # Similar sizes lie in one band or in neighbouring ones, so long lists of a shingle are split by size.
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / self.rule.percent)) + 1e-9)
        tokens = written(tokens.select("shingle", "g", "n", "pos", "component", band.alias("band")))
        left = tokens.select("shingle", F.col("g").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"), "band")
        right = tokens.select(
            "shingle", F.col("g").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"),
            F.explode(F.array("band", F.col("band") - 1)).alias("band"),
        )
        larger = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") > F.col("a")))
        p = self.rule.percent
        # A pair counts at its first common shingle, after which only the rest of both can be common.
        reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        able = reach * (100 + p) >= (F.col("na") + F.col("nb")) * p
        apart = F.coalesce(F.col("ca") != F.col("cb"), F.lit(True))
        met = left.join(right, ["shingle", "band"]).where(larger & self._fits("na", "nb") & apart & able)
        return met.select("a", "b").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Member pairs (a, b, common, either) that are similar, of pairs of groups (a, b)."""
        of = self.grouped.select("g", "member")
        expanded = (
            pairs.join(of.select(F.col("g").alias("a"), F.col("member").alias("x")), "a")
            .join(of.select(F.col("g").alias("b"), F.col("member").alias("y")), "b").select("x", "y")
        )
        return self.checked(expanded)

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) whose prefixes leave room for enough common shingles; whole sets travel for these only."""
        percent = self.rule.percent

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(c) for c in ("p", "q")]
                sizes = zip(*(batch.column(c).to_pylist() for c in ("n", "m", "late_p", "late_q")))
                kept = []
                for i, (n, m, *late) in enumerate(sizes):
                    p, q = (c[i].values.to_numpy().view(np.uint32) for c in columns)
                    if most_common(p, q, n, m, *late) * (100 + percent) >= (n + m) * percent:
                        kept.append(i)
                at = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("x").take(at), batch.column("y").take(at)], ["x", "y"])

        # Prefixes of the documents in pairs alone are moved to the pairs, by the upper halves of their hashes.
        ids = written(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
        halves = F.transform("prefix", lambda x: F.shiftright(x, 32).cast("int")).alias("prefix")
        known = self.described.where("n > 0").select("doc_id", "n", "late", halves)
        known = written(known.join(ids, "doc_id", "left_semi"))
        both = pairs.join(known.toDF("x", "n", "late_p", "p"), "x").join(known.toDF("y", "m", "late_q", "q"), "y")
        able = written(both.select("x", "y", "n", "m", "late_p", "late_q", "p", "q").mapInArrow(tidy(bound), "x bigint, y bigint").distinct())
        discard(known)
        return able

    def checked(self, pairs: DataFrame) -> DataFrame:
        """Similar ones of pairs of members (x, y), with the size of intersection and union."""
        pairs = written(pairs.where("x <> y").distinct())
        pairs = self._possible(pairs)
        wanted = pairs.select(F.col("x").alias("doc_id")).unionAll(pairs.select(F.col("y").alias("doc_id"))).distinct()
        width, percent = self.rule.width, self.rule.percent

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch):
                    packed = [own.tobytes() for own in document_sets(part.column("text"), width)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "own"])

        texts = self.documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(written(wanted), "doc_id", "left_semi")
        sets = written(texts.mapInArrow(tidy(pack), "doc_id bigint, own binary"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = []
                for i, (one, two) in enumerate(zip(batch.column("one"), batch.column("two"))):
                    one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two))
                    joined = np.concatenate((one, two))
                    joined.sort(kind="stable")
                    common = int((joined[1:] == joined[:-1]).sum())
                    either = len(joined) - common
                    if 100 * common >= percent * either:
                        kept.append((i, common, either))
                at = pa.array([k[0] for k in kept], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("x").take(at), batch.column("y").take(at), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64())],
                    ["a", "b", "common", "either"],
                )

        both = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("own").alias("one")), "x")
        both = both.join(sets.select(F.col("doc_id").alias("y"), F.col("own").alias("two")), "y").select("x", "y", "one", "two")
        found = written(both.mapInArrow(tidy(compare), "a bigint, b bigint, common bigint, either bigint"))
        discard(sets)
        return found

    def inside_pairs(self) -> DataFrame:
        """Members of a group with the group's first member."""
        return self.grouped.where("g <> member").select(F.col("g").alias("x"), F.col("member").alias("y"))


def jaccard_components(documents: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, A-Z lower-cased; a text of
    fewer words than a shingle is one shingle of all of them. A text without
    words, or null, has an empty set, is linked with nothing and is its own
    component. Documents with the same set are linked. A document with a null
    doc_id gets a null component and links with nothing. Rows that repeat a
    doc_id all take part under that id and get a row each.
    """
    with small_batches(documents.sparkSession):
        join = Join(documents, rule)
        links = rounds(join)
        found = written(components(links.select("a", "b")))
    copies = join.described.where("n > 0 and doc_id is not null").select("n", "s1", "s2", "doc_id")
    placed = copies.join(join.members.drop("copies"), ["n", "s1", "s2"]).select("doc_id", "member").distinct()
    placed = placed.join(found.withColumnRenamed("id", "member"), "member", "left")
    placed = placed.select("doc_id", F.coalesce("component", "member").alias("component_id"))
    placed = placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return join.described.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def rounds(join: Join) -> DataFrame:
    """Links between members that connect all components."""
    first = join.verified(join.pivot_pairs()).unionAll(join.checked(join.inside_pairs()))
    first = written(first)
    component = written(components(first))
    # A group stands for all its members only where these are in one component; else each is a group of its own.
    split = join.grouped.join(component.withColumnRenamed("id", "member"), "member", "left").withColumn(
        "component", F.coalesce("component", "member")
    )
    torn = split.groupBy("g").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    whole = torn.where("c1 = c2").select(F.col("g").alias("id"), F.col("c1").alias("component"))
    inside = split.join(torn.where("c1 <> c2").select("g"), "g", "left_semi").select("g", "member", "component")
    within = inside.join(inside.select("g", F.col("member").alias("other"), F.col("component").alias("oc")), "g")
    within = within.where("member < other and component <> oc").select(F.col("member").alias("x"), F.col("other").alias("y"))
    second = join.verified(join.all_pairs(whole)).unionAll(join.checked(within))
    return first.unionAll(written(second))


def jaccard_links(documents: DataFrame, rule: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """All links between different sets (a, b, common, either), and the members: doc_id, member, n_shingles.

    `member` is the smallest doc_id with the same set and stands for all of them.
    """
    with small_batches(documents.sparkSession):
        join = Join(documents, rule)
        pairs = join.grouped.select("g", F.col("member").alias("x"))
        inside = pairs.join(pairs.select("g", F.col("x").alias("y")), "g").where("x < y").select("x", "y")
        links = join.verified(join.all_pairs(None)).unionAll(join.checked(inside))
    copies = join.described.where("n > 0 and doc_id is not null")
    members = copies.join(join.members.drop("copies"), ["n", "s1", "s2"]).select("doc_id", "member", F.col("n").alias("n_shingles"))
    return links, members
