"""Sets of ids as sorted intervals: what is out of use is left out while vectors are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seamline.work import work_folder, written

#: Intervals that a scan task holds at once, 16 bytes each.
INTERVALS_AT_ONCE = 1_000_000

#: Slices that are scans of their own; each adds a branch to the plan, so more of them meet the vectors in a shuffle.
_MOST_SLICES = 8


@dataclass
class Intervals:
    """Disjoint intervals (both ends included), ascending."""

    first: np.ndarray
    last: np.ndarray

    def hold(self, ids: np.ndarray) -> np.ndarray:
        """Which of `ids` lie in an interval, by binary search."""
        if not len(self.first):
            return np.zeros(len(ids), bool)
        at = np.searchsorted(self.first, ids, "right") - 1
        return (at >= 0) & (ids <= self.last[np.maximum(at, 0)])


def merged(intervals: DataFrame) -> DataFrame:
    """Intervals (first_id, last_id) in ranges of ids; those that touch or overlap inside a range are one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_first = open_last = None
        for batch in batches:
            first, last = (batch.column(c).to_numpy() for c in ("first_id", "last_id"))
            if not len(first):
                continue
            if open_first is not None:
                first, last = np.append(open_first, first), np.append(open_last, last)
            reach = np.maximum.accumulate(last)
            opens = np.concatenate(([True], first[1:] > reach[:-1] + 1))
            starts = np.flatnonzero(opens)
            ends = np.append(starts[1:], len(first)) - 1
            first, last = first[starts], reach[ends]
            open_first, open_last = first[-1], last[-1]
            yield pa.RecordBatch.from_arrays([pa.array(first[:-1]), pa.array(last[:-1])], ["first_id", "last_id"])
        if open_first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_first]), pa.array([open_last])], ["first_id", "last_id"])

    ordered = intervals.select("first_id", "last_id").repartitionByRange("first_id").sortWithinPartitions("first_id", "last_id")
    return ordered.mapInArrow(merge, "first_id bigint, last_id bigint")


def as_intervals(ids: DataFrame) -> DataFrame:
    """Ids (vector_id) as intervals."""
    return merged(ids.select(F.col("vector_id").alias("first_id"), F.col("vector_id").alias("last_id")))


def _slice_of(column: str, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above the column, by binary search."""
    steps, known = [1 << i for i in reversed(range(len(bounds).bit_length()))], F.lit(bounds)

    def narrow(below, more):
        return F.when(F.get(known, below + more - 1) <= F.col(column), below + more).otherwise(below)

    return F.aggregate(F.lit(steps), F.lit(0), narrow) if bounds else F.lit(0)


class Dead:
    """Intervals of ids out of use, in slices small enough to be sent to the tasks.

    The slices share out the range of ids, so each vector meets one of them:
    there is one scan of each vector, however many intervals there are. A few
    slices are filters of as many scans; of more the intervals are rows that meet
    the vectors in one shuffle, and nothing of them passes the driver.
    """

    def __init__(self, intervals: DataFrame, at_once: int = INTERVALS_AT_ONCE):
        self.spark, self.at_once = intervals.sparkSession, at_once
        self.table = written(merged(intervals))
        self.n = self.table.count()

    @cached_property
    def bounds(self) -> list[int]:
        """Ids at which a slice begins, but for the first; a slice has at most `at_once` intervals."""
        if self.n <= self.at_once:
            return []
        slices, folder = -(-self.n * 5 // (4 * self.at_once)), work_folder(self.spark)
        while True:
            dealt = self.table.repartitionByRange(slices, "first_id").withColumn("slice", F.spark_partition_id())
            sizes = written(dealt, f"{folder}/slices={slices}").groupBy("slice").agg(F.count("*").alias("n"), F.min("first_id").alias("first"))
            rows = sizes.orderBy("first").collect()
            if max(r["n"] for r in rows) <= self.at_once:
                return [r["first"] for r in rows[1:]]
            slices *= 2

    @property
    def in_slices(self) -> bool:
        """Whether the tasks get all intervals, in few slices."""
        return self.n <= self.at_once * _MOST_SLICES

    def alive(self, rows: DataFrame) -> DataFrame:
        """`rows` (with a vector_id) whose id is in no interval, by one shuffle into ranges of ids.

        Bounds come from the ids of the rows. Each range gets every interval that
        reaches into it; in id order, intervals first, a row is out of use if one
        before it reaches so far.
        """
        tasks, columns = int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows.columns
        shares = [i / tasks for i in range(1, tasks)] or [0.5]
        found = rows.agg(F.percentile_approx("vector_id", shares, 10 * tasks)).first()[0]
        bounds = sorted(set(found or ()))
        own = rows.where(F.col("vector_id").isNotNull()).select(
            _slice_of("vector_id", bounds).alias("_slice"), F.col("vector_id").alias("_first"), F.lit(None).cast("bigint").alias("_last"), *columns
        )
        reached = F.sequence(_slice_of("first_id", bounds), _slice_of("last_id", bounds))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        gone = self.table.select(F.explode(reached).alias("_slice"), F.col("first_id").alias("_first"), F.col("last_id").alias("_last"), *blank)
        dealt = own.unionAll(gone).repartitionById(len(bounds) + 1, "_slice")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = np.iinfo(np.int64).min
            reach = least
            for batch in batches:
                is_row = batch.column("_last").is_null().to_numpy(zero_copy_only=False)
                last = batch.column("_last").fill_null(least).to_numpy()
                reaches = np.maximum.accumulate(np.append(reach, last))[1:]
                reach = reaches[-1] if len(reaches) else reach
                yield batch.filter(pa.array(is_row & (batch.column("_first").to_numpy() > reaches))).select(columns)

        ordered = dealt.sortWithinPartitions("_first", F.col("_last").isNull()).drop("_slice")
        return ordered.mapInArrow(keep, own.select(*columns).schema)

    def parts_alive(self, vectors: DataFrame) -> list[tuple[DataFrame, Intervals | None]]:
        """The vectors in parts with what is still to be left out of each."""
        return self.parts(vectors) if self.in_slices else [(written(self.alive(vectors)), None)]

    def parts(self, vectors: DataFrame) -> list[tuple[DataFrame, Intervals]]:
        """The vectors by slice, each with its intervals."""
        edges, found = [None, *self.bounds, None], []
        for low, high in zip(edges, edges[1:]):
            own, rows = self.table, vectors
            for column, table in (("first_id", "own"), ("vector_id", "rows")):
                inside = F.lit(True) if low is None else F.col(column) >= low
                inside = inside if high is None else inside & (F.col(column) < high)
                if table == "own":
                    own = own.where(inside)
                else:
                    rows = rows.where(inside)
            block = own.toArrow().sort_by("first_id")
            intervals = Intervals(block.column("first_id").to_numpy(), block.column("last_id").to_numpy())
            found.append((rows, intervals))
        # An interval may reach into the next slice.
        for (_, before), (_, after) in zip(found, found[1:]):
            if len(before.last) and len(after.first) and before.last[-1] >= after.first[0]:
                raise ValueError("intervals of ids out of use overlap")
        return found


def without(rows: DataFrame, dead: Dead) -> DataFrame:
    """`rows` (with a vector_id) whose id is in no interval; rows stay where they are unless the intervals are very many."""
    if not dead.in_slices:
        return dead.alive(rows)
    kept = None
    for part, intervals in dead.parts(rows):
        shared = rows.sparkSession.sparkContext.broadcast(intervals)

        def alive(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~shared.value.hold(batch.column("vector_id").to_numpy())))

        own = part.mapInArrow(alive, part.schema)
        kept = own if kept is None else kept.unionAll(own)
    return kept
