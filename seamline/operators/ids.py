"""Dense ids in path order without a single global partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seamline.functions.paths import path_key
from seamline.work import written

#: Bounds of id ranges go to the tasks as part of the plan.
_MOST_RANGES = 20_000


def assign_vector_ids(files: DataFrame, first_id: int = 0) -> DataFrame:
    """Adds `first_vector_id`: the running sum of n_chunks in path-part order.

    files: path (unique), n_chunks, ... narrow columns only; a chunk's id is
    first_vector_id + chunk_no. Range partitioning puts the files in order, the
    running sum is taken inside each range, and only the totals of the ranges
    (one row per partition) meet in one task. The ranges are written before
    they are totalled, since ranges drawn twice need not be equal.
    """
    ranges = written(
        files.withColumn("_key", path_key(F.col("path")))
        .repartitionByRange("_key", "path")
        .withColumn("_range", F.spark_partition_id())
    )
    totals = ranges.groupBy("_range").agg(F.sum("n_chunks").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_range").orderBy("_key", "path").rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = ranges.withColumn(
        "_inside", F.coalesce(F.sum("n_chunks").over(inside), F.lit(0))
    )
    placed = (F.lit(first_id) + F.col("_start") + F.col("_inside")).cast("long")
    return summed.join(starts, "_range").select(
        *files.columns, placed.alias("first_vector_id")
    )


def in_id_order(chunks: DataFrame, placed: DataFrame, first_id: int, n_chunks: int, tasks: int) -> DataFrame:
    """Adds `vector_id` to chunks (path, chunk_no, ...), which are shuffled once, into ranges of ids.

    placed: path, n_chunks, first_vector_id of all files, dense from `first_id`.
    Ids are the places of chunks in the order of path and number. So the narrow
    rows of `placed` tell where every range of `step` ids begins, each chunk
    finds its range among these at most `tasks` bounds by binary search, and
    inside a sorted range the id is the place of the row. Ranges are equal
    whatever the files are: one large file is spread over many. Nothing is
    joined to the chunks and no range is sampled.
    """
    step = max(1, -(-n_chunks // min(tasks, _MOST_RANGES)))
    ranges = max(1, -(-n_chunks // step))
    low, high = (F.expr(f"(first_vector_id - {first_id} + {more} - 1) div {step}") for more in (step, "n_chunks"))
    begins = placed.where((F.col("n_chunks") > 0) & (low <= high)).select("path", "first_vector_id", F.explode(F.sequence(low, high)).alias("range"))
    bounds = begins.where("range > 0").select(
        "range", "path", (F.col("range") * step + first_id - F.col("first_vector_id")).alias("chunk_no")
    ).orderBy("range").collect()
    range_of = _range_of([(r["path"], r["chunk_no"]) for r in bounds])
    dealt = chunks.withColumns({"_key": path_key(F.col("path")), "_range": range_of}).repartitionById(ranges, "_range")
    ordered = dealt.sortWithinPartitions("_key", "path", "chunk_no")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return ordered.select(*chunks.columns, (F.col("_range") * step + first_id + place).alias("vector_id"))


def _range_of(bounds: list[tuple[str, int]]):
    """How many of the ascending bounds are not above the row's (path, chunk_no)."""
    if not bounds:
        return F.lit(0)
    keys = F.lit([p.replace("/", "\0") for p, _ in bounds])
    paths, numbers = F.lit([p for p, _ in bounds]), F.lit([n for _, n in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    key, path, number = path_key(F.col("path")), F.col("path"), F.col("chunk_no")

    def narrow(below, more):
        at = below + more - 1
        k, p, n = F.get(keys, at), F.get(paths, at), F.get(numbers, at)
        reached = (k < key) | ((k == key) & ((p < path) | ((p == path) & (n <= number))))
        return F.when(reached, below + more).otherwise(below)

    return F.aggregate(F.lit(steps), F.lit(0), narrow)
