"""Dense places of rows inside their groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seamline.work import written


def numbered(table: DataFrame, group: str, order: list[str], place: str = "at", size: str = "n") -> DataFrame:
    """Adds `place` (0, 1, ... in ascending `order` inside the group) and `size`, the rows of the group.

    `group` must not be null. Rows are range-partitioned by group and order, so
    a group with most of the rows is spread over many tasks; what is added up
    per group is one row for each task that has rows of it. Rows equal in group
    and order get different places, which of them gets which is open.
    """
    by = [F.col(group), *(F.asc_nulls_first(c) for c in order)]
    # The last key splits rows that are equal in all others, however many there are.
    spread = table.withColumn("_arrival", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange(*by, F.col("_arrival")).sortWithinPartitions(*by, F.col("_arrival")).drop("_arrival")
    ranges = written(ranges.withColumn("_row", F.monotonically_increasing_id()))
    task = F.shiftright("_row", 33)
    counted = ranges.groupBy(group, task.alias("_task")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counted.select(
        group, "_task", F.sum("_n").over(whole).alias(size),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
    ))
    joined = ranges.withColumn("_task", task).join(starts, [group, "_task"])
    return joined.select(*table.columns, (F.col("_row") + F.col("_start")).alias(place), size)
