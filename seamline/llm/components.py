"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline.work import written


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that links reach) of every id in `links` (columns a, b).

    Each round points every node at the smallest of its neighbourhood, first for
    larger neighbours, then for smaller ones; rounds grow with the logarithm of
    the longest path. A round is aggregations and joins on ids and is written,
    so nothing is gathered in one task or on the driver. No links, no rows.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    while True:
        # Larger neighbours of u go to the smallest neighbour of u.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        # Smaller neighbours of u, and u, go to the smallest of them.
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(small.unionAll(smallest.select("u", F.col("m").alias("v"))).distinct())
        stars = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        rooted = small.join(small.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi")
        if stars.isEmpty() and rooted.isEmpty():
            break
        edges = small
    roots = small.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return small.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
