"""Bounded samples of labelled documents, and counts that every task adds up for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seamline.work import written


def fold(doc_id: Column, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo `parts`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


#: The range of hashes a label's rows are drawn from is cut into so many parts; a sample ends with a whole part.
PARTS = 256


def sampled_ids(labelled: DataFrame, per_label: int, most_rows: int) -> DataFrame:
    """At most `per_label` rows of each label (doc_id, label), chosen by a hash of the id.

    With more labels than `most_rows` / `per_label` each gets fewer rows, one at
    least; with more than `most_rows` labels the most frequent ones count. One
    scan meets the thresholds of all labels, at most `most_rows` of them. Rows
    below a label's threshold are counted by parts of the hash range, and whole
    parts are taken while they fit (the first in any case), so nothing orders
    the rows of a label. The result is written and may be broadcast.
    """
    counts = written(labelled.where("label is not null").groupBy("label").agg(F.count("*").alias("n")))
    n_labels = counts.count()
    per = max(1, min(per_label, most_rows // max(n_labels, 1)))
    if n_labels > most_rows:
        counts = counts.orderBy(F.desc("n"), "label").limit(most_rows)
    whole = 1 << 40
    below = (F.least(F.lit(1.0), F.lit(1.2 * per + 50) / F.col("n")) * whole).cast("bigint").alias("below")
    rows = labelled.select("doc_id", "label", F.xxhash64("doc_id").bitwiseAND(whole - 1).alias("place"))
    rows = rows.join(F.broadcast(counts.select("label", below)), "label").where("place < below")
    near = written(rows.select("doc_id", "label", F.expr(f"place * {PARTS} div below").alias("part")).distinct())
    up_to = F.sum("n").over(Window.partitionBy("label").orderBy("part"))
    parts = near.groupBy("label", "part").agg(F.count("*").alias("n")).withColumn("up_to", up_to)
    last = parts.where((F.col("up_to") <= per) | (F.col("up_to") == F.col("n"))).groupBy("label").agg(F.max("part").alias("last"))
    return written(near.join(F.broadcast(last), "label").where("part <= last").select("doc_id", "label"))


def binary_labels(labels: DataFrame, column: str, held_out: int) -> DataFrame:
    """doc_id and label 0 or 1 of the rows one may learn from (fold of three other than `held_out`).

    Null and other values are no labels; of several for one document the largest holds.
    """
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != held_out))
    return usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def sampled_texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, label, text of sampled documents; the ids are bounded, so they are broadcast."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")


def summed(counts: DataFrame, size: int) -> list[float]:
    """Adds up rows of (term int, n double), as each task has counted its own rows; `size` terms."""
    total = [0.0] * size
    for row in counts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[row["term"]] = row["n"]
    return total
