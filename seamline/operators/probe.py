"""Top-k over the lists nearest to each query: fewer products, approximate result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from seamline.functions.vectors import l2_normalise
from seamline.operators.grid import search_all
from seamline.operators.intervals import Dead
from seamline.operators.topk import (
    BLOCK_BYTES, BLOCK_ROWS, GRID, Best, check_k, column, hits_schema, matrix, merge_top_k, rows_per_block, scan_tasks, top_k,
)
from seamline.work import literal_rows, written

_NAMED_LISTS = 1000
_PARTS_OF_A_LIST = 8


def train_centroids(vectors: DataFrame, n_lists: int, seed: int = 0) -> DataFrame:
    """Unit centroids (list_id, embedding) of a distributed k-means."""
    features = vectors.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=n_lists, seed=seed, distanceMeasure="cosine").fit(features)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centers = vectors.sparkSession.createDataFrame(rows, "list_id long, embedding array<float>")
    return centers.select("list_id", l2_normalise(F.col("embedding")).alias("embedding"))


def assign_lists(vectors: DataFrame, centroids: DataFrame, dim: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds `list_id`, the centroid of highest inner product, ties to the lowest id; no shuffle.

    Centroids go to the tasks in blocks of checked size, one step of the same
    scan each, so their number has no limit. Write the result with
    partitionBy("list_id") and a probe reads only the lists it needs.
    """
    blocks = centroid_blocks(centroids, dim, block_bytes)
    if not blocks:
        raise ValueError("there are no centroids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    listed = vectors
    for at, block in enumerate(blocks):
        more = ", list_id bigint, _score double" if at + 1 < len(blocks) else ", list_id bigint"
        listed = listed.mapInArrow(_nearest(vectors.sparkSession.sparkContext.broadcast(block), at == 0, at + 1 < len(blocks), dim), fields + more)
    return listed


def by_list(listed: DataFrame) -> DataFrame:
    """Vectors dealt out by list for writing; a large list goes to several tasks, a task has few lists."""
    part = F.pmod(F.xxhash64("vector_id"), F.lit(_PARTS_OF_A_LIST))
    return listed.repartition("list_id", part)


def centroid_blocks(centroids: DataFrame, dim: int, block_bytes: int = BLOCK_BYTES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centroids (ids, matrix) by ascending id, in blocks of at most `block_bytes`."""
    rows, n = max(1, block_bytes // (4 * dim)), centroids.count()
    if n <= rows:
        tables = [centroids.select("list_id", "embedding").toArrow()] if n else []
    else:
        dealt = -(-n * 5 // (4 * rows))
        table = written(centroids.select("list_id", "embedding").withColumn("_block", F.pmod(F.xxhash64("list_id"), F.lit(dealt))))
        tables = [table.where(F.col("_block") == b).drop("_block").toArrow() for b in range(dealt)]
    tables = [t.sort_by("list_id") for t in tables if t.num_rows]
    return [(column(t, "list_id").to_numpy(), matrix(t.column("embedding"), dim)) for t in tables]


def _nearest(shared, first: bool, more: bool, dim: int):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value
        for batch in batches:
            points = matrix(batch.column("embedding"), dim)
            best = Best(len(points), 1)
            best.add(points, rows, ids)
            lists, scores = np.empty(len(points), np.int64), np.empty(len(points))
            lists[best.query], scores[best.query] = best.id, np.rint(best.score * GRID)
            if not first:
                old, was = (batch.column(c).to_numpy() for c in ("list_id", "_score"))
                keep = (was > scores) | ((was == scores) & (old < lists))
                lists, scores = np.where(keep, old, lists), np.where(keep, was, scores)
                batch = batch.select([c for c in batch.schema.names if c not in ("list_id", "_score")])
            batch = batch.append_column("list_id", pa.array(lists))
            yield batch.append_column("_score", pa.array(scores)) if more else batch

    return nearest


class Probe:
    """The best vectors for one block of queries, each in the lists that it probes."""

    def __init__(self, block: pa.Table, k: int, dim: int):
        lists = column(block, "lists")
        query_of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        list_of = lists.flatten().to_numpy()
        order = np.argsort(list_of, kind="stable")
        names, starts = np.unique(list_of[order], return_index=True)
        self.probed_by = dict(zip(names.tolist(), np.split(query_of[order], starts[1:])))
        self.query_ids, self.dim = column(block, "query_id"), dim
        self.points = matrix(block.column("embedding"), dim)
        self.best = Best(len(self.points), k)

    def add(self, batch: pa.RecordBatch) -> None:
        ids, rows = batch.column("vector_id").to_numpy(), matrix(batch.column("embedding"), self.dim)
        of_list = batch.column("list_id").to_numpy()
        for name in np.unique(of_list).tolist():
            if name in self.probed_by:
                here = of_list == name
                self.best.add(self.points, rows[here], ids[here], self.probed_by[name])

    def batch(self) -> pa.RecordBatch:
        return self.best.batch(self.query_ids)


def top_k_probe(
    queries: DataFrame, listed: DataFrame, centroids: DataFrame, k: int, n_probe: int, dim: int,
    block_rows: int = BLOCK_ROWS, dead: Dead | None = None,
) -> DataFrame:
    """For each query the k best vectors among its n_probe nearest lists.

    listed: vector_id, embedding, list_id. Vectors stay where they are, also
    when one list holds most of them: each task multiplies the rows of a list
    only with the queries that probe it. The lists that any query probes are a
    small table; joined to stored vectors that are partitioned by list it
    prunes the folders of all others, however many there are. Vectors in `dead`
    are left out as they are read.
    """
    check_k(k)
    hits_type = hits_schema(queries)
    if k == 0 or n_probe < 1:
        return literal_rows(queries.sparkSession, hits_type)
    as_vectors = centroids.select(F.col("list_id").alias("vector_id"), "embedding")
    probes = top_k(queries, as_vectors, n_probe, dim).groupBy("query_id").agg(
        F.sort_array(F.collect_list("vector_id")).alias("lists")
    )
    probing = written(queries.select("query_id", "embedding").join(probes, "query_id"))
    probed = written(probing.select(F.explode("lists").alias("list_id")).distinct())
    read = probed_lists(listed.select("vector_id", "embedding", "list_id"), probed)
    parts = dead.parts_alive(read) if dead else [(read, None)]
    tasks = scan_tasks(listed)
    rows = rows_per_block(dim, block_rows, k=k)
    return merge_top_k(search_all(probing, parts, rows, tasks, lambda block: Probe(block, k, dim), hits_type), k, tasks * len(parts))


def probed_lists(listed: DataFrame, probed: DataFrame) -> DataFrame:
    """Vectors of the lists in `probed`, a written table of one row (8 bytes) for each centroid at most.

    Up to _NAMED_LISTS become a filter on the partitions; more are joined, with
    the partitions pruned while the query runs. Both read the same rows.
    """
    names = [r.list_id for r in probed.limit(_NAMED_LISTS + 1).collect()]
    if len(names) <= _NAMED_LISTS:
        return listed.where(F.col("list_id").isin(names))
    # Spark prunes by a joined table when that is filtered: the bound lets all rows through.
    least = probed.agg(F.min("list_id")).first()[0]
    return listed.join(F.broadcast(probed.where(F.col("list_id") >= least)), "list_id", "left_semi")
