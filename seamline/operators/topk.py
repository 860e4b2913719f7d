"""Exact top-k by inner product, for one query or many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seamline.functions.vectors import inner_product
from seamline.operators.grid import search_all
from seamline.operators.intervals import INTERVALS_AT_ONCE, Dead, Intervals
from seamline.work import literal_rows

BLOCK_ROWS = 8192
BLOCK_BYTES = 64 << 20
GRID = 1e6
_TILE = 4 << 20
_MANY = 1 << 14
_MERGE_AT_ONCE = 10_000
_TASKS_PER_CORE = 4
_TASK_BYTES = 4 << 30
_MOST_TASKS = 100_000
_UNKNOWN_BYTES = 1 << 58
_MERGE_GROUPS = 64


def grid_score(score):
    """Ranking key: scores equal to six places tie and are ordered by id.

    Float sums differ in their last digits with the order of addition, so raw
    scores would order true ties by noise.
    """
    return F.rint(score * F.lit(GRID))


def top_k_single(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k best rows of (vector_id, embedding) for one unit query vector.

    The product is a JVM expression and the plan ends in a top-k operator: each
    task keeps k rows and only those are merged.
    """
    check_k(k)
    if not np.isfinite(query).all():
        raise ValueError("the query vector must be finite")
    product = inner_product(F.col("embedding"), F.lit([float(x) for x in query]))
    strange = F.raise_error(F.lit("vector components must be finite")).cast("double")
    scored = vectors.select("vector_id", product.alias("score")).select(
        "vector_id", F.when(F.abs("score") < float("inf"), F.col("score")).otherwise(strange).alias("score")
    )
    order = [grid_score(F.col("score")).desc(), F.col("vector_id")]
    best = scored.orderBy(*order).limit(k)
    return best.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"), "vector_id", "score"
    )


def check_k(k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    dim: int,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
    dead: Dead | None = None,
) -> DataFrame:
    """For each query the k best vectors: query_id, rank, vector_id, score.

    queries: query_id, embedding; vectors: vector_id, embedding; vectors have
    unit length and `dim` finite components. A query id that occurs twice or is
    null ends the job: results are told apart by it. Every pair is scored,
    nothing is sampled. Vectors whose id is in `dead` are left out as they are
    read, so that one scan does, however many they are.

    - Queries of one block (checked rows and bytes) go to the tasks, vectors
      stream past them as matrix products, each task keeps k rows per query, and
      only those are shuffled to be merged;
    - else, vectors of one block go to the tasks, queries stream, and each row is
      final;
    - else one job deals out the grid of query blocks by parts of the vectors.

    Where copies of a vector crowd the candidates, a task reduces them to their k
    lowest ids, the most that can be ranked, so a hot group of copies costs no
    more than others.
    """
    check_k(k)
    queries = queries.select("query_id", "embedding")
    vectors = vectors.select("vector_id", "embedding")
    hits_type = hits_schema(queries)
    if k == 0:
        return literal_rows(queries.sparkSession, hits_type)
    check_query_ids(queries)
    rows = rows_per_block(dim, block_rows, block_bytes, k)
    parts = dead.parts_alive(vectors) if dead else [(vectors, None)]
    if len(parts) == 1 and queries.count() > rows and vectors.count() <= rows:
        return _stream_queries(queries, parts[0][0].toArrow(), parts[0][1], k, dim, hits_type)
    tasks = scan_tasks(vectors)
    return merge_top_k(search_all(queries, parts, rows, tasks, lambda block: Scan(block, k, dim), hits_type), k, tasks * len(parts))


def top_k_without(
    queries: DataFrame, vectors: DataFrame, dead: DataFrame, k: int, dim: int, at_once: int = INTERVALS_AT_ONCE
) -> DataFrame:
    """`top_k` over the vectors whose id is in none of the intervals `dead` (first_id, last_id).

    Tasks get up to `at_once` intervals; of more, those for the range of ids that
    the task reads; very many meet the vectors in a shuffle.
    """
    return top_k(queries, vectors, k, dim, dead=Dead(dead, at_once))


def check_query_ids(queries: DataFrame) -> None:
    twice = queries.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1 or query_id is null")
    for row in twice.take(1):
        raise ValueError(f"query_id {row['query_id']!r} occurs {row['n']} times; ids must be unique and not null")


def hits_schema(queries: DataFrame) -> str:
    id_type = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {id_type}, rank int, vector_id bigint, score double"


def rows_per_block(
    dim: int, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, k: int = 0
) -> int:
    """How many queries a task holds at once, each with its vector and its k best so far."""
    return max(1, min(block_rows, block_bytes // (4 * dim + 24 * k)))


def merge_top_k(hits: DataFrame, k: int, tasks: int) -> DataFrame:
    """The k best of each query; the window limit also cuts before the shuffle.

    A query has up to k rows from each of `tasks` tasks. Where that is much they
    are first merged in groups of tasks, so that no single task receives all.
    """
    if k * tasks > _MERGE_AT_ONCE:
        group = F.pmod(F.spark_partition_id(), F.lit(_MERGE_GROUPS))
        hits = _best_rows(hits.withColumn("_group", group), k, "query_id", "_group")
    best = _best_rows(hits, k, "query_id")
    return best.select("query_id", "rank", "vector_id", "score")


def scan_tasks(vectors: DataFrame) -> int:
    """A scan for top-k has at most so many tasks, whatever the number of splits.

    Each task hands on k rows per query, so more tasks than bytes ask for only
    add to the shuffle, and a task that streams many splits prunes better. Bytes
    set the number, so that a lost task costs little and a cluster that has only
    begun to grow is not taken for a small one; the cores are the lower bound.
    """
    spark = vectors.sparkSession
    size = int(str(vectors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = _TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    # Spark takes a table whose size it cannot know for larger than any.
    return max(cores, min(_MOST_TASKS, size // _TASK_BYTES)) if size < _UNKNOWN_BYTES else cores


def _best_rows(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    order = [grid_score(F.col("score")).desc(), F.col("vector_id")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Arrow list column to a float32 matrix; another length ends the job."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if vectors.null_count or np.any(np.diff(vectors.offsets.to_numpy()) != dim):
        raise ValueError(f"every vector must have {dim} components")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(flat).all():
        raise ValueError("vector components must be finite")
    return flat.reshape(len(vectors), dim).astype(np.float32, copy=False)


def lowest_copies(ids: np.ndarray, rows: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Marks, among the rows at `at`, the k lowest ids of each group of equal rows.

    No more of them can be ranked: copies score the same and go by id.
    """
    whole_row = np.dtype((np.void, rows.shape[1] * rows.itemsize))
    keys = np.ascontiguousarray(rows[at]).view(whole_row).ravel()
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids[at], group))
    kept = np.zeros(len(rows), bool)
    kept[at[order[_place_in_group(group[order]) < k]]] = True
    return kept


def _place_in_group(sorted_groups: np.ndarray) -> np.ndarray:
    place = np.arange(len(sorted_groups))
    first = np.ones(len(sorted_groups), bool)
    first[1:] = sorted_groups[1:] != sorted_groups[:-1]
    return place - np.maximum.accumulate(np.where(first, place, 0))


class Best:
    """The k best (score, id) of each of n queries seen so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.floor = np.full(n, -np.inf)

    def add(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, which=None) -> None:
        """Score all of `rows` against all of `queries`, or those at `which`.

        Single precision finds candidates with a margin above its rounding
        error, double precision scores and ranks those.
        """
        which = np.arange(len(queries)) if which is None else which
        asked = queries[which]
        step = max(1, _TILE // max(1, len(which)))
        pairs = max(1, _TILE // max(1, queries.shape[1]))
        margin = 2 * (queries.shape[1] + 2) * 2.0**-23 + 2 / GRID
        for start in range(0, len(rows), step):
            part, part_ids = rows[start : start + step], ids[start : start + step]
            rough = asked @ part.T
            floor = self.floor[which]
            if len(part) > self.k and np.isinf(floor).any():
                kth = np.partition(rough, -self.k, axis=1)[:, -self.k]
                floor = np.maximum(floor, kth)
            q, r = np.nonzero(rough >= (floor - margin)[:, None])
            if len(r) > _MANY:
                kept = lowest_copies(part_ids, part, np.unique(r), self.k)[r]
                q, r = q[kept], r[kept]
            for at in range(0, len(q), pairs):
                qs, rs = q[at : at + pairs], r[at : at + pairs]
                exact = np.einsum(
                    "ij,ij->i", asked[qs].astype(np.float64), part[rs].astype(np.float64)
                )
                self._merge(which[qs], part_ids[rs], exact)

    def _merge(self, query: np.ndarray, vector_id: np.ndarray, score: np.ndarray) -> None:
        touched = np.zeros(len(self.floor), bool)
        touched[query] = True
        old = touched[self.query]
        query = np.concatenate([self.query[old], query])
        vector_id = np.concatenate([self.id[old], vector_id])
        score = np.concatenate([self.score[old], score])
        order = np.lexsort((vector_id, -np.rint(score * GRID), query))
        place = _place_in_group(query[order])
        last = order[place == self.k - 1]
        self.floor[query[last]] = score[last]
        keep = order[place < self.k]
        self.query = np.concatenate([self.query[~old], query[keep]])
        self.id = np.concatenate([self.id[~old], vector_id[keep]])
        self.score = np.concatenate([self.score[~old], score[keep]])

    def batch(self, query_ids: pa.Array) -> pa.RecordBatch:
        order = np.lexsort((self.id, -np.rint(self.score * GRID), self.query))
        query = self.query[order]
        rank = (_place_in_group(query) + 1).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(query)), pa.array(rank), pa.array(self.id[order]),
             pa.array(self.score[order])],
            names=["query_id", "rank", "vector_id", "score"],
        )


def column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


class Scan:
    """The best vectors for one block of queries."""

    def __init__(self, block: pa.Table, k: int, dim: int):
        self.query_ids, self.dim = column(block, "query_id"), dim
        self.queries = matrix(block.column("embedding"), dim)
        self.best = Best(len(self.queries), k)

    def add(self, batch: pa.RecordBatch) -> None:
        self.best.add(self.queries, matrix(batch.column("embedding"), self.dim), batch.column("vector_id").to_numpy())

    def batch(self) -> pa.RecordBatch:
        return self.best.batch(self.query_ids)


def _stream_queries(queries: DataFrame, block: pa.Table, gone: Intervals | None, k: int, dim: int, schema: str) -> DataFrame:
    if gone is not None:
        block = block.filter(pa.array(~gone.hold(column(block, "vector_id").to_numpy())))
    shared = queries.sparkSession.sparkContext.broadcast(
        (column(block, "vector_id").to_numpy(), matrix(block.column("embedding"), dim))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value
        for batch in batches:
            queries = matrix(batch.column("embedding"), dim)
            best = Best(len(queries), k)
            best.add(queries, rows, ids)
            yield best.batch(batch.column("query_id"))

    return queries.mapInArrow(scan, schema)
