"""The stored index: parquet tables of files, chunks and vectors, one part per run.

    params/                      one JSON row
    log/, claims/                states and run numbers, see `log`
    files/snapshot=N/            the manifest as run N left it
    chunks/file_version=N/id_block=B/
    vectors/file_version=N/list_id=L/    L is -1 while there are no lists
    dead/file_version=N/         intervals of ids that run N took out of use
    centroids/lists=N/           the centroids of the lists that run N made

A run only adds folders. Its last act is one entry in the log; until that is
there readers see the state before, and a run that failed, or that another
writer was ahead of, leaves folders that nobody reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seamline.operators.intervals import Dead, without
from seamline.params import IndexParams, load_params, save_params
from seamline.sources.log import Conflict, Log, State
from seamline.work import literal_rows

FILES = (
    "path string, mtime double, language string, file_version bigint, "
    "first_vector_id bigint, n_chunks int"
)
CHUNKS = (
    "path string, chunk_no int, start_line int, end_line int, text string, vector_id bigint, "
    "file_version bigint, id_block bigint"
)
VECTORS = "vector_id bigint, embedding array<float>, file_version bigint, list_id bigint"
DEAD = "first_id bigint, last_id bigint, file_version bigint"
CENTROIDS = "list_id bigint, embedding array<float>"
COUNTERS = ("new_files", "updated_files", "skipped_files", "deleted_files", "total_chunks")
NO_LIST = -1
ID_BLOCK = 1 << 22
#: Each range is a condition of the plan, whose cost of planning grows faster than their number.
_MOST_RANGES = 128
_LEAST_RANGE = 4096


def _few_ranges(ids: DataFrame) -> list[tuple[int, int]] | None:
    """Some `_MOST_RANGES` ranges of ids, each inside one block, that hold all of `ids`; None if more blocks are hit.

    Ids that agree when divided by a width share a range. The width is the least
    power of two that gives few ranges, as estimated in one pass without a shuffle
    of ids; each range is then as tight as the ids in it.
    """
    widths = [ID_BLOCK]
    while widths[-1] % 2 == 0 and widths[-1] // 2 >= _LEAST_RANGE:
        widths.append(widths[-1] // 2)
    counted = ids.agg(*[F.approx_count_distinct(F.expr(f"vector_id div {w}")) for w in widths]).first()
    width = next((w for w, n in zip(reversed(widths), reversed(counted)) if n <= _MOST_RANGES), None)
    if width is None:
        return None
    ranges = ids.groupBy(F.expr(f"vector_id div {width}")).agg(F.min("vector_id").alias("low"), F.max("vector_id").alias("high"))
    return sorted((r.low, r.high) for r in ranges.collect())


def _in_ranges(ranges: list[tuple[int, int]]) -> Column:
    """A condition on id_block and vector_id that holds inside these ranges.

    Written as SQL, whose parser balances the tree of conditions: as a chain, the
    conditions of some hundred ranges overflow the stack of Spark's planner.
    """
    blocks: dict[int, list[str]] = {}
    for low, high in ranges:
        blocks.setdefault(low // ID_BLOCK, []).append(f"vector_id between {low} and {high}")
    inside = [f"(id_block = {block} and ({' or '.join(own)}))" for block, own in blocks.items()]
    return F.expr(" or ".join(inside)) if inside else F.lit(False)


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = Log(spark, self.path)
        self._seen: State | None = None

    def at(self, run_id: int | None = None) -> "IndexStore":
        """The index as it is now, or as run `run_id` left it, for several reads that must agree."""
        view = IndexStore(self.spark, self.path)
        view._seen = self.state() if run_id is None else self._found(self.log.of_run(run_id))
        return view

    # -- set-up --------------------------------------------------------------

    def create(self, params: IndexParams) -> "IndexStore":
        """Save parameters; make empty tables unless there is an index, whose tables are kept.

        Of two that create one index the first makes the tables.
        """
        params.check()
        if self.log.newest() is None:
            for table, schema in (("chunks", CHUNKS), ("vectors", VECTORS), ("dead", DEAD)):
                empty = literal_rows(self.spark, schema).drop("file_version", "id_block", "list_id")
                inner = {"chunks": "/id_block=0", "vectors": f"/list_id={NO_LIST}"}.get(table, "")
                empty.write.mode("overwrite").parquet(f"{self.path}/{table}/file_version=0{inner}")
            self.write_files(literal_rows(self.spark, FILES), 0)
            try:
                self.log.start(State())
            except Conflict:
                pass
        save_params(self.spark, params, f"{self.path}/params")
        return self

    def params(self) -> IndexParams:
        return load_params(self.spark, f"{self.path}/params")

    # -- states --------------------------------------------------------------

    def _found(self, state: State | None) -> State:
        if state is None:
            raise FileNotFoundError(f"no index at {self.path}; create it first")
        return state

    def state(self) -> State:
        return self._seen or self._found(self.log.newest())

    def check_model(self, dim: int, name: str) -> None:
        """Vectors of two models, or of two lengths, must not meet."""
        state = self.state()
        if state.embedding_dim not in (None, dim):
            raise ValueError(f"stored vectors have {state.embedding_dim} components, not {dim}")
        if state.embedder not in (None, name):
            raise ValueError(f"stored vectors come from the model {state.embedder!r}, not {name!r}")

    # -- tables --------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        table = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return table.where(F.col("file_version").isin(list(self.state().runs)))

    def files(self) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.path}/files/snapshot={self.state().snapshot}")

    def chunks(self) -> DataFrame:
        """All chunks of committed runs, replaced ones included."""
        return self._table("chunks", CHUNKS)

    def chunks_of(self, ids: DataFrame) -> DataFrame:
        """At least the chunks of `ids` (a written table of hits), however many there are.

        Blocks without an id are not read. Inside a block ids become ranges that
        parquet skips row groups by, as chunks lie in id order: narrow ranges for
        few ids, wider ones for more. Ids in very many blocks name the blocks in a
        join that prunes folders while it runs; its small side has one number for
        each block of the index at most.
        """
        ranges = _few_ranges(ids)
        if ranges is not None:
            return self.chunks().where(_in_ranges(ranges))
        blocks = ids.select(F.expr(f"vector_id div {ID_BLOCK}").alias("id_block")).distinct()
        chunks = self.chunks()
        # Spark prunes by a joined table when that is filtered: the bound lets all rows through.
        return chunks.join(F.broadcast(blocks.where("id_block >= 0")), "id_block", "left_semi").select(*chunks.columns)

    def vectors(self) -> DataFrame:
        """All vectors of committed runs, orphans included."""
        return self._table("vectors", VECTORS).drop("list_id")

    def listed_vectors(self) -> DataFrame:
        """The same with their list; a filter on it leaves folders out."""
        return self._table("vectors", VECTORS)

    def centroids(self) -> DataFrame | None:
        """list_id, embedding of the lists, None without lists."""
        made = self.state().lists
        return None if made is None else self.spark.read.schema(CENTROIDS).parquet(f"{self.path}/centroids/lists={made}")

    def dead(self) -> DataFrame:
        """Intervals (first_id, last_id) of ids out of use."""
        return self._table("dead", DEAD)

    def n_dead(self) -> int:
        return self.state().dead_ids

    def dead_intervals(self) -> Dead | None:
        """What scans leave out, None where that is nothing."""
        return Dead(self.dead()) if self.n_dead() else None

    def live_vectors(self) -> DataFrame:
        """Vectors whose chunk is in use."""
        dead = self.dead_intervals()
        return without(self.vectors(), dead) if dead else self.vectors()

    def write_files(self, files: DataFrame, run_id: int) -> None:
        columns = [c.split()[0] for c in FILES.split(", ")]
        files.select(*columns).write.mode("overwrite").parquet(f"{self.path}/files/snapshot={run_id}")

    def write_chunks(self, chunks: DataFrame, run_id: int) -> None:
        """Rows that come ordered by id inside their partitions stay so in each file; leading
        with the folder column, that is also the order the write asks for: rows are sorted once."""
        blocked = chunks.withColumn("id_block", F.expr(f"vector_id div {ID_BLOCK}"))
        ordered = blocked.sortWithinPartitions("id_block", "vector_id")
        ordered.write.mode("overwrite").partitionBy("id_block").parquet(
            f"{self.path}/chunks/file_version={run_id}"
        )

    def run_chunks(self, run_id: int) -> DataFrame:
        """Chunks that a run has written, before it commits."""
        return self.spark.read.schema(CHUNKS).option("basePath", f"{self.path}/chunks").parquet(
            f"{self.path}/chunks/file_version={run_id}"
        )

    def write_vectors(self, vectors: DataFrame, run_id: int) -> None:
        """vector_id, embedding and, with lists, list_id."""
        columns = ["vector_id", "embedding"]
        target = f"{self.path}/vectors/file_version={run_id}"
        if "list_id" in vectors.columns:
            vectors.select(*columns, "list_id").write.mode("overwrite").partitionBy("list_id").parquet(target)
        else:
            vectors.select(*columns).write.mode("overwrite").parquet(f"{target}/list_id={NO_LIST}")

    def write_centroids(self, centroids: DataFrame, run_id: int) -> None:
        centroids.select("list_id", "embedding").write.mode("overwrite").parquet(f"{self.path}/centroids/lists={run_id}")

    def write_dead(self, intervals: DataFrame, run_id: int) -> None:
        intervals.select("first_id", "last_id").write.mode("overwrite").parquet(f"{self.path}/dead/file_version={run_id}")
