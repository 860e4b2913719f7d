"""A set of queries against all rows of a table, blocks of the one by chunks of the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seamline.operators.intervals import Intervals
from seamline.work import written

#: Bytes of a chunk of vectors, which meets one block of queries at a time.
CHUNK_BYTES = 16 << 20

#: A search over the rows of one block: made from the block, fed with batches of the other side, giving result batches.
Search = Callable[[pa.Table], "object"]


def _stream_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _table_of(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _packer(rows: int, size: int, gone=None):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, held_bytes, made = [], 0, 0, 0
        task = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            data = _stream_bytes(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

        for batch in batches:
            if gone is not None:
                batch = batch.filter(pa.array(~gone.value.hold(batch.column("vector_id").to_numpy())))
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                held.append(part)
                n, held_bytes, batch = n + part.num_rows, held_bytes + part.nbytes, batch.slice(part.num_rows)
                if n >= rows or held_bytes >= size:
                    yield block()
                    held, n, held_bytes, made = [], 0, 0, made + 1
        if n:
            yield block()

    return pack


def query_blocks(queries: DataFrame, n: int, rows: int) -> DataFrame:
    """The queries as blocks of at most `rows` rows, one row of bytes each, in the shared folder."""
    dealt = queries.repartition(max(1, -(-n // rows)), "query_id")
    return written(dealt.mapInArrow(_packer(rows, 1 << 62), "block bigint, data binary"))


def search_all(
    queries: DataFrame, parts: list[tuple[DataFrame, Intervals | None]], rows: int, tasks: int, search: Search, schema: str
) -> DataFrame:
    """What `search` finds for every query in all `parts` (vectors, ids to leave out), as each task has it.

    Queries of one block are sent to the tasks. More of them never meet on the
    driver: blocks lie in the shared folder, and one job deals out the grid of
    query blocks by scan tasks. A cell reads its block once and its vectors as
    chunks; rows are paired by the search inside, as whole matrices, and only
    what it keeps comes out.
    """
    spark = queries.sparkSession
    n = queries.count()
    blocks = query_blocks(queries, n, rows) if n > rows else None
    block = spark.sparkContext.broadcast(queries.toArrow()) if blocks is None else None
    found = None
    for vectors, gone in parts:
        shared = spark.sparkContext.broadcast(gone) if gone is not None else None
        vectors = vectors.coalesce(tasks)
        if blocks is None:
            hits = vectors.mapInArrow(_one_block(search, block, shared), schema)
        else:
            chunks = vectors.mapInArrow(_packer(1 << 62, CHUNK_BYTES, shared), "block bigint, data binary").toDF("chunk", "rows")
            # No shuffle and no broadcast: a task is one part of the vectors by one part of the blocks.
            cells = chunks.crossJoin(blocks.hint("shuffle_replicate_nl"))
            hits = cells.select("rows", "block", "data").mapInArrow(_many_blocks(search), schema)
        found = hits if found is None else found.unionAll(hits)
    return found


def _one_block(search: Search, block, gone):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = search(block.value)
        for batch in batches:
            if gone is not None:
                batch = batch.filter(pa.array(~gone.value.hold(batch.column("vector_id").to_numpy())))
            own.add(batch)
        yield own.batch()

    return scan


def _many_blocks(search: Search):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for rows, block, data in zip(batch.column("rows"), batch.column("block").to_pylist(), batch.column("data")):
                if block not in known:
                    # A copy: the batch it came in is not kept.
                    known[block] = search(pa.ipc.open_stream(pa.py_buffer(data.as_py())).read_all())
                for part in _table_of(rows).to_batches():
                    known[block].add(part)
        for own in known.values():
            yield own.batch()

    return scan
