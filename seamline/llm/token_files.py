"""Token ids in Arrow stream files of equal-length sequences.

Documents in ascending doc_id order are range-partitioned into shards; a task
encodes its shard and writes one Arrow stream file: record batches of `ROWS`
sequences, each a fixed-size list of `LENGTH` ids beside a fixed-size list of
mask bits (true for an id, false for the padding at the end of a shard). All
batches but the last have the same size on disk, so the place of sequence k is
known without reading what precedes it, and its ids are a view of the mapped
file. A second stream file lists the documents of the shard with their lengths.

Files get their final name by a rename after they are complete, and their
content depends only on the rows, so a task that runs again after a lost
executor writes the same file. The folder must be one that all executors share.
"""

from __future__ import annotations

import posixpath
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seamline.llm.bpe import remembered, worker_memory
from seamline.llm.library_tokens import LibraryEncoder
from seamline.llm.texts import text_slices
from seamline.work import work_folder, written

LENGTH = 2048
ROWS = 64
END_ID = 2

MANIFEST = (
    "shard int, n_docs bigint, n_tokens bigint, n_sequences bigint, tokens_file string, documents_file string, "
    "first_batch bigint, batch_bytes bigint, batch_rows int"
)
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), False), length)),
        ("mask", pa.list_(pa.field("item", pa.bool_(), False), length)),
    ])


class ShardWriter:
    """Streams ids into a sink; holds less than one record batch in memory."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int):
        self.sink, self.kind, self.length, self.rows = sink, kind, length, rows
        self.schema = sequence_schema(kind, length)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = self.n_tokens = self.n_sequences = self.first_batch = self.batch_bytes = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        full = self.length * self.rows * self.kind.itemsize
        if self.held >= full:
            data = b"".join(self.parts)
            whole = len(data) - len(data) % full
            for at in range(0, whole, full):
                self._write(np.frombuffer(data, self.kind, full // self.kind.itemsize, at), full // self.kind.itemsize)
            self.parts, self.held = [data[whole:]], len(data) - whole

    def _write(self, ids: np.ndarray, n_tokens: int) -> None:
        mask = np.arange(len(ids)) < n_tokens
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        if not self.n_sequences:
            # The stream begins with its schema; the first batch follows.
            self.first_batch = self.schema.serialize().size
            self.batch_bytes = self.sink.tell() - self.first_batch
        self.n_tokens += n_tokens
        self.n_sequences += len(ids) // self.length

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.parts), self.kind)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        self.stream.close()


def write_token_files(
    documents: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID,
    shards: int | None = None, length: int = LENGTH, rows: int = ROWS,
) -> DataFrame:
    """Write the files; returns their manifest, one row per shard (no documents: no rows).

    A null or empty text is the end id alone. Documents with one doc_id follow
    each other, ordered by a hash of their text; a null doc_id comes first.
    """
    spark = documents.sparkSession
    folder = qualified(spark, folder or work_folder(spark))
    shared = worker_memory(documents, tokenizer_path)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        encoder = remembered(shared.value, LibraryEncoder)
        end = np.array([end_id], encoder.kind).tobytes()
        context = TaskContext.get()
        shard = context.partitionId()
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        names = [posixpath.join(root, f"{kind}-{shard:06}.arrows") for kind in ("tokens", "documents")]
        drafts = [f"{name}.{context.taskAttemptId()}" for name in names]
        n_docs = 0
        with files.open_output_stream(drafts[0]) as sink, files.open_output_stream(drafts[1]) as listing:
            tokens = ShardWriter(sink, encoder.kind, length, rows)
            index = pa.ipc.new_stream(listing, INDEX)
            while first is not None:
                for part in text_slices(first):
                    packed = encoder.encode(part.column("text").to_pylist())
                    for ids in packed:
                        tokens.add(ids + end)
                    sizes = [len(ids) // encoder.kind.itemsize + 1 for ids in packed]
                    index.write_batch(pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64())], schema=INDEX))
                    n_docs += len(packed)
                first = next(batches, None)
            tokens.close()
            index.close()
        encoder.known.clear()  # the worker goes on to other tasks
        for draft, name in zip(drafts, names):
            files.move(draft, name)
        row = [shard, n_docs, tokens.n_tokens, tokens.n_sequences, *(posixpath.join(folder, posixpath.basename(n)) for n in names), tokens.first_batch, tokens.batch_bytes, rows]
        yield pa.RecordBatch.from_pylist([dict(zip(_names(MANIFEST), row))], schema=_MANIFEST_ARROW)

    ordered = (
        documents.select(F.col("doc_id").cast("bigint"), "text")
        .repartitionByRange(shards, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return written(ordered.mapInArrow(write, MANIFEST))


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


_MANIFEST_ARROW = pa.schema([
    (field.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[field.split()[1]])
    for field in MANIFEST.split(", ")
])


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI: a path without a scheme is on Spark's default file system, for tasks too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return re.sub("^file:/+", "file:///", uri)


def open_file(uri: str):
    """A memory map of a local file, else a seekable file of any file system that pyarrow knows."""
    files, path = fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)


class TokenFile:
    """Random access to the sequences of one shard, given its row of the manifest."""

    def __init__(self, tokens_file: str, first_batch: int, batch_bytes: int, rows: int = ROWS):
        self.file, self.first_batch, self.batch_bytes, self.rows = open_file(tokens_file), first_batch, batch_bytes, rows
        self.held: tuple[int, pa.RecordBatch] | None = None
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.file))

    def batch(self, number: int) -> tuple[pa.RecordBatch, int]:
        """The record batch that begins `number` places after the first, and the number of its first sequence."""
        if self.held is None or self.held[0] != number:
            self.file.seek(self.first_batch + number * self.batch_bytes)
            self.held = (number, pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema))
        return self.held[1], number * self.rows

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view of the mapped file) and the mask of sequence k."""
        batch, first = self.batch(k // self.rows)
        ids, mask = (batch.column(c)[k - first].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from place `start` of the shard on, as views, one for each record batch that holds some.

        A place is sequence times length: only the end of a shard is padded.
        """
        length = self.schema.field(0).type.list_size
        full = self.rows * length
        while n:
            batch, first = self.batch(start // full)
            at = start - first * length
            ids, mask = (batch.column(c).flatten().slice(at, n) for c in (0, 1))
            if not len(ids) or not (mask.true_count == len(ids)):
                raise ValueError(f"the file ends {n} ids early, at {start}")
            yield ids.to_numpy()
            start += len(ids)
            n -= len(ids)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.file.seek(0)
        yield from pa.ipc.open_stream(self.file)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    `start` counts the ids of all documents before it. The running sum over
    shards sees one row per file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield from shard_documents(shard)

    files = placed.select("shard", "start", "tokens_file", "documents_file", "first_batch", "batch_bytes", "batch_rows").repartition(int(n), "shard")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def shard_documents(shard: dict) -> Iterator[pa.RecordBatch]:
    """One batch of documents after the other; the ids of each are read by its place in the file of tokens."""
    file = TokenFile(shard["tokens_file"], shard["first_batch"], shard["batch_bytes"], shard["batch_rows"])
    place = 0
    for listed in pa.ipc.open_stream(open_file(shard["documents_file"])):
        starts, sums = [], []
        for n in listed.column("n_tokens").to_pylist():
            starts.append(shard["start"] + place)
            crc = 0
            for ids in file.span(place, n):
                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
            place += n
            sums.append(crc)
        yield pa.RecordBatch.from_arrays(
            [listed.column("doc_id"), pa.array(starts, pa.int64()), listed.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )
