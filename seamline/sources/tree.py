"""Files of a folder tree that every executor can reach under the same path.

Spark's own file sources skip names that begin with `_` or `.` and drop empty
files in part; the index needs all of them, so folders are listed by tasks.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.fixed_values import EXCLUDED_FOLDERS, INCLUDE_EXTENSIONS
from seamline.operators.files import keep_files
from seamline.work import literal_rows, work_folder, written

_ENTRY = "path string, is_folder boolean, mtime double, size bigint"
_ENTRY_ARROW = pa.schema(
    [("path", pa.string()), ("is_folder", pa.bool_()), ("mtime", pa.float64()), ("size", pa.int64())]
)
_ENTRIES_PER_BATCH = 10_000
_TEXT_PER_BATCH = 32 << 20
_BYTES_PER_TASK = 64 << 20
_TRIES = 3
_GONE = (FileNotFoundError, NotADirectoryError)


class TreeSource:
    """All files below `root` but for those in excluded folders."""

    def __init__(
        self, spark: SparkSession, root: str, excluded: Iterable[str] = EXCLUDED_FOLDERS
    ):
        self.spark = spark
        self.root = os.path.abspath(root)
        self.excluded = tuple(excluded)

    def listing(self, extensions: Iterable[str] = INCLUDE_EXTENSIONS) -> DataFrame:
        """path (relative), mtime (null if it cannot be examined), size.

        One job per depth of the tree: the folders of a level are spread over
        the tasks, whatever branch they belong to, so a branch that holds most
        of the files does not end in one task. Excluded folders are not entered.
        """
        folder = work_folder(self.spark)
        listing = _folder_lister(self.root, self.excluded)
        spread = self.spark.sparkContext.defaultParallelism * 4
        level, n_folders = 0, 1
        folders = literal_rows(self.spark, "path string", {"path": ""})
        while n_folders:
            tasks = min(n_folders, max(spread, n_folders // 1000))
            entries = written(
                folders.repartition(tasks, "path").mapInArrow(listing, _ENTRY),
                f"{folder}/level={level}",
            )
            folders = entries.where("is_folder").select("path")
            n_folders = folders.count()
            level += 1
        entries = self.spark.read.schema(_ENTRY).parquet(folder)
        files = entries.where("not is_folder").select("path", "mtime", "size")
        return keep_files(files, extensions, self.excluded)

    def read(self, files: DataFrame) -> DataFrame:
        """`files` (with a `path`) plus `text`, null where a file is not there.

        Each task reads the files of its rows; no text is shuffled.
        """
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
        return files.mapInArrow(_text_reader(self.root), f"{fields}, text string")

    def read_all(self, files: DataFrame) -> DataFrame:
        """`read` after spreading the files (with a `size`) by their bytes."""
        total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        tasks = max(self.spark.sparkContext.defaultParallelism, total // _BYTES_PER_TASK)
        return self.read(files.repartition(int(tasks), "path"))

    def read_touched(self, touched: DataFrame, extensions: Iterable[str], all_of_them: bool) -> DataFrame:
        """path, text of the touched files (with a `size`), read one by one, spread by their bytes."""
        return self.read_all(touched).select("path", "text")


def _tried(action):
    """The result of `action`, None if the file or folder is not there (any more).

    Any other error is tried again and then ends the job: a folder that cannot
    be read for a moment must not look like one whose files were deleted.
    """
    for left in reversed(range(_TRIES)):
        try:
            return action()
        except _GONE:
            return None
        except OSError:
            if not left:
                raise
            time.sleep(0.5)


def _folder_lister(root: str, excluded: tuple[str, ...]):
    def entries(folder: str) -> Iterator[tuple]:
        scan = _tried(lambda: os.scandir(os.path.join(root, folder)))
        if scan is None:
            if not folder:
                raise FileNotFoundError(root)
            return
        with scan:
            for entry in scan:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if _tried(entry.is_dir):
                    if not entry.is_symlink() and entry.name not in excluded:
                        yield path, True, None, None
                    continue
                found = _tried(entry.stat)
                yield (path, False, found.st_mtime, found.st_size) if found else (path, False, None, None)

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for row in entries(folder):
                    rows.append(row)
                    if len(rows) >= _ENTRIES_PER_BATCH:
                        yield _entry_batch(rows)
                        rows = []
        if rows:
            yield _entry_batch(rows)

    return list_folders


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), _ENTRY_ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_ENTRY_ARROW)


def _text_reader(root: str):
    def content_of(path: str) -> bytes:
        with open(os.path.join(root, path), "rb") as file:
            return file.read()

    def text_of(path: str) -> str | None:
        content = _tried(lambda: content_of(path))
        if content is None:
            return None
        text = content.decode("utf-8", "ignore")
        return text.replace("\r\n", "\n").replace("\r", "\n")

    def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, texts = 0, 0, []
            for at, path in enumerate(batch.column("path").to_pylist()):
                texts.append(text_of(path))
                held += len(texts[-1] or "")
                if held >= _TEXT_PER_BATCH or at + 1 == batch.num_rows:
                    rows = batch.slice(start, len(texts))
                    yield rows.append_column("text", pa.array(texts, pa.string()))
                    start, held, texts = at + 1, 0, []

    return read_texts
