"""What a scan changes in the stored manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamline.fixed_values import MTIME_TOLERANCE


def compare_scan(scan: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """One row per path of either side with state new, updated, same or deleted.

    scan: path, mtime, ... ; manifest: path, mtime, ... . Columns of the
    manifest come back with the prefix `old_`. Both sides are narrow and share
    one exchange on path; a path that the scan holds twice ends the job. A null
    scan mtime (the file could not be examined) counts as same. `force` treats
    every known file as updated.
    """
    extra = [c for c in scan.columns if c not in ("path", "mtime")]
    twice = F.raise_error(F.concat(F.lit("path occurs more than once: "), F.col("path")))
    unique = scan.groupBy("path").agg(
        F.max("mtime").alias("mtime"), *[F.max(c).alias(c) for c in extra],
        F.count("*").alias("_n"),
    ).withColumn("_scanned", F.when(F.col("_n") == 1, True).otherwise(twice.cast("boolean")))
    old = manifest.select(
        "path", *[F.col(c).alias(f"old_{c}") for c in manifest.columns if c != "path"],
        F.lit(True).alias("_known"),
    )
    scanned, known = F.col("_scanned").isNotNull(), F.col("_known").isNotNull()
    close = F.abs(F.col("old_mtime") - F.col("mtime")) < MTIME_TOLERANCE
    if force:
        close = F.lit(False)
    state = (
        F.when(~scanned, "deleted")
        .when(F.col("mtime").isNull(), "same")
        .when(~known, "new")
        .when(close, "same")
        .otherwise("updated")
    )
    joined = unique.join(old, "path", "full")
    return joined.select(
        "path", "mtime", *extra, *[f"old_{c}" for c in manifest.columns if c != "path"],
        known.alias("known"), state.alias("state"),
    )


def decide(compared: DataFrame, n_chunks: Column) -> DataFrame:
    """Adds action (new, updated, skip, delete), n_chunks and drop_old.

    `n_chunks` is null or 0 where nothing was read. A new or updated file
    without chunks is skipped; a known one still loses its old chunks.
    """
    state = F.col("state")
    chunks = F.coalesce(n_chunks, F.lit(0))
    touched = state.isin("new", "updated")
    action = (
        F.when(state == "deleted", "delete").when(touched & (chunks > 0), state).otherwise("skip")
    )
    return compared.select(
        *[F.col(c) for c in compared.columns if c not in ("state", "n_chunks")],
        action.alias("action"),
        F.when(touched, chunks).otherwise(0).cast("int").alias("n_chunks"),
        (state.isin("updated", "deleted")).alias("drop_old"),
    )


def counters() -> list[Column]:
    """Aggregates over a decided plan: files by action, chunks to be written."""

    def files(action: str) -> Column:
        return F.count_if(F.col("action") == action)

    written_now = F.col("action").isin("new", "updated")
    return [
        files("new").alias("new_files"),
        files("updated").alias("updated_files"),
        files("skip").alias("skipped_files"),
        files("delete").alias("deleted_files"),
        F.coalesce(F.sum(F.when(written_now, F.col("n_chunks"))), F.lit(0)).alias("total_chunks"),
    ]


def run_counters(plan: DataFrame) -> DataFrame:
    """The counters of a run as one row."""
    return plan.agg(*counters())


def upsert(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest with `rows` inserted, or replacing the row of the same path.

    Columns that only the manifest has (a row's identity) keep their value.
    """
    new = rows.select(
        "path", *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c != "path"],
        F.lit(True).alias("_replaces"),
    )
    joined = manifest.join(new, "path", "full")
    replaced = F.col("_replaces").isNotNull()
    return joined.select(
        "path",
        *[
            (F.when(replaced, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
             if c in rows.columns else F.col(c))
            for c in manifest.columns if c != "path"
        ],
    )


def delete_missing(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """Manifest rows whose path the scan still has."""
    return manifest.join(scan.select("path"), "path", "left_semi")


def missing(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """Manifest rows whose path the scan no longer has."""
    return manifest.join(scan.select("path"), "path", "left_anti")


def live_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks written by the version of their file that is current."""
    return chunks.join(files.select("path", "file_version"), ["path", "file_version"], "left_semi")


def replaced_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of a version of their file that is no longer current."""
    return chunks.join(files.select("path", "file_version"), ["path", "file_version"], "left_anti")
