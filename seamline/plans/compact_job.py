"""Compaction: rewrite what is in use as one part, then let older parts go."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators.intervals import without
from seamline.operators.probe import assign_lists, by_list, train_centroids
from seamline.sources.store import COUNTERS, DEAD, IndexStore
from seamline.work import literal_rows, written

TABLES = (
    ("chunks", "file_version"), ("vectors", "file_version"), ("dead", "file_version"), ("files", "snapshot"), ("centroids", "lists"),
)


def compact_index(store: IndexStore, tasks: int | None = None, n_lists: int | None = None) -> int:
    """Write the chunks and vectors in use under a new run, which it returns.

    Vector ids stay, so results do; replaced chunks and vectors are left behind,
    and no ids are dead afterwards. Chunks are shuffled once, into id order.
    With `n_lists` vectors are also laid out in that many new inverted lists,
    which later index runs keep up and which a search may probe; lists that
    there are stay without it, and go with 0. Searches that began before go on
    reading the older folders, which stay until `drop_old_parts`. A failure
    before the commit leaves the index as it was; if another writer commits
    meanwhile, this ends with a Conflict.
    """
    view = store.at()
    base = view.state()
    run_id = view.log.new_run(base)
    tasks = tasks or int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    dead = view.dead_intervals()
    chunks = without(view.chunks(), dead) if dead else view.chunks()
    view.write_chunks(chunks.drop("file_version", "id_block").repartitionByRange(tasks, "vector_id"), run_id)
    lists = base.lists
    if n_lists is None and lists is not None:
        listed = without(view.listed_vectors(), dead) if dead else view.listed_vectors()
        view.write_vectors(by_list(listed), run_id)
    elif n_lists and base.embedding_dim:
        vectors = written(view.live_vectors().select("vector_id", "embedding"))
        centroids = written(train_centroids(vectors, n_lists))
        view.write_centroids(centroids, run_id)
        view.write_vectors(by_list(assign_lists(vectors, centroids, base.embedding_dim)), run_id)
        lists = run_id
    else:
        view.write_vectors(view.live_vectors(), run_id)
        lists = None
    view.write_dead(literal_rows(store.spark, DEAD), run_id)
    view.write_files(view.files().withColumn("file_version", F.lit(run_id).cast("bigint")), run_id)
    view.log.commit(
        base, run_id, snapshot=run_id, runs=(run_id,), dead_ids=0, lists=lists, counters=dict.fromkeys(COUNTERS, 0)
    )
    return run_id


def drop_old_parts(store: IndexStore) -> list[str]:
    """Delete the folders that no reader of the newest state needs; returns them.

    Only for when no search of an older state is under way. A writer that began
    before the last compaction may lose its folders too; it could not commit.
    """
    spark, state = store.spark, store.at().state()
    hadoop = spark._jvm.org.apache.hadoop.fs
    least = {"files": state.snapshot, "centroids": state.lists if state.lists is not None else state.run_id + 1}
    gone = []
    for table, key in TABLES:
        root = hadoop.Path(f"{store.path}/{table}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in files.listStatus(root) if files.exists(root) else ():
            name = folder.getPath().getName()
            # Parts of runs that may still be writing have higher numbers.
            if name.startswith(f"{key}=") and int(name.split("=")[1]) < least.get(table, min(state.runs)):
                files.delete(folder.getPath(), True)
                gone.append(f"{table}/{name}")
    return sorted(gone)
