"""The incremental index run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from seamline.fixed_values import BATCH_SIZE
from seamline.functions.embedding import Model, embed_documents, hashing_model, model_name
from seamline.functions.paths import language
from seamline.operators.changes import compare_scan, counters, decide
from seamline.operators.chunking import chunk_lines
from seamline.operators.ids import assign_vector_ids, in_id_order
from seamline.operators.intervals import merged
from seamline.operators.probe import assign_lists, by_list
from seamline.params import IndexParams
from seamline.sources.store import COUNTERS, IndexStore
from seamline.sources.table import TableSource
from seamline.sources.tree import TreeSource
from seamline.work import discard, literal_rows, written

_CHUNKS_PER_TASK = 50_000


def index_files(
    store: IndexStore,
    source: TreeSource | TableSource,
    load_model: Callable[[], Model] | None = None,
    batch_size: int = BATCH_SIZE,
    force: bool = False,
) -> DataFrame:
    """Bring the stored index in line with `source`; returns the run's counters.

    1. Compare path and mtime with the manifest; no text is read.
    2. Read new and updated files once and stage their chunks, which stay in the
       tasks that read them.
    3. Count chunks by path, decide, and hand out vector ids in path order, all
       on narrow rows.
    4. Shuffle the staged chunks once, into ranges of ids, and write them.
    5. Embed the written chunks and write vectors, by list where the index has
       lists.
    6. Write the ids that fell out of use and the new manifest, then commit.

    A file is indexed as it was when it was read; if it changes meanwhile, its
    stored mtime is the earlier one and the next run reads it again. A failure
    anywhere before the commit leaves the index as it was, and so does another
    writer's commit in between: the run ends with a Conflict.
    """
    params = store.params().check()
    size, overlap, dim = params.chunk_size_lines, params.chunk_overlap_lines, params.embedding_dim
    model = load_model or hashing_model(dim)
    store = store.at()
    base = store.state()
    store.check_model(dim, model_name(model))
    run_id = store.log.new_run(base)

    scan = source.listing(params.include_extensions)
    compared = written(compare_scan(scan, store.files(), force))
    staged, counts = _staged(source, compared, params)
    plan = written(decide(compared.join(counts, "path", "left"), F.col("n_chunks")))
    dropped = F.coalesce(
        F.sum(F.when(F.col("drop_old"), F.col("old_n_chunks"))), F.lit(0)
    ).alias("dropped_chunks")
    totals = plan.agg(*counters(), dropped).first().asDict()
    result = {name: totals[name] for name in COUNTERS}
    n_chunks, n_dropped, first_id = totals["total_chunks"], totals["dropped_chunks"], store.log.next_vector_id(base)
    changed = any(totals[n] for n in ("new_files", "updated_files", "deleted_files", "dropped_chunks"))
    facts = {}

    if n_chunks:
        store.log.reserve_ids(run_id, first_id + n_chunks)
        files = plan.where(F.col("action").isin("new", "updated")).select("path", "n_chunks")
        placed = written(assign_vector_ids(files, first_id))
        tasks = max(store.spark.sparkContext.defaultParallelism, -(-n_chunks // _CHUNKS_PER_TASK))
        store.write_chunks(in_id_order(staged, placed, first_id, n_chunks, tasks), run_id)
        _write_vectors(store, run_id, model, dim, batch_size)
        facts = dict(next_vector_id=first_id + n_chunks, embedding_dim=dim, embedder=model_name(model))
    else:
        placed = literal_rows(store.spark, "path string, first_vector_id bigint")
    if changed:
        if n_dropped:
            store.write_dead(dropped_ids(plan), run_id)
        store.write_files(next_manifest(plan, placed.select("path", "first_vector_id"), run_id), run_id)
        facts.update(snapshot=run_id)
    runs = base.runs + (run_id,) if n_chunks or n_dropped else base.runs
    store.log.commit(base, run_id, runs=runs, dead_ids=base.dead_ids + n_dropped, counters=result, **facts)
    discard(staged)
    return literal_rows(store.spark, ", ".join(f"{name} bigint" for name in COUNTERS), result)


def _staged(source, compared: DataFrame, params: IndexParams) -> tuple[DataFrame, DataFrame]:
    """The written chunks of all touched files, and their number by path."""
    is_touched = F.col("state").isin("new", "updated")
    wanted = [c for c in ("path", "size") if c in compared.columns]
    touched = written(compared.where(is_touched).select(*wanted))
    n = compared.agg(F.count_if(is_touched).alias("touched"), F.count_if(F.col("state") != "deleted").alias("listed")).first()
    all_of_them = n["touched"] == n["listed"]
    texts = source.read_touched(touched, params.include_extensions, all_of_them)
    if not n["touched"]:
        texts = texts.limit(0)
    staged = written(staged_chunks(texts, params.chunk_size_lines, params.chunk_overlap_lines))
    counts = written(staged.groupBy("path").agg(F.count("*").cast("int").alias("n_chunks")))
    for row in counts.join(touched, "path", "left_anti").take(1) if all_of_them else ():
        raise ValueError(f"the source listed no such file a moment ago: {row['path']}")
    return staged, counts


def staged_chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """path, chunk_no, start_line, end_line, text of the files' chunks, where the files are."""
    return chunk_lines(texts.select("path", "text"), size, overlap)


def _write_vectors(store: IndexStore, run_id: int, model: Callable[[], Model], dim: int, batch_size: int) -> None:
    vectors = store.run_chunks(run_id).select(
        "vector_id", embed_documents(F.col("text"), model, dim, batch_size).alias("embedding")
    )
    centroids = store.centroids()
    if centroids is not None:
        vectors = by_list(assign_lists(vectors, centroids, dim))
    store.write_vectors(vectors, run_id)


def dropped_ids(plan: DataFrame) -> DataFrame:
    """Intervals of the vector ids of the chunks that updated, emptied and deleted files had: a row per file."""
    first, n = F.col("old_first_vector_id"), F.col("old_n_chunks")
    gone = plan.where(F.col("drop_old") & (n > 0))
    return merged(gone.select(first.alias("first_id"), (first + n - 1).alias("last_id")))


def next_manifest(plan: DataFrame, placed: DataFrame, run_id: int) -> DataFrame:
    """Manifest after the run.

    New and updated files get the run as their version. A known file that is
    now empty keeps its old mtime, so that it is looked at again, under a
    version that has no chunks. Unchanged rows stay, deleted ones go, and new
    files without chunks are not recorded.
    """
    stored_now = F.col("action").isin("new", "updated")
    emptied = ~stored_now & F.col("drop_old")

    def pick(new, empty, old):
        return F.when(stored_now, new).when(emptied, empty).otherwise(old)

    kept = plan.where(stored_now | ((F.col("action") == "skip") & F.col("known")))
    return kept.join(placed, "path", "left").select(
        "path",
        pick(F.col("mtime"), F.col("old_mtime"), F.col("old_mtime")).alias("mtime"),
        pick(language(F.col("path")), F.col("old_language"), F.col("old_language")).alias("language"),
        pick(F.lit(run_id), F.lit(run_id), F.col("old_file_version")).alias("file_version"),
        pick(
            F.col("first_vector_id"), F.lit(None).cast("bigint"), F.col("old_first_vector_id")
        ).alias("first_vector_id"),
        pick(F.col("n_chunks"), F.lit(0), F.col("old_n_chunks")).cast("int").alias("n_chunks"),
    )
