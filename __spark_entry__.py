"""Registered queries over the given tables, each with SQL that must agree.

`documents` stands for the source files and `embeddings` for stored vectors.
Where an operator compares two states (stored and current files, old and new
versions), both are derived from every row of `documents`:

- documents in "es" have moved to another folder, those in "fr" were touched by
  a second, those in "de" by less than the mtime tolerance;
- documents in "en" end in a newline, the others do not;
- documents under 20 characters are empty files in the current state.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import oracle
import seamline
from seamline.fixed_values import MAX_TOKENS
from seamline.functions.embedding import embed_documents, hashing_model
from seamline.functions.paths import extension, language, relative_path
from seamline.functions.text import decode_utf8, split_lines, unix_newlines
from seamline.functions.vectors import l2_normalise
from seamline.operators import changes, checks, hits as hit_ops
from seamline.operators.chunking import chunk_lines, count_chunks
from seamline.operators.files import keep_files
from seamline.operators.ids import assign_vector_ids
from seamline.operators.probe import assign_lists, top_k_probe
from seamline.operators.intervals import as_intervals
from seamline.operators.topk import top_k, top_k_single, top_k_without
from seamline.operators.vectors import add_vectors, cut_vectors, delete_vectors
from seamline.params import IndexParams
from seamline.plans.compact_job import compact_index, drop_old_parts
from seamline.plans.index_job import index_files
from seamline.plans.search_job import search_chunks, search_index
from seamline.plans.stats_job import index_stats, table_counts
from seamline.sources.store import IndexStore
from seamline.sources.table import TableSource
from seamline.work import spread, work_folder, written

# Tasks get the package with their functions: it need not be installed for them.
cloudpickle.register_pickle_by_value(seamline)

TEST_DIMS = (64, 32, 16, 8)
TEXT_DIM = 256
STORE_DIM = 128
K = 10

Query = Callable[[SparkSession, str], DataFrame]


# -- derived inputs ------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the queries that embed: a small table is dealt out to all cores."""
    return spread(documents(spark, sf_dir), "doc_id")


def embeddings(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """vector_id, embedding (unit, cut to `dim`), label."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "vector_id")
    return cut_vectors(table, dim, TEST_DIMS)


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vector_id").alias("query_id"), "embedding")


def named_files(docs: DataFrame) -> DataFrame:
    """Adds a path with one of several folders and extensions."""
    folder = F.when(F.col("lang") == "fr", "build/").when(F.col("lang") == "de", "Build/").otherwise("pkg/")
    endings = F.array(*[F.lit(e) for e in (".py", ".PY", ".md", "", ".d.ts", ".json")])
    ending = F.element_at(endings, (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(folder, F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), ending)
    return docs.withColumn("path", path)


def old_path() -> Column:
    return F.concat(F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".py"))


def new_path() -> Column:
    return F.when(F.col("lang") == "es", F.concat(F.lit("moved/"), old_path())).otherwise(old_path())


def ended_text() -> Column:
    return F.when(F.col("lang") == "en", F.concat(F.col("text"), F.lit("\n"))).otherwise(F.col("text"))


def stored_state(docs: DataFrame) -> DataFrame:
    """Files as they were: path, mtime, text."""
    return docs.select(
        old_path().alias("path"), F.col("doc_id").cast("double").alias("mtime"), ended_text().alias("text")
    )


def current_state(docs: DataFrame) -> DataFrame:
    """Files as they are now: path, mtime, text."""
    small = F.col("n_chars") < 20
    later = F.when(small | (F.col("lang") == "fr"), 1.0).when(F.col("lang") == "de", 0.0005).otherwise(0.0)
    return docs.select(
        new_path().alias("path"),
        (F.col("doc_id").cast("double") + later).alias("mtime"),
        F.when(small, "").otherwise(ended_text()).alias("text"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    return stored_state(docs).select(
        "path", "mtime", language(F.col("path")).alias("language"), F.lit(1).cast("bigint").alias("file_version")
    )


def document_chunks(docs: DataFrame, size: int, overlap: int, first_only: bool = False) -> DataFrame:
    return chunk_lines(docs.select("doc_id", ended_text().alias("text")), size, overlap, first_only)


def versioned_files(docs: DataFrame) -> DataFrame:
    """Current files: those in "fr" at version 2, "es" gone, the others at 1."""
    version = F.when(F.col("lang") == "fr", 2).otherwise(1).cast("bigint")
    return docs.where(F.col("lang") != "es").select(
        old_path().alias("path"), version.alias("file_version"), language(old_path()).alias("language")
    )


def versioned_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of version 1 of every file and of version 2 of those in "fr"."""
    versions = F.when(F.col("lang") == "fr", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    files = docs.select(
        old_path().alias("path"), F.explode(versions.cast("array<bigint>")).alias("file_version"),
        ended_text().alias("text"),
    )
    return chunk_lines(files, 8, 2)


def identified_chunks(docs: DataFrame) -> DataFrame:
    """Chunks 8/2 of the stored state with dense ids in path order."""
    files = stored_state(docs).select("path", "text")
    placed = assign_vector_ids(count_chunks(files, 8, 2)).select("path", "first_vector_id")
    chunks = chunk_lines(files.join(placed, "path"), 8, 2)
    return chunks.select(
        "path", F.lit(1).cast("bigint").alias("file_version"), "chunk_no", "start_line", "end_line",
        "text", (F.col("first_vector_id") + F.col("chunk_no")).alias("vector_id"),
    )


def components(vector: Column) -> Column:
    """Millionths as text, so that engines compare the same characters."""
    millionths = F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string"))
    return F.array_join(millionths, ",")


def sparse_components(vector: Column) -> Column:
    """bucket:millionths of the components that are not zero."""
    pairs = F.transform(
        vector,
        lambda x, i: F.concat(
            i.cast("string"), F.lit(":"), F.round(x.cast("double") * 1e6).cast("bigint").cast("string")
        ),
    )
    zero = F.filter(F.arrays_zip(pairs.alias("p"), vector.alias("v")), lambda z: z["v"] != 0)
    return F.array_join(F.transform(zero, lambda z: z["p"]), ",")


# -- queries: files, lines, chunks ---------------------------------------------


def source_filter(spark, sf_dir):
    files = named_files(documents(spark, sf_dir)).select("doc_id", "path")
    return keep_files(files, [".py", ".TS", ".json"], ["build", "dist"])


def language_map(spark, sf_dir):
    path = F.col("path")
    return named_files(documents(spark, sf_dir)).select(
        "path", extension(path).alias("extension"), language(path).alias("language")
    )


def decode_lines(spark, sf_dir):
    """Text is stored with Windows newlines and stray bytes around it."""
    encoded = F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "UTF-8")
    docs = documents(spark, sf_dir).withColumn(
        "content", F.concat(F.unhex(F.lit("FF")), encoded, F.unhex(F.lit("E282")))
    )
    texts = docs.select("doc_id", unix_newlines(decode_utf8(F.col("content"))).alias("text"))
    lines = texts.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def chunk_documents(spark, sf_dir):
    return document_chunks(documents(spark, sf_dir), 8, 2)


def chunk_default(spark, sf_dir):
    return document_chunks(documents(spark, sf_dir), 64, 16)


def chunk_bad_stride(spark, sf_dir):
    """The first chunk of each text, which is all that such sizes give."""
    return document_chunks(documents(spark, sf_dir), 8, 8, first_only=True)


def line_range(spark, sf_dir):
    """Stored ranges read from current files: "es" gone, "fr" joined to one line."""
    docs = documents(spark, sf_dir)
    found = chunk_lines(stored_state(docs).select("path", "text"), 8, 2).drop("text")
    text = F.when(F.col("lang") == "fr", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    source = docs.where(F.col("lang") != "es").select(
        old_path().alias("path"), F.coalesce(text, ended_text()).alias("text")
    )
    return hit_ops.attach_content(found, source)


# -- queries: embedding --------------------------------------------------------


def embed_hash(spark, sf_dir):
    chunks = document_chunks(spread_documents(spark, sf_dir), 8, 2)
    vector = embed_documents(F.col("text"), hashing_model(TEXT_DIM), TEXT_DIM)
    return chunks.select("doc_id", "chunk_no", vector.alias("v")).select(
        "doc_id", "chunk_no", sparse_components(F.col("v")).alias("vector")
    )


def embed_token_limit(spark, sf_dir):
    """The length limit of the default model, on the longest chunks there are."""
    chunks = document_chunks(spread_documents(spark, sf_dir), 1 << 20, 16)
    vector = embed_documents(F.col("text"), hashing_model(TEXT_DIM, MAX_TOKENS), TEXT_DIM)
    return chunks.select("doc_id", "chunk_no", vector.alias("v")).select(
        "doc_id", "chunk_no", sparse_components(F.col("v")).alias("vector")
    )


def mrl_normalise(spark, sf_dir):
    return embeddings(spark, sf_dir, 32).select("vector_id", components(F.col("embedding")).alias("vector"))


# -- queries: stored vectors ---------------------------------------------------


def add_vectors_query(spark, sf_dir):
    """Every vector, doubled in length, added again under a new id."""
    stored = embeddings(spark, sf_dir).select("vector_id", "embedding")
    new = stored.select(
        (F.col("vector_id") + 1_000_000).alias("vector_id"),
        F.transform("embedding", lambda x: x * 2).alias("embedding"),
    )
    both = add_vectors(stored, new, 64)
    return both.select("vector_id", components(F.col("embedding")).alias("vector"))


def topk_single(spark, sf_dir):
    """The best vectors for the mean of all vectors."""
    vectors = embeddings(spark, sf_dir)
    mean = vectors.agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    query = mean.select(l2_normalise(vector_to_array("m")).alias("q")).first()["q"]
    return top_k_single(vectors, query, K).withColumn("score", F.round("score", 4))


def topk_batch(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    return top_k(as_queries(vectors), vectors, K, 64).withColumn("score", F.round("score", 4))


def live_ids(spark, sf_dir) -> DataFrame:
    """Vectors whose document is in "en" count as live."""
    return documents(spark, sf_dir).where(F.col("lang") == "en").select(F.col("doc_id").alias("vector_id"))


def topk_live(spark, sf_dir):
    vectors = embeddings(spark, sf_dir, 32)
    live = vectors.join(live_ids(spark, sf_dir), "vector_id", "left_semi")
    return top_k(as_queries(vectors), live, K, 32).withColumn("score", F.round("score", 4))


def topk_all_slots(spark, sf_dir):
    """Ranked over all vectors; those that are not live then leave their place empty."""
    vectors = embeddings(spark, sf_dir, 32)
    hits = top_k(as_queries(vectors), vectors, K, 32)
    kept = hits.join(live_ids(spark, sf_dir), "vector_id", "left_semi")
    return kept.select("query_id", "rank", "vector_id", F.round("score", 4).alias("score"))


def topk_probe(spark, sf_dir):
    """Lists are the labels, their centroids the means of the labelled vectors."""
    vectors = embeddings(spark, sf_dir, 32)
    means = vectors.groupBy(F.col("label").cast("bigint").alias("list_id")).agg(
        Summarizer.mean(array_to_vector("embedding")).alias("m")
    )
    centroids = written(means.select("list_id", l2_normalise(vector_to_array("m")).alias("embedding")))
    listed = assign_lists(vectors.select("vector_id", "embedding"), centroids, 32)
    hits = top_k_probe(as_queries(vectors), listed, centroids, K, 3, 32)
    return hits.withColumn("score", F.round("score", 4))


def topk_blocks(spark, sf_dir):
    """`topk_batch` with queries in many blocks, dealt out as a grid with the vectors."""
    vectors = embeddings(spark, sf_dir)
    return top_k(as_queries(vectors), vectors, K, 64, block_rows=100).withColumn("score", F.round("score", 4))


def topk_dead(spark, sf_dir):
    """`topk_live` by leaving out, while vectors are read, the intervals of the ids that are not live."""
    vectors = embeddings(spark, sf_dir, 32)
    gone = vectors.select("vector_id").join(live_ids(spark, sf_dir), "vector_id", "left_anti")
    hits = top_k_without(as_queries(vectors), vectors, as_intervals(gone), K, 32, at_once=100)
    return hits.withColumn("score", F.round("score", 4))


def delete_vectors_query(spark, sf_dir):
    """Without the vectors whose document is labelled toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("vector_id"))
    return delete_vectors(embeddings(spark, sf_dir).select("vector_id", "label"), toxic)


# -- queries: manifest ---------------------------------------------------------


def decided_plan(docs: DataFrame) -> DataFrame:
    now = current_state(docs)
    compared = changes.compare_scan(now.select("path", "mtime"), manifest(docs))
    counts = count_chunks(now.select("path", "text"), 64, 16)
    return changes.decide(compared.join(counts, "path", "left"), F.col("n_chunks"))


def plan_changes(spark, sf_dir):
    return decided_plan(documents(spark, sf_dir)).select("path", "action", "n_chunks", "drop_old")


def run_stats(spark, sf_dir):
    return changes.run_counters(decided_plan(documents(spark, sf_dir)))


def upsert_files(spark, sf_dir):
    docs = documents(spark, sf_dir)
    now = current_state(docs).select("path", "mtime", F.lit("changed").alias("language"))
    return changes.upsert(manifest(docs), now)


def delete_missing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return changes.delete_missing(manifest(docs), current_state(docs)).select("path", "mtime")


def missing_files(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return changes.missing(manifest(docs), current_state(docs)).select("path", "mtime")


def live_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    live = changes.live_chunks(versioned_chunks(docs), versioned_files(docs))
    return live.select("path", "file_version", "chunk_no", "start_line", "end_line")


def replaced_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    gone = changes.replaced_chunks(versioned_chunks(docs), versioned_files(docs))
    return gone.select("path", "file_version", "chunk_no")


def vector_ids(spark, sf_dir):
    """Folders whose order by parts differs from their order as strings."""
    folders = F.array(F.lit("a/b/"), F.lit("a-b/"), F.lit("a/"))
    folder = F.element_at(folders, (F.col("doc_id") % 3 + 1).cast("int"))
    files = documents(spark, sf_dir).select(
        F.concat(folder, F.col("source"), F.lit("/f"), F.col("doc_id").cast("string")).alias("path"),
        ended_text().alias("text"),
    )
    return assign_vector_ids(count_chunks(files, 8, 2), 1000)


# -- queries: checks and counts ------------------------------------------------


def orphan_vectors(spark, sf_dir):
    docs = documents(spark, sf_dir)
    chunks = identified_chunks(docs)
    live = changes.live_chunks(chunks, versioned_files(docs))
    return checks.orphan_vectors(chunks, live)


def broken_references(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return checks.broken_references(
        versioned_chunks(docs).select("path", "file_version", "chunk_no"), versioned_files(docs)
    )


def duplicate_paths(spark, sf_dir):
    """One path per source and language, hence shared by many documents."""
    path = F.concat_ws("/", "source", "lang")
    return checks.duplicates(documents(spark, sf_dir).select(path.alias("path")), "path")


def store_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return table_counts(manifest(docs), document_chunks(docs, 8, 2), embeddings(spark, sf_dir))


# -- queries: search -----------------------------------------------------------


def vector_hits(spark, sf_dir) -> DataFrame:
    """Hits on given vectors; vector ids stand for chunks of the documents."""
    vectors = embeddings(spark, sf_dir, 32)
    return written(top_k(as_queries(vectors), vectors, K, 32))


def hydrate_hits(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = hit_ops.hydrate(vector_hits(spark, sf_dir), identified_chunks(docs), versioned_files(docs))
    return found.select("query_id", "rank", "path", "start_line", "end_line", "language")


def result_rows(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = hit_ops.hydrate(vector_hits(spark, sf_dir), identified_chunks(docs), versioned_files(docs))
    return hit_ops.json_rows(hit_ops.result_rows(found))


def result_preview(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = hit_ops.hydrate(vector_hits(spark, sf_dir), identified_chunks(docs), versioned_files(docs))
    blocks = hit_ops.text_rows(hit_ops.result_rows(found), 5)
    return blocks.select("query_id", "rank", "block")


def text_queries(spark, sf_dir) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return table.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def search_text(spark, sf_dir):
    """Every text of `benchmark` against all chunks of all documents."""
    chunks = written(identified_chunks(spread_documents(spark, sf_dir)))
    files = manifest(documents(spark, sf_dir))
    results = search_chunks(text_queries(spark, sf_dir), chunks, files, TEXT_DIM, K)
    return hit_ops.json_rows(results)


# -- queries: the stored index -------------------------------------------------


def two_runs(spark, sf_dir) -> IndexStore:
    """An index of the stored state, then brought up to the current one."""
    docs = spread_documents(spark, sf_dir)
    params = IndexParams(embedding_dim=STORE_DIM, chunk_size_lines=8, chunk_overlap_lines=2)
    store = IndexStore(spark, work_folder(spark)).create(params)
    index_files(store, TableSource(stored_state(docs)))
    index_files(store, TableSource(current_state(docs)))
    return store


def index_two_runs(spark, sf_dir):
    """Chunks in use after both runs; vectors are joined to see that each has its one."""
    store = two_runs(spark, sf_dir)
    chunks = changes.live_chunks(store.chunks(), store.files())
    return chunks.join(store.live_vectors().select("vector_id"), "vector_id").select(
        "path", "file_version", "chunk_no", "start_line", "end_line", "text", "vector_id"
    )


def index_search(spark, sf_dir):
    """Search after both runs; content comes from the files as they are now."""
    source = TableSource(current_state(documents(spark, sf_dir)))
    results = search_index(two_runs(spark, sf_dir), text_queries(spark, sf_dir), K, source=source)
    return hit_ops.json_rows(results)


def index_lists(spark, sf_dir):
    """Search of the index after both runs, by inverted lists made between them; all lists are probed."""
    docs = spread_documents(spark, sf_dir)
    params = IndexParams(embedding_dim=STORE_DIM, chunk_size_lines=8, chunk_overlap_lines=2)
    store = IndexStore(spark, work_folder(spark)).create(params)
    index_files(store, TableSource(stored_state(docs)))
    compact_index(store, n_lists=8)
    index_files(store, TableSource(current_state(docs)))
    return hit_ops.json_rows(search_index(store, text_queries(spark, sf_dir), K, n_probe=8))


def compact_index_query(spark, sf_dir):
    """Chunks in use after both runs and a compaction that drops the older parts."""
    store = two_runs(spark, sf_dir)
    compact_index(store)
    drop_old_parts(store)
    chunks = changes.live_chunks(store.chunks(), store.files())
    return chunks.join(store.vectors().select("vector_id"), "vector_id").select(
        "path", "chunk_no", "start_line", "end_line", "text", "vector_id"
    )


def index_stats_query(spark, sf_dir):
    """Counts of the index after both runs, and its parameters as saved and loaded."""
    return index_stats(two_runs(spark, sf_dir)).drop("path")


def relative_paths(spark, sf_dir):
    """Paths below the folder of one language; the others are not below it."""
    path = F.concat(F.lit("/data/"), F.col("lang"), F.lit("/"), old_path())
    return documents(spark, sf_dir).select("doc_id", relative_path(path, "/data/en").alias("path"))


def result_json(spark, sf_dir):
    """Result rows as the JSON files hold them."""
    docs = documents(spark, sf_dir)
    found = hit_ops.hydrate(vector_hits(spark, sf_dir), identified_chunks(docs), versioned_files(docs))
    folder = work_folder(spark)
    hit_ops.write_json(hit_ops.result_rows(found), folder)
    schema = (
        "query_id bigint, rank int, file_path string, start_line int, end_line int, score double, "
        "language string, content string"
    )
    return spark.read.schema(schema).json(folder)


# -- contract ------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Search of all documents at the smallest scale."""
    return search_text(spark, "/root/testdata/sf0.001")


def llm_parts():
    """The modules of the training-data operators, if they are there; any other import that fails is an error."""
    try:
        from seamline.llm import queries as registered_llm, sql

        import corpus_pipeline
    except ModuleNotFoundError as error:
        if error.name not in ("seamline.llm", "seamline.llm.queries", "corpus_pipeline"):
            raise
        return None
    except ImportError as error:
        # An empty folder that is left behind is a package without modules.
        if error.name != "seamline.llm":
            raise
        return None
    return registered_llm, sql, corpus_pipeline


def queries() -> dict[str, Query]:
    parts = llm_parts()
    if parts:
        registered_llm, _, pipeline = parts
        return {**own_queries(), **registered_llm.queries(), "pipeline": pipeline.run}
    return own_queries()


def own_queries() -> dict[str, Query]:
    return {
        "source_filter": source_filter,
        "language_map": language_map,
        "decode_lines": decode_lines,
        "chunk_documents": chunk_documents,
        "chunk_default": chunk_default,
        "chunk_bad_stride": chunk_bad_stride,
        "line_range": line_range,
        "embed_hash": embed_hash,
        "embed_token_limit": embed_token_limit,
        "mrl_normalise": mrl_normalise,
        "add_vectors": add_vectors_query,
        "topk_single": topk_single,
        "topk_batch": topk_batch,
        "topk_live": topk_live,
        "topk_all_slots": topk_all_slots,
        "topk_probe": topk_probe,
        "topk_blocks": topk_blocks,
        "topk_dead": topk_dead,
        "delete_vectors": delete_vectors_query,
        "plan_changes": plan_changes,
        "run_stats": run_stats,
        "upsert_files": upsert_files,
        "delete_missing": delete_missing,
        "missing_files": missing_files,
        "live_chunks": live_chunks,
        "replaced_chunks": replaced_chunks,
        "vector_ids": vector_ids,
        "orphan_vectors": orphan_vectors,
        "broken_references": broken_references,
        "duplicate_paths": duplicate_paths,
        "store_stats": store_stats,
        "hydrate_hits": hydrate_hits,
        "result_rows": result_rows,
        "result_preview": result_preview,
        "search_text": search_text,
        "index_two_runs": index_two_runs,
        "index_search": index_search,
        "index_lists": index_lists,
        "compact_index": compact_index_query,
        "index_stats": index_stats_query,
        "relative_paths": relative_paths,
        "result_json": result_json,
    }


def oracle_sql() -> dict[str, str]:
    parts = llm_parts()
    if parts:
        _, sql, pipeline = parts
        of_pipeline = {"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {}
        return {**oracle.statements(), **sql.statements(), **of_pipeline}
    return oracle.statements()
