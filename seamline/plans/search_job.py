"""Search: many queries at once against a stored index or against DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from seamline.fixed_values import BATCH_SIZE, TOP_K
from seamline.functions.embedding import Model, embed_documents, embed_queries, hashing_model, model_name
from seamline.operators.hits import attach_content, hydrate, result_rows, with_chunks, with_files
from seamline.operators.probe import top_k_probe
from seamline.operators.topk import check_k, top_k
from seamline.sources.store import IndexStore
from seamline.sources.table import TableSource
from seamline.sources.tree import TreeSource
from seamline.work import written


def search_index(
    store: IndexStore,
    queries: DataFrame,
    k: int = TOP_K,
    slots: str = "live",
    source: TreeSource | TableSource | None = None,
    load_model: Callable[[], Model] | None = None,
    batch_size: int = BATCH_SIZE,
    n_probe: int | None = None,
) -> DataFrame:
    """The k best chunks of each (query_id, query) row, with file and text.

    slots="live" ranks vectors in use. slots="all" ranks every stored vector
    and then drops those out of use, so a query may get fewer than k rows.
    With a `source`, content is cut from the files as they are now; without,
    it is the text that was indexed. With `n_probe` a query looks only at the
    vectors of the lists nearest to it, and folders of lists that no query looks
    at are not read: fewer products, and results that may miss some of the best;
    as many as there are lists give the exact result.
    """
    check_k(k)
    store = store.at()  # every read below is of one snapshot, whatever is committed meanwhile
    if slots not in ("live", "all"):
        raise ValueError('slots must be "live" or "all"')
    dim = store.params().check().embedding_dim
    model = load_model or hashing_model(dim)
    store.check_model(dim, model_name(model))
    embedded = written(_embed(queries, model, dim, batch_size))
    dead = store.dead_intervals() if slots == "live" else None
    if n_probe is None:
        hits = top_k(embedded, store.vectors(), k, dim, dead=dead)
    else:
        if store.centroids() is None:
            raise ValueError("the index has no lists; compact_index(store, n_lists=...) makes them")
        hits = top_k_probe(embedded, store.listed_vectors(), store.centroids(), k, n_probe, dim, dead=dead)
    hits = written(hits)
    # Written: from its size on disk the planner sees that it can be broadcast.
    found = written(with_chunks(hits, store.chunks_of(hits)))
    found = with_files(found, store.files())
    if source is not None:
        found = written(found)
        found = attach_content(found, source.read(found.select("path").distinct()))
    return result_rows(found)


def search_chunks(
    queries: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    dim: int,
    k: int = TOP_K,
    load_model: Callable[[], Model] | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """The same search over chunks (with vector_id, text) that are not stored."""
    model = load_model or hashing_model(dim)
    vectors = chunks.select(
        "vector_id", embed_documents(F.col("text"), model, dim, batch_size).alias("embedding")
    )
    # Written: each text is embedded once, however often the search scans vectors or queries.
    hits = top_k(written(_embed(queries, model, dim, batch_size)), written(vectors), k, dim)
    return result_rows(hydrate(written(hits), chunks, files))


def _embed(queries: DataFrame, load_model, dim: int, batch_size: int) -> DataFrame:
    return queries.select(
        "query_id", embed_queries(F.col("query"), load_model, dim, batch_size).alias("embedding")
    )
