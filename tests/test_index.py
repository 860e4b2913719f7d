from __future__ import annotations

import dataclasses
import json
import os

import pytest
from pyspark.sql import functions as F

from seamline.functions.embedding import hashing_model
from seamline.operators import changes, checks
from seamline.operators.hits import write_json, write_text
from seamline.operators.ids import assign_vector_ids
from seamline.params import IndexParams
from seamline.plans.index_job import index_files
from seamline.plans.search_job import search_index
from seamline.plans.stats_job import index_stats
from seamline.sources.store import IndexStore
from seamline.sources.table import TableSource
from seamline.sources.tree import TreeSource

PARAMS = IndexParams(embedding_dim=128, chunk_size_lines=3, chunk_overlap_lines=1)


def lines(word, n):
    return "".join(f"{word} number {i}\n" for i in range(n))


def put(root, name, text, mtime):
    file = root / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)
    os.utime(file, (mtime, mtime))


def counters(df):
    return df.first().asDict()


def live(store):
    rows = changes.live_chunks(store.chunks(), store.files()).collect()
    return sorted((r.path, r.chunk_no, r.start_line, r.end_line, r.text) for r in rows)


def consistent(store):
    """Each chunk in use has one vector, ids are unique, the dead are the rest."""
    chunks = changes.live_chunks(store.chunks(), store.files())
    ids = sorted(r.vector_id for r in chunks.collect())
    assert ids == sorted(r.vector_id for r in store.live_vectors().collect())
    assert checks.duplicates(store.vectors(), "vector_id").isEmpty()
    assert checks.duplicates(store.files(), "path").isEmpty()
    assert checks.broken_references(chunks, store.files()).isEmpty()
    orphans = {r.vector_id for r in checks.orphan_vectors(store.vectors(), chunks).collect()}
    assert orphans == {i for r in store.dead().collect() for i in range(r.first_id, r.last_id + 1)}
    assert store.n_dead() == len(orphans)
    planned = store.files().agg(F.sum("n_chunks")).first()[0] or 0
    assert planned == len(ids)


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "root"
    put(root, "same.py", lines("same", 5), 100.0)
    put(root, "near.py", lines("near", 5), 100.0)
    put(root, "later.py", lines("later", 9), 100.0)
    put(root, "emptied.py", lines("emptied", 4), 100.0)
    put(root, "sub/removed.rs", lines("removed", 4), 100.0)
    return root


def second_state(root):
    os.utime(root / "near.py", (100.0005, 100.0005))
    put(root, "later.py", lines("changed", 7), 101.0)
    put(root, "emptied.py", "", 101.0)
    (root / "sub/removed.rs").unlink()
    put(root, "added.ts", lines("added", 3), 101.0)


def test_two_runs(spark, root, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    source = TreeSource(spark, str(root))
    assert counters(index_files(store, source)) == dict(
        new_files=5, updated_files=0, skipped_files=0, deleted_files=0, total_chunks=3 + 3 + 5 + 2 + 2
    )
    consistent(store)
    ids = {(r.path, r.chunk_no): r.vector_id for r in store.chunks().collect()}
    assert [ids[key] for key in sorted(ids)] == list(range(15))

    second_state(root)
    assert counters(index_files(store, source)) == dict(
        new_files=1, updated_files=1, skipped_files=3, deleted_files=1, total_chunks=2 + 4
    )
    consistent(store)
    files = {r.path: r for r in store.files().collect()}
    assert set(files) == {"same.py", "near.py", "later.py", "emptied.py", "added.ts"}
    assert files["emptied.py"].mtime == 100.0 and files["emptied.py"].n_chunks == 0
    assert files["near.py"].mtime == 100.0 and files["later.py"].mtime == 101.0
    assert files["added.ts"].language == "typescript" and files["same.py"].file_version == 1
    assert min(r.vector_id for r in store.chunks().where("file_version = 2").collect()) == 15

    # A third run finds only the emptied file to look at again.
    assert counters(index_files(store, source)) == dict(
        new_files=0, updated_files=0, skipped_files=5, deleted_files=0, total_chunks=0
    )
    consistent(store)

    # The increments hold what one full run would.
    fresh = IndexStore(spark, str(tmp_path / "fresh")).create(PARAMS)
    index_files(fresh, source)
    assert live(store) == live(fresh)
    queries = spark.createDataFrame([(1, "changed number"), (2, "same near")], "query_id int, query string")
    columns = ["query_id", "file_path", "start_line", "score"]
    found = [
        sorted(search_index(s, queries, 50).select(*columns).collect()) for s in (store, fresh)
    ]
    assert [r[:3] for r in found[0]] == [r[:3] for r in found[1]]
    assert [r.score for r in found[0]] == pytest.approx([r.score for r in found[1]])

    # A path that comes back is new, with chunks of its own version.
    put(root, "sub/removed.rs", lines("removed", 4), 100.0)
    again = counters(index_files(store, source))
    assert again["new_files"] == 1 and again["total_chunks"] == 2
    consistent(store)


def test_force_rebuilds(spark, root, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    source = TreeSource(spark, str(root))
    index_files(store, source)
    before = live(store)
    assert counters(index_files(store, source, force=True))["updated_files"] == 5
    assert live(store) == before and store.n_dead() == 15
    consistent(store)


def test_extensions_of_the_parameters(spark, root, tmp_path):
    """A file that the parameters no longer include leaves the index."""
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    source = TreeSource(spark, str(root))
    index_files(store, source)
    store.create(dataclasses.replace(PARAMS, include_extensions=(".RS",)))
    assert counters(index_files(store, source))["deleted_files"] == 4
    assert [r.path for r in store.files().collect()] == ["sub/removed.rs"]
    consistent(store)


def test_failed_run_changes_nothing(spark, root, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    source = TreeSource(spark, str(root))
    index_files(store, source)
    before = live(store)
    second_state(root)

    def broken():
        raise RuntimeError("no such model")

    broken.model_name = hashing_model(PARAMS.embedding_dim).model_name
    with pytest.raises(Exception, match="no such model"):
        index_files(store, source, load_model=broken)
    assert live(store) == before
    consistent(store)
    index_files(store, source)
    consistent(store)
    # Run 2 failed; its number and its ids are not used again.
    assert {r.file_version for r in store.chunks().collect()} == {1, 3}
    assert min(r.vector_id for r in store.chunks().where("file_version = 3").collect()) == 21


def test_table_equals_tree(spark, root, tmp_path):
    """Also for a run that touches little of the table and one that touches most."""
    for i in range(12):
        put(root, f"more/{i}.py", lines("more", i), 100.0)
    tree = TreeSource(spark, str(root))
    stores = [IndexStore(spark, str(tmp_path / name)).create(PARAMS) for name in "ab"]
    for change in (lambda: None, lambda: second_state(root)):
        change()
        rows = tree.read_all(tree.listing()).select("path", "mtime", F.encode("text", "UTF-8").alias("content"))
        got = []
        for store, source in zip(stores, (tree, TableSource(rows))):
            result = counters(index_files(store, source))
            columns = ["path", "chunk_no", "text", "vector_id", "file_version"]
            got.append((result, sorted(map(tuple, store.chunks().select(*columns).collect()))))
        assert got[0] == got[1]
    consistent(stores[1])


def test_path_twice_ends_the_job(spark, tmp_path):
    table = spark.createDataFrame([("a.py", 1.0, "x")] * 2, "path string, mtime double, text string")
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    with pytest.raises(Exception, match="more than once: a.py"):
        index_files(store, TableSource(table))


def test_nothing_to_index(spark, tmp_path):
    table = spark.createDataFrame([], "path string, mtime double, text string")
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    assert set(counters(index_files(store, TableSource(table))).values()) == {0}
    queries = spark.createDataFrame([(1, "x")], "query_id int, query string")
    assert search_index(store, queries).isEmpty()


def test_create_keeps_tables(spark, root, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    index_files(store, TreeSource(spark, str(root)))
    again = IndexStore(spark, store.path).create(IndexParams(embedding_dim=256))
    assert again.params().embedding_dim == 256 and again.files().count() == 5
    with pytest.raises(ValueError, match="128 components"):
        index_files(again, TreeSource(spark, str(root)))
    with pytest.raises(ValueError, match="embedding_dim"):
        store.create(IndexParams(embedding_dim=5))
    with pytest.raises(FileNotFoundError):
        IndexStore(spark, str(tmp_path / "none")).files()


def test_stats(spark, root, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    source = TreeSource(spark, str(root))
    index_files(store, source)
    second_state(root)
    index_files(store, source)
    row = index_stats(store).first()
    assert (row.file_count, row.chunk_count, row.vector_count) == (5, 12, 21)
    assert (row.embedding_dim, row.chunk_size_lines, row.chunk_overlap_lines) == (128, 3, 1)


def test_search_options(spark, root, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    source = TreeSource(spark, str(root))
    index_files(store, source)
    second_state(root)
    index_files(store, source)
    queries = spark.createDataFrame([("q", "later changed number")], "query_id string, query string")

    results = search_index(store, queries, 4).orderBy("rank").collect()
    assert [r["rank"] for r in results] == [1, 2, 3, 4]
    assert all(r.content.startswith("changed number") for r in results[:2])
    assert results[0].language == "python" and results[0].file_path == "later.py"
    scores = [r.score for r in results]
    assert scores == sorted(scores, reverse=True)

    everything = search_index(store, queries, 21, slots="all")
    assert everything.count() == 12 and everything.agg(F.max("rank")).first()[0] > 12
    with pytest.raises(ValueError):
        search_index(store, queries, 4, slots="some")
    with pytest.raises(ValueError):
        search_index(store, queries, -1)
    assert search_index(store, queries, 0).isEmpty()

    # Content as it is now: cut short, past the end, gone.
    put(root, "later.py", "now one line", 200.0)
    (root / "added.ts").unlink()
    rows = search_index(store, queries, 21, source=source).collect()
    now = {(r.file_path, r.start_line): r.content for r in rows}
    assert now["later.py", 1] == "now one line" and now["later.py", 3] == ""
    assert now["added.ts", 1].startswith("[Error reading file: ")
    assert now["same.py", 3] == "same number 2\nsame number 3\nsame number 4\n"


def test_result_files(spark, root, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    index_files(store, TreeSource(spark, str(root)))
    queries = spark.createDataFrame([(1, "same number")], "query_id int, query string")
    results = search_index(store, queries, 3)
    write_json(results, str(tmp_path / "json"))
    lines_of = spark.read.text(str(tmp_path / "json")).collect()
    rows = [json.loads(r.value) for r in lines_of]
    assert {"file_path", "start_line", "end_line", "score", "language", "content"} <= set(rows[0])
    assert all(r["score"] == round(r["score"], 4) for r in rows) and len(rows) == 3
    write_text(results, str(tmp_path / "text"), max_lines=2)
    written = [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert sum(" score=0." in w for w in written) == 3 and "        ..." in written


def test_ids_in_many_ranges(spark):
    rows = spark.range(3000).select(
        F.concat(F.element_at(F.array(F.lit("a/b/"), F.lit("a-b/"), F.lit("a/")), (F.col("id") % 3 + 1).cast("int")), F.col("id").cast("string")).alias("path"),
        (F.col("id") % 4).cast("int").alias("n_chunks"),
    )
    got = assign_vector_ids(rows.repartition(7), 10).collect()
    expected, at = {}, 10
    for r in sorted(rows.collect(), key=lambda r: r.path.split("/")):
        expected[r.path] = at
        at += r.n_chunks
    assert {r.path: r.first_vector_id for r in got} == expected


def test_states_of_files(spark):
    """The tolerance is strict; what cannot be examined is left alone."""
    scan = [("new", 1.0), ("same", 5.0), ("close", 5.0009), ("far", 5.0011), ("back", 4.0),
            ("unseen", None), ("unseen new", None)]
    known = [(p, 5.0) for p in ("same", "close", "far", "back", "unseen", "gone")]
    rows = [spark.createDataFrame(r, "path string, mtime double") for r in (scan, known)]
    states = {r.path: (r.state, r.known) for r in changes.compare_scan(*rows).collect()}
    assert states == {
        "new": ("new", False), "same": ("same", True), "close": ("same", True),
        "far": ("updated", True), "back": ("updated", True), "unseen": ("same", True),
        "unseen new": ("same", False), "gone": ("deleted", True),
    }
    forced = {r.path: r.state for r in changes.compare_scan(*rows, force=True).collect()}
    assert forced["same"] == "updated" and forced["unseen"] == "same" and forced["gone"] == "deleted"


def test_upsert(spark):
    schema = "path string, mtime double, language string, file_version bigint"
    old = spark.createDataFrame([("a", 1.0, "x", 1), ("b", 1.0, None, 1)], schema)
    new = spark.createDataFrame([("b", 2.0, "y"), ("c", 3.0, None)], "path string, mtime double, language string")
    got = {r.path: tuple(r)[1:] for r in changes.upsert(old, new).collect()}
    assert got == {"a": (1.0, "x", 1), "b": (2.0, "y", 1), "c": (3.0, None, None)}
