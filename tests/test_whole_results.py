"""Results are whole or the job ends: bad vectors, repeated ids, errors of folders, commits during a search."""

from __future__ import annotations

import functools
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions.embedding import embed_documents, hashing_model, model_name
from seamline.operators import topk
from seamline.operators.changes import live_chunks
from seamline.operators.grid import search_all
from seamline.operators.hits import attach_content
from seamline.operators.topk import top_k, top_k_single
from seamline.operators.vectors import add_vectors
from seamline.params import IndexParams
from seamline.operators.ids import assign_vector_ids, in_id_order
from seamline.plans import index_job, search_job
from seamline.plans.compact_job import compact_index, drop_old_parts
from seamline.plans.index_job import index_files
from seamline.plans.search_job import search_chunks, search_index
from seamline.plans.stats_job import index_stats
from seamline.sources import store as store_module, tree
from seamline.sources.log import Conflict, Files, Log, State
from seamline.sources.store import IndexStore
from seamline.sources.table import TableSource
from seamline.sources.tree import TreeSource
from seamline.work import written

PARAMS = IndexParams(embedding_dim=128, chunk_size_lines=3, chunk_overlap_lines=1)
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, name="vector_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} bigint, embedding array<float>")


def texts(n, word="text"):
    return [(f"f{i}.py", 1.0, "".join(f"{word} {i} line {j}\n" for j in range(5))) for i in range(n)]


def indexed(spark, path, rows, **options):
    store = IndexStore(spark, str(path)).create(PARAMS)
    source = TableSource(spark.createDataFrame(rows, "path string, mtime double, text string"))
    index_files(store, source, **options)
    return store, source


@pytest.mark.parametrize("bad", [NAN, INF, -INF])
def test_vectors_that_are_not_finite_end_the_job(spark, bad):
    good = [(i, [1.0, i / 10]) for i in range(10)]
    mixed = vectors(spark, good + [(100 + i, [bad, 1.0]) for i in range(3)])
    query = vectors(spark, [(1, [1.0, 0.0])], "query_id")
    for run in (
        lambda: top_k(query, mixed, 2, 2).collect(),
        lambda: top_k(vectors(spark, [(1, [bad, 0.0])], "query_id"), vectors(spark, good), 2, 2).collect(),
        lambda: top_k_single(mixed, [1.0, 0.0], 2).collect(),
        lambda: top_k_single(vectors(spark, good), [bad, 0.0], 2).collect(),
        lambda: add_vectors(vectors(spark, good), vectors(spark, [(7, [bad, 1.0])]), 2).collect(),
    ):
        with pytest.raises(Exception, match="finite"):
            run()
    docs = spark.createDataFrame([("a",)], "text string")
    broken = lambda: lambda batch: np.full((len(batch), 2), bad)
    with pytest.raises(Exception, match="finite"):
        docs.select(embed_documents(F.col("text"), broken, 2)).collect()


def test_missing_components_end_the_job(spark):
    rows = spark.createDataFrame([(1, [1.0, None]), (2, None)], "vector_id bigint, embedding array<float>")
    for i in (1, 2):
        with pytest.raises(Exception, match="finite|length"):
            add_vectors(rows.limit(0), rows.where(f"vector_id = {i}"), 2).collect()


def test_query_ids_that_repeat_end_the_job(spark):
    stored = vectors(spark, [(i, [1.0, i / 10]) for i in range(10)])
    twice = vectors(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id")
    with pytest.raises(ValueError, match="unique"):
        top_k(twice, stored, 2, 2)
    with pytest.raises(ValueError, match="unique"):
        top_k(twice.select(F.lit(None).cast("bigint").alias("query_id"), "embedding").limit(1), stored, 2, 2)


def test_folder_errors_end_the_run(spark, tmp_path, monkeypatch):
    """A folder or file that cannot be read is no deletion; one that is gone is."""
    calls = []

    def failing():
        calls.append(1)
        raise PermissionError("no")

    monkeypatch.setattr(tree.time, "sleep", lambda s: None)
    with pytest.raises(PermissionError):
        tree._tried(failing)
    assert len(calls) == tree._TRIES
    assert tree._tried(lambda: os.stat(tmp_path / "none")) is None
    flaky = iter([OSError("moment"), "there"])

    def second_time():
        value = next(flaky)
        if isinstance(value, Exception):
            raise value
        return value

    assert tree._tried(second_time) == "there"
    # A name that the file system refuses is an error, not a missing file.
    (tmp_path / "a.py").write_text("x\n")
    source = TreeSource(spark, str(tmp_path))
    too_long = spark.createDataFrame([("a.py",), ("gone.py",)], "path string")
    assert {r.path: r.text for r in source.read(too_long).collect()} == {"a.py": "x\n", "gone.py": None}
    with pytest.raises(Exception, match="too long"):
        source.read(spark.createDataFrame([("n" * 300 + ".py",)], "path string")).collect()


def test_a_commit_during_a_search_changes_nothing(spark, tmp_path, monkeypatch):
    store, source = indexed(spark, tmp_path / "index", texts(6))
    queries = spark.createDataFrame([(1, "text 3 line")], "query_id int, query string")
    want = sorted(map(tuple, search_index(store, queries, 5).collect()))
    plain = search_job.top_k

    def with_commit(*arguments, **options):
        hits = plain(*arguments, **options)
        index_files(store, source, force=True)
        return hits

    monkeypatch.setattr(search_job, "top_k", with_commit)
    assert sorted(map(tuple, search_index(store, queries, 5).collect())) == want and len(want) == 5
    first = store.at(1)
    assert first.files().agg(F.max("file_version")).first()[0] == 1
    assert store.files().agg(F.max("file_version")).first()[0] == 2
    assert index_stats(store).first().chunk_count == index_stats(first).first().chunk_count


def test_each_text_is_embedded_once(spark, tmp_path, monkeypatch):
    """50 queries in blocks of 10 against 100 chunks: 150 texts go through the model."""
    seen = str(tmp_path / "seen")
    os.mkdir(seen)

    def counting():
        model = hashing_model(32)()

        def embed(batch):
            with open(os.path.join(seen, f"{os.getpid()}-{time.monotonic_ns()}"), "w") as file:
                file.write(str(len(batch)))
            return model(batch)

        return embed

    monkeypatch.setattr(search_job, "top_k", functools.partial(topk.top_k, block_rows=10))
    chunks = spark.range(100).selectExpr(
        "id as vector_id", "concat('word ', id) as text", "concat('p', id) as path", "1L as file_version",
        "cast(1 as int) as start_line", "cast(1 as int) as end_line", "cast(0 as int) as chunk_no",
    )
    files = chunks.selectExpr("path", "file_version", "'x' as language")
    queries = spark.range(50).selectExpr("id as query_id", "concat('word ', id) as query")
    assert search_chunks(queries, chunks, files, 32, 3, counting).count() == 150
    assert sum(int(open(os.path.join(seen, name)).read()) for name in os.listdir(seen)) == 150


def test_the_model_belongs_to_the_index(spark, tmp_path):
    def load():
        return lambda batch: np.ones((len(batch), 128)) * np.array([[len(t) for t in batch]]).T

    load.model_name = "lengths"
    store, source = indexed(spark, tmp_path / "index", texts(3), load_model=load)
    queries = spark.createDataFrame([(1, "x")], "query_id int, query string")
    with pytest.raises(ValueError, match="lengths"):
        search_index(store, queries)
    with pytest.raises(ValueError, match="lengths"):
        index_files(store, source, force=True)
    assert search_index(store, queries, 2, load_model=load).count() == 2
    assert index_stats(store).first().model_name == "lengths"
    assert model_name(hashing_model(8)) != model_name(hashing_model(16))


@pytest.mark.parametrize("most, least", [(1000, 4096), (1000, 1), (5, 1), (3, 1), (0, 1)])
def test_hits_read_their_blocks_alone(spark, tmp_path, monkeypatch, most, least):
    monkeypatch.setattr(store_module, "ID_BLOCK", 4)
    monkeypatch.setattr(store_module, "_MOST_RANGES", most)
    monkeypatch.setattr(store_module, "_LEAST_RANGE", least)
    store, _ = indexed(spark, tmp_path / "index", texts(9))
    wanted = "vector_id % 16 in (1, 2, 9)"
    want = sorted(map(tuple, store.chunks().where(wanted).collect()))
    ids = written(store.chunks().select("vector_id").where(wanted))
    # A block without a hit cannot be read any more; a search that opens it fails.
    hit = {r.vector_id // 4 for r in ids.collect()}
    unread = [f for f in (tmp_path / "index" / "chunks").rglob("*.parquet") if int(f.parent.name.split("=")[1]) not in hit]
    for file in unread:
        file.write_bytes(b"no parquet" * (file.stat().st_size // 10))
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    found = store.chunks_of(ids)
    assert found.columns == store.chunks().columns and want and unread
    assert sorted(map(tuple, found.where(wanted).collect())) == want
    plan = found._jdf.queryExecution().toString()
    assert ("dynamicpruning" in plan) == (most < 5)
    if most >= 5:
        assert "GreaterThanOrEqual(vector_id" in plan.split("PushedFilters")[1]


def test_ranges_of_hits_widen_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(store_module, "ID_BLOCK", 1 << 10)
    monkeypatch.setattr(store_module, "_LEAST_RANGE", 1 << 4)
    monkeypatch.setattr(store_module, "_MOST_RANGES", 20)
    few = store_module._few_ranges(spark.createDataFrame([(3,), (5,), (700,), (2000,)], "vector_id bigint"))
    assert few == [(3, 5), (700, 700), (2000, 2000)]
    many = store_module._few_ranges(spark.range(0, 4096, 7).withColumnRenamed("id", "vector_id"))
    assert len(many) <= 22 and all(low // 1024 == high // 1024 for low, high in many)
    assert {i for low, high in many for i in range(low, high + 1)} >= set(range(0, 4096, 7))
    assert store_module._few_ranges(spark.range(0, 1 << 16, 100).withColumnRenamed("id", "vector_id")) is None
    assert store_module._few_ranges(spark.range(0).withColumnRenamed("id", "vector_id")) == []


def test_a_thousand_ranges_of_hits(spark, monkeypatch):
    """Many more ranges than a search asks for are planned: their conditions are no chain."""
    monkeypatch.setattr(store_module, "ID_BLOCK", 1 << 18)
    ranges = [(low, low + 46) for low in range(0, 1 << 20, 1 << 10)]
    rows = spark.range(0, 1 << 20, 5).selectExpr("id as vector_id", f"id div {1 << 18} as id_block")
    found = written(rows).where(store_module._in_ranges(ranges))
    assert sorted(r.vector_id for r in found.collect()) == [i for low, high in ranges for i in range(low, high + 1) if i % 5 == 0]


def test_content_of_many_ranges_in_linear_time(spark):
    n = 24_000
    found = spark.range(0, n - 8, 6).selectExpr("'f' as path", "cast(id + 1 as int) as start_line", "cast(id + 8 as int) as end_line")
    text = "\n".join(f"line {i}" for i in range(1, n + 1))
    source = spark.createDataFrame([("f", text)], "path string, text string")
    started = time.time()
    rows = {r.start_line: r.content for r in attach_content(found, source).collect()}
    assert time.time() - started < 8
    assert len(rows) == found.count() and rows[7] == "".join(f"line {i}\n" for i in range(7, 15))


def test_many_splits_shuffle_few_rows(spark):
    """A scan of many splits hands on k rows per query for each of a bounded number of tasks."""
    rng = np.random.default_rng(0)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(400, 4)).tolist())]
    many = vectors(spark, rows).repartition(100)
    hits = top_k(vectors(spark, rows[:3], "query_id"), many, 5, 4)
    queries = vectors(spark, rows[:3], "query_id")
    tasks = topk.scan_tasks(many)
    scan = search_all(queries, [(many, None)], 8, tasks, lambda block: topk.Scan(block, 5, 4), topk.hits_schema(queries))
    assert scan.rdd.getNumPartitions() <= tasks == 4 * spark.sparkContext.defaultParallelism
    assert scan.count() <= 3 * 5 * tasks
    best = {r.query_id: r.vector_id for r in hits.where("rank = 1").collect()}
    matrix = np.array([v for _, v in rows], np.float32)
    assert best == {q: int(np.argmax(matrix @ matrix[q])) for q in range(3)}


def test_compaction(spark, tmp_path):
    """Same results from one part; nothing is dead; old folders go only when asked."""
    store, source = indexed(spark, tmp_path / "index", texts(6))
    index_files(store, source, force=True)
    queries = spark.createDataFrame([(1, "text 3 line")], "query_id int, query string")
    want = sorted(map(tuple, search_index(store, queries, 6).collect()))
    older = store.at()
    assert compact_index(store) == 3
    assert sorted(map(tuple, search_index(store, queries, 6).collect())) == want and len(want) == 6
    assert store.n_dead() == 0 and store.dead().count() == 0
    assert store.vectors().count() == store.chunks().count() == index_stats(store).first().chunk_count
    assert sorted(map(tuple, search_index(older, queries, 6).collect())) == want
    gone = drop_old_parts(store)
    assert "chunks/file_version=1" in gone and not any(name.endswith("=3") for name in gone)
    assert sorted(map(tuple, search_index(store, queries, 6).collect())) == want
    # The next run goes on from the compacted state.
    assert index_files(store, source, force=True).first().updated_files == 6
    assert store.live_vectors().count() == index_stats(store).first().chunk_count


def test_a_run_number_is_claimed_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    assert [store.log.new_run(store.state()) for _ in range(3)] == [1, 2, 3]


def paused(monkeypatch, store, meanwhile):
    """Runs `meanwhile` inside the next index run, when it has written its vectors."""
    plain, once = IndexStore.write_vectors, []

    def write(self, *arguments):
        plain(self, *arguments)
        if not once:
            once.append(1)
            meanwhile()

    monkeypatch.setattr(IndexStore, "write_vectors", write)


def state_of(store):
    files = sorted(map(tuple, store.files().collect()))
    chunks = sorted((r.path, r.chunk_no, r.text) for r in live_chunks(store.chunks(), store.files()).collect())
    return files, chunks, sorted(r.vector_id for r in store.live_vectors().collect())


@pytest.mark.parametrize("other", ["index", "compact"])
def test_of_two_writers_the_later_is_refused(spark, tmp_path, monkeypatch, other):
    """Nothing that was committed is lost, and nothing of the refused run is read."""
    store, source = indexed(spark, tmp_path / "index", texts(4))
    more = TableSource(spark.createDataFrame(texts(7), "path string, mtime double, text string"))
    seen = []

    def meanwhile():
        index_files(store, more) if other == "index" else compact_index(store)
        drop_old_parts(store)
        seen.append(state_of(store))

    paused(monkeypatch, store, meanwhile)
    with pytest.raises(Conflict, match="another writer"):
        index_files(store, source, force=True)
    assert state_of(store) == seen[0] and len(seen[0][0]) == (7 if other == "index" else 4)
    # The next run begins from what is there, with ids that neither has used.
    assert index_files(store, source, force=True).first().updated_files == 4
    assert len(state_of(store)[2]) == index_stats(store).first().chunk_count


def test_a_compaction_is_refused_after_an_index_run(spark, tmp_path, monkeypatch):
    store, source = indexed(spark, tmp_path / "index", texts(4))
    paused(monkeypatch, store, lambda: index_files(store, source, force=True))
    with pytest.raises(Conflict):
        compact_index(store)
    assert store.state().run_id == 3 and store.n_dead() == store.live_vectors().count() == 12


def test_reading_the_log_does_not_grow_with_runs(spark, tmp_path, monkeypatch):
    log = Log(spark, str(tmp_path / "index"))
    log.start(State())
    state = log.newest()
    for run in range(1, 25):
        state = log.commit(state, run)
    looked = []
    plain = Files.has
    monkeypatch.setattr(Files, "has", lambda self, name: looked.append(name) or plain(self, name))
    monkeypatch.setattr(Files, "names", lambda self: 1 / 0)
    assert log.newest() == state and len(looked) <= 5
    # A hint that lags behind, or is lost, only costs a look at more entries.
    monkeypatch.undo()
    log._log.write("newest", "11", replace=True)
    assert log.newest() == state
    log._log._system.delete(log._log._path("newest"), False)
    assert log.newest() == state and log.of_run(7).run_id == 7
    with pytest.raises(Conflict):
        log.commit(log.read(20), 99)


def test_a_claim_whose_writer_died(spark, tmp_path):
    store, source = indexed(spark, tmp_path / "index", texts(3))
    number = store.state().number
    assert store.log._log.claim(f"{number + 1:020d}.claim")
    with pytest.raises(Conflict):
        index_files(store, source, force=True)
    assert store.log.give_up(number + 1).run_id == 1
    with pytest.raises(ValueError):
        store.log.give_up(number + 1)
    assert index_files(store, source, force=True).first().updated_files == 3


def test_text_is_shuffled_once(spark, tmp_path, monkeypatch):
    """A first load reads its table once without an exchange; staged chunks meet one, into ranges of ids."""
    plans = []
    plain, staging = IndexStore.write_chunks, index_job.staged_chunks

    def write(self, chunks, run_id):
        plans.append(chunks._jdf.queryExecution().executedPlan().toString())
        plain(self, chunks, run_id)

    def stage(*arguments):
        chunks = staging(*arguments)
        plans.append(chunks._jdf.queryExecution().executedPlan().toString())
        return chunks

    monkeypatch.setattr(IndexStore, "write_chunks", write)
    monkeypatch.setattr(index_job, "staged_chunks", stage)
    indexed(spark, tmp_path / "index", texts(9))
    assert "Exchange" not in plans[0]
    assert plans[1].count("Exchange ") == 1 and "Join" not in plans[1]


def test_a_file_that_changes_is_indexed_as_read(spark, tmp_path, monkeypatch):
    """Between listing and reading, and after reading: the run ends well and the next one catches up."""
    root = tmp_path / "root"
    root.mkdir()
    for i in range(3):
        (root / f"f{i}.py").write_text("".join(f"old {i} {j}\n" for j in range(5)))
        os.utime(root / f"f{i}.py", (100.0, 100.0))
    store = IndexStore(spark, str(tmp_path / "index")).create(PARAMS)
    source = TreeSource(spark, str(root))
    plain = TreeSource.read_touched

    def longer(self, *arguments):
        (root / "f1.py").write_text("".join(f"new {j}\n" for j in range(11)))
        os.utime(root / "f1.py", (200.0, 200.0))
        (root / "f2.py").unlink()
        return plain(self, *arguments)

    monkeypatch.setattr(TreeSource, "read_touched", longer)
    assert index_files(store, source).first().new_files == 2
    monkeypatch.undo()
    rows = {r.path: r for r in store.files().collect()}
    assert rows["f1.py"].mtime == 100.0 and rows["f1.py"].n_chunks == 6 and "f2.py" not in rows
    assert index_files(store, source).first().updated_files == 1
    assert len(state_of(store)[2]) == index_stats(store).first().chunk_count == 3 + 6


@pytest.mark.parametrize("tasks", [1, 3, 7, 1000])
def test_ids_of_ranges(spark, tasks):
    """Ids are the places in path and chunk order, also where one file is most of the chunks."""
    sizes = {"a/b": 3, "a-b": 1, "a": 40, "b/0": 0, "b/1": 1, "b": 2, "z\u00e9": 5}
    files = spark.createDataFrame(list(sizes.items()), "path string, n_chunks int")
    chunks = spark.createDataFrame([(p, i, f"{p} {i}") for p, n in sizes.items() for i in range(n)], "path string, chunk_no int, text string")
    placed = written(assign_vector_ids(files, 100))
    found = in_id_order(chunks.repartition(5), placed, 100, sum(sizes.values()), tasks)
    order = [f"{p} {i}" for p in sorted(sizes, key=lambda p: p.split("/")) for i in range(sizes[p])]
    assert {r.text: r.vector_id for r in found.collect()} == {t: 100 + i for i, t in enumerate(order)}
    assert found.rdd.getNumPartitions() <= tasks


def test_lists_of_the_stored_index(spark, tmp_path):
    """Later runs keep the lists up; all lists give the exact result; few lists read few folders."""
    store, source = indexed(spark, tmp_path / "index", texts(30))
    queries = spark.createDataFrame([(i, f"text {i} line {i % 5}") for i in range(12)], "query_id int, query string")
    with pytest.raises(ValueError, match="no lists"):
        search_index(store, queries, 5, n_probe=1)
    compact_index(store, n_lists=6)
    changed = texts(30)[5:] + [(p, 2.0, t + "one more\n") for p, _, t in texts(5)] + texts(33, "late")[30:]
    index_files(store, TableSource(spark.createDataFrame(changed, "path string, mtime double, text string")))
    assert store.state().lists == 2 and store.n_dead() == 15
    listed = store.listed_vectors().where("file_version = 3").collect()
    assert listed and all(0 <= r.list_id < 6 for r in listed)
    rows = lambda **options: sorted(map(tuple, search_index(store, queries, 5, **options).collect()))
    exact = rows()
    assert rows(n_probe=6) == exact
    # Recall grows with the lists probed.
    recall = [len(set(r[:3] for r in rows(n_probe=n)) & set(r[:3] for r in exact)) / len(exact) for n in (1, 3, 6)]
    assert 0 < recall[0] <= recall[1] <= recall[2] == 1
    # A compaction keeps the lists, or drops them.
    compact_index(store)
    assert rows(n_probe=6) == exact and store.state().lists == 2
    drop_old_parts(store)
    assert rows(n_probe=6) == exact
    compact_index(store, n_lists=0)
    assert store.centroids() is None and rows() == exact
