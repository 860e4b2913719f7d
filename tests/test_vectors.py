from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from seamline.functions.embedding import embed_documents, embed_queries, hashing_model
from seamline.functions.vectors import inner_product, l2_normalise
from seamline.operators import probe
from seamline.operators.intervals import Dead, Intervals, merged, without
from seamline.operators.probe import assign_lists, top_k_probe, train_centroids
from seamline.operators.topk import Best, top_k, top_k_single, top_k_without
from seamline.operators.vectors import add_vectors, cut_vectors, delete_vectors
from seamline.work import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
DIM = 8


def table(spark, matrix, key="vector_id", partitions=4):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>").repartition(partitions)


def unit(matrix):
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1
    return (matrix / norms).astype(np.float32)


def brute_force(queries, vectors, k, usable=None):
    expected = {}
    for q, query in enumerate(queries.astype(np.float64)):
        scores = np.rint(vectors.astype(np.float64) @ query * 1e6)
        ids = [i for i in range(len(vectors)) if usable is None or usable(q, i)]
        expected[q] = sorted(ids, key=lambda i: (-scores[i], i))[:k]
    return expected


def ranked(hits):
    result = {}
    for r in hits.orderBy("query_id", "rank").collect():
        ids = result.setdefault(r.query_id, [])
        ids.append(r.vector_id)
        assert r["rank"] == len(ids)
    return result


@pytest.fixture(scope="module")
def data():
    """A third of the vectors are copies of one, another part copies in pairs."""
    rng = np.random.default_rng(5)
    vectors = unit(rng.standard_normal((600, DIM)))
    vectors[::3] = vectors[0]
    vectors[1:200:3] = vectors[301:500:3]
    queries = np.vstack([unit(rng.standard_normal((38, DIM))), vectors[:1], np.zeros((1, DIM), np.float32)])
    return queries.astype(np.float32), vectors


@pytest.mark.parametrize("k", [1, 7, 250, 1000])
def test_vectors_stream_past_queries(spark, data, k):
    queries, vectors = data
    hits = top_k(table(spark, queries, "query_id"), table(spark, vectors), k, DIM)
    assert ranked(hits) == brute_force(queries, vectors, k)


def test_queries_stream_past_vectors(spark, data):
    queries, vectors = data
    hits = top_k(table(spark, vectors, "query_id"), table(spark, queries), 7, DIM, block_rows=100)
    assert ranked(hits) == brute_force(vectors, queries, 7)
    assert "Window" not in hits._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_queries(spark, data):
    queries, vectors = data
    hits = top_k(table(spark, queries, "query_id"), table(spark, vectors), 7, DIM, block_rows=15)
    assert ranked(hits) == brute_force(queries, vectors, 7)


def test_crowd_of_copies():
    """Half of all rows are one vector, the best for every query."""
    rng = np.random.default_rng(3)
    rows = unit(rng.standard_normal((4000, DIM)))
    rows[rng.permutation(4000)[:2000]] = rows[0]
    queries = unit(rows[:1] + 0.1 * rng.standard_normal((300, DIM)))
    ids = rng.permutation(4000)
    best = Best(len(queries), 6)
    for part in np.array_split(np.arange(4000), 3):
        best.add(queries, rows[part], ids[part])
    by_id = np.empty_like(rows)
    by_id[ids] = rows
    expected = brute_force(queries, by_id, 6)
    got = best.batch(pa.array(range(len(queries)))).to_pydict()
    assert got["vector_id"] == [i for q in range(len(queries)) for i in expected[q]]
    assert got["rank"] == list(range(1, 7)) * len(queries)


def test_single_query_equals_many(spark, data):
    queries, vectors = data
    hits = top_k_single(table(spark, vectors), queries[3].tolist(), 9).orderBy("rank").collect()
    assert [r.vector_id for r in hits] == brute_force(queries, vectors, 9)[3]


def test_nothing_to_find(spark, data):
    queries, vectors = data
    q, v = table(spark, queries, "query_id"), table(spark, vectors)
    assert top_k(q, v, 0, DIM).isEmpty()
    assert top_k(q, v.limit(0), 5, DIM).isEmpty()
    assert top_k(q.limit(0), v, 5, DIM).isEmpty()
    with pytest.raises(ValueError):
        top_k(q, v, -1, DIM)


def test_text_query_ids(spark, data):
    queries, vectors = data
    named = table(spark, queries, "query_id").withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    hits = ranked(top_k(named, table(spark, vectors), 3, DIM))
    assert hits == {f"q{q}": ids for q, ids in brute_force(queries, vectors, 3).items()}


def test_blocks_are_a_grid_in_one_plan(spark, data):
    """Any number of query blocks is one plan without a broadcast of queries, and gives the same rows."""
    queries, vectors = data
    hits = top_k(table(spark, queries, "query_id"), table(spark, vectors), 7, DIM, block_rows=3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") == 1 and "Broadcast" not in plan
    assert ranked(hits) == brute_force(queries, vectors, 7)


def test_rows_of_bytes_come_one_by_one(spark, monkeypatch):
    """A cell of the grid holds one chunk at a time: long rows do not share a batch."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    long_rows = spark.range(6).select(F.expr("cast(repeat('x', 40000000) as binary)").alias("data")).coalesce(1)
    assert max(r.n for r in long_rows.mapInArrow(sizes, "n bigint").collect()) <= 2


def as_dead(spark, ids):
    return spark.createDataFrame([(i, i) for i in ids], "first_id bigint, last_id bigint").repartition(3)


@pytest.mark.parametrize("at_once", [10_000, 20])
@pytest.mark.parametrize("block_rows", [8192, 9])
def test_dead_vectors(spark, data, at_once, block_rows):
    """The hot copies are dead but for a few; slices of the intervals share out the vectors."""
    queries, vectors = data
    gone = {i for i in range(len(vectors)) if i % 3 == 0 and i < 590}
    dead = Dead(as_dead(spark, gone), at_once)
    assert dead.n == len(gone) and (len(dead.bounds) > 0) == (at_once == 20)
    hits = top_k(table(spark, queries, "query_id"), table(spark, vectors), 5, DIM, block_rows=block_rows, dead=dead)
    assert ranked(hits) == brute_force(queries, vectors, 5, lambda q, i: i not in gone)
    kept = without(table(spark, vectors), dead)
    assert sorted(r.vector_id for r in kept.collect()) == [i for i in range(len(vectors)) if i not in gone]


@pytest.mark.parametrize("at_once", [1, 60])
@pytest.mark.parametrize("block_rows", [8192, 9])
def test_many_slices_of_dead_ids_are_one_branch(spark, data, at_once, block_rows):
    """The plan does not grow with the intervals, also where they are long, overlap or reach over bounds."""
    queries, vectors = data
    spans = [(i, i) for i in range(0, 300, 2)] + [(303, 480), (470, 555), (-9, -1), (598, 900)]
    gone = {i for a, b in spans for i in range(a, b + 1)}
    dead = Dead(spark.createDataFrame(spans, "first_id bigint, last_id bigint").repartition(3), at_once)
    stored = written(table(spark, vectors))
    hits = top_k(table(spark, queries, "query_id"), stored, 5, DIM, block_rows=block_rows, dead=dead)
    assert ranked(hits) == brute_force(queries, vectors, 5, lambda q, i: i not in gone)
    kept = without(stored.unionAll(stored.where("vector_id in (4, 301)")), dead)
    assert kept.columns == stored.columns
    assert sorted(r.vector_id for r in kept.collect()) == sorted([i for i in range(len(vectors)) if i not in gone] + [301])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 8 and (plan.count("MapInArrow") == 1) == (at_once == 1)
    assert without(stored.limit(0), dead).isEmpty()


def test_most_vectors_dead_take_one_scan(spark, data):
    """Each vector is read once, whatever share is dead; slices read their own range of ids."""
    queries, vectors = data
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    stored = written(table(spark, vectors))
    alive = {5, 17, 300, 301, 599}
    gone = as_dead(spark, [i for i in range(len(vectors)) if i not in alive])
    watched = stored.mapInArrow(counted, "vector_id bigint, embedding array<float>")
    hits = top_k_without(table(spark, queries, "query_id"), watched, gone, 7, DIM)
    assert ranked(hits) == brute_force(queries, vectors, 7, lambda q, i: i in alive)
    assert read.value == len(vectors)
    sliced = Dead(gone, 2)
    assert 1 < len(sliced.bounds) + 1 <= sliced.n
    parts = sliced.parts(stored)
    assert sum(rows.count() for rows, _ in parts) == len(vectors)
    assert all("vector_id," in rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1] for rows, _ in parts)
    hits = top_k_without(table(spark, queries, "query_id"), stored, gone, 7, DIM, 2)
    assert ranked(hits) == brute_force(queries, vectors, 7, lambda q, i: i in alive)


def test_intervals(spark):
    """Touching and overlapping intervals become one; the union is kept."""
    rng = np.random.default_rng(2)
    rows = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 3000, 300), rng.integers(0, 9, 300))] + [(5, 5), (6, 6), (7, 9)]
    ids = {i for a, b in rows for i in range(a, b + 1)}
    table_ = spark.createDataFrame(rows, "first_id bigint, last_id bigint").repartition(4)
    found = [tuple(r) for r in merged(table_).collect()]
    assert {i for a, b in found for i in range(a, b + 1)} == ids and len(found) < len(rows)
    own = sorted(found)
    held = Intervals(np.array([a for a, _ in own]), np.array([b for _, b in own])).hold(np.arange(-3, 3100))
    assert held.tolist() == [i in ids for i in range(-3, 3100)]
    none = Intervals(np.empty(0, np.int64), np.empty(0, np.int64))
    assert not none.hold(np.arange(3)).any() and merged(table_.limit(0)).count() == 0


def test_all_vectors_dead(spark, data):
    queries, vectors = data
    q = table(spark, queries, "query_id")
    everything = spark.createDataFrame([(0, len(vectors))], "first_id bigint, last_id bigint")
    assert top_k_without(q, table(spark, vectors), everything, 5, DIM).isEmpty()


def test_wrong_length_ends_the_job(spark, data):
    queries, vectors = data
    with pytest.raises(Exception, match="components"):
        top_k(table(spark, queries, "query_id"), table(spark, vectors[:, :4]), 3, DIM).collect()


def test_probe(spark, data):
    queries, vectors = data
    centers = unit(np.random.default_rng(9).standard_normal((6, DIM)))
    centroids = written(table(spark, centers, "list_id"))
    listed = assign_lists(table(spark, vectors), centroids, DIM)
    lists = {r.vector_id: r.list_id for r in listed.collect()}
    nearest = brute_force(vectors, centers, 1)
    assert lists == {i: ids[0] for i, ids in nearest.items()}
    probed = brute_force(queries, centers, 2)
    hits = top_k_probe(table(spark, queries, "query_id"), listed, centroids, 5, 2, DIM)
    expected = brute_force(queries, vectors, 5, lambda q, i: lists[i] in probed[q])
    assert ranked(hits) == {q: ids for q, ids in expected.items() if ids}
    every = top_k_probe(table(spark, queries, "query_id"), listed, centroids, 5, 6, DIM)
    assert ranked(every) == brute_force(queries, vectors, 5)


def test_centroids_in_many_blocks(spark, data):
    """Centroids beyond one block give the same lists, ties to the lower id."""
    _, vectors = data
    centers = unit(np.random.default_rng(4).standard_normal((40, DIM)))
    centers[17] = centers[3]
    centroids = written(table(spark, centers, "list_id"))
    want = {i: ids[0] for i, ids in brute_force(vectors, centers, 1).items()}
    for block_bytes in (1 << 20, 4 * DIM * 9):
        listed = assign_lists(table(spark, vectors), centroids, DIM, block_bytes)
        assert listed.columns == ["vector_id", "embedding", "list_id"]
        assert {r.vector_id: r.list_id for r in listed.collect()} == want
    with pytest.raises(ValueError, match="no centroids"):
        assign_lists(table(spark, vectors), centroids.limit(0), DIM)


@pytest.mark.parametrize("named", [1000, 0])
@pytest.mark.parametrize("block_rows", [8192, 6])
def test_probe_of_partitioned_lists(spark, data, tmp_path, monkeypatch, named, block_rows):
    """Folders of lists that no query probes are not read, by a filter or by pruning at run time."""
    queries, vectors = data
    monkeypatch.setattr(probe, "_NAMED_LISTS", named)
    centers = unit(np.random.default_rng(9).standard_normal((12, DIM)))
    centroids = written(table(spark, centers, "list_id"))
    assign_lists(table(spark, vectors), centroids, DIM).write.partitionBy("list_id").parquet(str(tmp_path / "listed"))
    listed = spark.read.schema("vector_id bigint, embedding array<float>, list_id bigint").parquet(str(tmp_path / "listed"))
    lists = {r.vector_id: r.list_id for r in listed.collect()}
    few = queries[:10]
    probed = brute_force(few, centers, 2)
    gone = set(range(0, 600, 7))
    hits = top_k_probe(table(spark, few, "query_id"), listed, centroids, 5, 2, DIM, block_rows, Dead(as_dead(spark, gone)))
    expected = brute_force(few, vectors, 5, lambda q, i: lists[i] in probed[q] and i not in gone)
    assert ranked(hits) == {q: ids for q, ids in expected.items() if ids}
    plan = probe.probed_lists(listed, written(spark.createDataFrame([(3,), (5,)], "list_id bigint")))._jdf.queryExecution().executedPlan().toString()
    part = plan.split("PartitionFilters: ")[1].split("\n")[0]
    assert "list_id" in part and ("dynamicpruning" in part.lower()) == (named == 0)


def test_trained_centroids(spark, data):
    _, vectors = data
    centers = train_centroids(table(spark, vectors), 4)
    assert centers.count() == 4
    assert {round(sum(x * x for x in r.embedding), 4) for r in centers.collect()} == {1.0}


def test_normalise_and_product(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = rows.select(l2_normalise(F.col("a")).alias("n"), inner_product(F.col("a"), F.col("b")).alias("p")).collect()
    assert got[0].n == pytest.approx([0.6, 0.8]) and got[0].p == 3.0
    assert got[1].n == [0.0, 0.0] and got[1].p == 0.0


def test_cut_needs_an_allowed_dim(spark, data):
    _, vectors = data
    cut = cut_vectors(table(spark, vectors), 4, (8, 4)).orderBy("vector_id").collect()
    assert np.allclose([r.embedding for r in cut], unit(vectors[:, :4]), atol=1e-6)
    with pytest.raises(ValueError):
        cut_vectors(table(spark, vectors), 5, (8, 4))


def test_add_and_delete(spark, data):
    _, vectors = data
    stored = table(spark, vectors[:3])
    new = table(spark, vectors[3:5] * 5).withColumn("vector_id", F.col("vector_id") + 3)
    both = add_vectors(stored, new, DIM)
    rows = both.orderBy("vector_id").collect()
    assert np.allclose([r.embedding for r in rows], vectors[:5], atol=1e-6)
    ids = spark.createDataFrame([(1,), (4,), (99,)], "vector_id bigint")
    assert sorted(r.vector_id for r in delete_vectors(both, ids).collect()) == [0, 2, 3]
    with pytest.raises(Exception, match="vector length must be 7"):
        add_vectors(stored, new, 7).collect()
    with pytest.raises(Exception, match="no id"):
        add_vectors(stored, new.withColumn("vector_id", F.lit(None).cast("bigint")), DIM).collect()


def lengths_model():
    def embed(texts):
        return np.array([[len(t), 1.0, 0.0] if "zero" not in t else [0.0] * 3 for t in texts])

    return embed


def test_any_model(spark):
    texts = spark.createDataFrame([("ab",), ("zero",), ("abcd",)], "t string")
    rows = texts.select("t", embed_documents(F.col("t"), lengths_model, 2, batch_size=2).alias("v")).collect()
    for r in rows:
        n = len("title: none | text: " + r.t)
        assert r.v == pytest.approx([0, 0] if r.t == "zero" else [n / np.hypot(n, 1), 1 / np.hypot(n, 1)])
    query = texts.select(embed_queries(F.col("t"), lengths_model, 1).alias("v")).first()
    assert query.v == [1.0]
    assert texts.limit(0).select(embed_documents(F.col("t"), lengths_model, 2)).collect() == []
    with pytest.raises(Exception, match="3 components, 4"):
        texts.select(embed_documents(F.col("t"), lengths_model, 4)).collect()
    with pytest.raises(ValueError):
        embed_documents(F.col("t"), lengths_model, 2, batch_size=0)


def counting_model():
    """Fails unless it is called with at most two texts, whatever the Arrow batch."""

    def embed(texts):
        assert 1 <= len(texts) <= 2
        return np.ones((len(texts), 1))

    return embed


def test_batch_size(spark):
    texts = spark.range(11).select(F.col("id").cast("string").alias("t")).coalesce(1)
    rows = texts.select(embed_documents(F.col("t"), counting_model, 1, batch_size=2).alias("v")).collect()
    assert [r.v for r in rows] == [[1.0]] * 11


@pytest.mark.parametrize("limit", [None, 4])
def test_hashing_model(limit):
    dim, text = 16, "One two_2, two_2 Ünï three; one é 4"
    expected = np.zeros(dim)
    for word in re.findall("[a-z0-9_]+", text.lower())[:limit]:
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        expected[h % dim] += -1 if h // dim % 2 else 1
    got = hashing_model(dim, limit)()([text, "", text])
    assert np.array_equal(got, [expected, np.zeros(dim), expected])
