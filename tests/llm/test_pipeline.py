"""The pipeline against a brute-force version of what each stage decides."""

from __future__ import annotations

import itertools
import random
import struct

import public_tokenizers
from test_operators import brute_components, brute_dedup, item_texts
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import sentence
from seamline.llm import quality_knn


def test_run(spark, tmp_path):
    rng = random.Random(12)
    items = item_texts(rng)[4:]
    passage = sentence(rng, 150)
    rows, marks = [], []
    for i in range(60):
        text = sentence(rng, rng.randint(60, 120))
        if i % 6 == 0:
            text = text.upper().replace(" ", "!! ")
        if i % 10 == 1:
            text += f" {passage} {sentence(rng, 50)}"
        if i in (7, 8):
            text += " " + items[i - 7]
        rows.append((i, text))
        if i < 50:
            marks.append((i, int(i % 6 != 0), 0))
    rows += [(60 + i, rows[i][1]) for i in (2, 3, 4)] + [(70, None), (71, ""), (2, rows[2][1])]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in quality_knn.quality_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    kept = [(i, t) for i, t in rows if scored[i]]
    assert not any(i % 6 == 0 for i, _ in kept if i < 50)
    component = brute_components(kept)
    kept = [(i, t) for i, t in dict(kept).items() if component[i] == i]
    assert not {62, 63, 64} & {i for i, _ in kept}
    removed = {r[0]: r[2] for r in brute_dedup(kept)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {i for i, _ in kept} - {7, 8}
    for i, text in kept:
        if i in found:
            if not removed[i]:
                assert found[i].text == (text or "")
            else:
                assert len(found[i].text.encode()) == len(text.encode()) - removed[i]
            ids = library.encode(found[i].text, add_special_tokens=False).ids
            assert found[i].ids == struct.pack(f"<{len(ids)}I", *ids) and found[i].n_tokens == len(ids)


def test_stages_keep_the_columns(messy, labels, spark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "q w e r t z")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = out
    assert 0 < docs.count() <= messy.count()


def test_near_copies_by_five_words(spark):
    """Spread changes that leave a 5-word Jaccard of 0.8 and a 4-word one under 0.85 are near copies; more are not."""
    rng = random.Random(21)
    rows = []
    for n, changes in ((95, 2), (95, 3), (140, 3), (140, 4), (470, 10), (470, 12)):
        words = sentence(rng, n).split()
        edited = [f"new{i}" if i % (n // changes) == n // changes // 2 else w for i, w in enumerate(words)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    gone = {j for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    component = brute_components(rows)
    assert gone == {1, 5, 9} and all(component[i] == i for i in (1, 9))
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {r.doc_id for r in kept.collect()} == set(sets) - gone


def test_passages_of_fifty_words(spark, tmp_path):
    """Passages of over 50 words that repeat are cut though they have under 400 bytes; shorter ones and all else stay.

    An item of the benchmark is such a passage too: documents that hold it go in the next stage.
    """
    rng = random.Random(31)
    passage, short = sentence(rng, 400).split(), sentence(rng, 40)
    passage = " ".join([w for w in passage if len(w) in (4, 6)][:56])
    assert 250 < len(passage) < 400 and 200 < len(short) < 400
    texts = [sentence(rng, 90) for _ in range(12)]
    planted = {1, 4, 9}
    own = lambda i: passage if i in planted else short if i in (2, 5) else None
    rows = [(i, f"{t[:80]}{i:X} {own(i)} {i:X}{t[80:]}" if own(i) else t, len(t)) for i, t in enumerate(texts)]
    rows += [(20, "字" * 140 + "1", 141), (21, "字" * 140 + "2", 141)]
    item = " ".join(sentence(rng, 400).split()[:56])
    rows += [(i, f"{sentence(rng, 40)} {i} {item} {i} {sentence(rng, 40)}", 0) for i in (30, 31)]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    cut = corpus_pipeline.without_repeats(spark, docs, str(tmp_path))
    found = {r.doc_id: r for r in cut.collect()}
    clean = corpus_pipeline.without_benchmark(spark, cut, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == set(found) - {30, 31}
    for i, text, n_chars in rows:
        if i in planted:
            assert found[i].text == f"{texts[i][:80]}{i:X}{i:X}{texts[i][80:]}" and found[i].n_chars == len(found[i].text)
        elif i in (20, 21):
            assert found[i].text == text[-1]
        else:
            assert (found[i].text, found[i].n_chars) == (text, n_chars)
