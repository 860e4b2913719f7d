"""Each operator against a brute-force version, on texts that are awkward in every way the docstrings name."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seamline.llm import bpe, components, decontamination, labelled, language_id, library_tokens, ngram_join
from seamline.llm import quality_knn, quality_rules, suffix_dedup, texts, token_counts, token_files, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="session")
def rows(messy):
    return [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# -- 1: n-gram join -------------------------------------------------------------


def shingles(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORDS.findall(lowered)
    k = min(4, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return {i: find(i) for i in root}


def test_components_of_similar_sets(messy, rows):
    found = ngram_join.jaccard_components(messy).collect()
    assert len(found) == len(rows)
    component = brute_components(rows)
    want = [(i, len(shingles(t)), component.get(i)) for i, t in rows]
    assert by_key((r.doc_id, r.n_shingles, r.component_id) for r in found) == by_key(want)


def test_chain_and_star_of_near_copies(spark):
    """A chain links its far ends; many copies of one text, each with an edit, are one component."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    chain = [" ".join(words[i : i + 100]) for i in range(0, 20, 2)]
    star = []
    for i in range(60):
        own = [f"v{k}" for k in range(90)]
        if i:
            own[i] = f"edit{i}"
        star.append(" ".join(own))
    rows = list(enumerate(chain + star))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert found == brute_components(rows)
    links, members = ngram_join.jaccard_links(docs)
    got = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert got == {(i, j) for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert members.count() == len(rows)


def test_pairs_of_torn_groups(spark, monkeypatch):
    """A group in two components loses no link to groups that carry its smallest member as component."""
    words = sorted((f"w{i}" for i in range(1000)), key=lambda w: int(ngram_join.document_sets(pa.array([w]), 1)[0][0]))
    front, body, one, seven, new = words[:16], words[100:174], words[200:210], words[300:310], words[400:403]
    sets = {
        1: front + body + one, 7: front + body + seven,
        5: front[1:] + words[20:21] + body + one[:6] + seven[:1] + new,
        3: front[:1] + front[2:] + words[21:22] + body + one[:2] + seven[:5] + new,
    }
    similar = {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if 100 * len({*sets[i]} & {*sets[j]}) >= 85 * len({*sets[i]} | {*sets[j]})}
    assert similar == {(1, 5), (3, 5), (3, 7)}
    monkeypatch.setattr(ngram_join.Join, "pivot_pairs", lambda self: spark.createDataFrame([(1, 5), (3, 5)], "a bigint, b bigint"))
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], "doc_id bigint, text string")
    join = ngram_join.Join(docs, ngram_join.Similarity(width=1))
    assert {(r.g, r.member) for r in join.grouped.collect()} == {(1, 1), (1, 7), (3, 3), (5, 5)}
    found = ngram_join.jaccard_components(docs, ngram_join.Similarity(width=1)).collect()
    assert {r.doc_id: r.component_id for r in found} == dict.fromkeys(sets, 1)


def test_bound_of_common_shingles():
    """Never below the true number, also where many shingles have one upper half, and no better than chance without need."""
    rng = random.Random(11)
    useful = 0
    for _ in range(3000):
        high = rng.choice([3, 12, 1 << 31])
        universe = [rng.randrange(high) << 32 | rng.randrange(1 << 32) for _ in range(rng.randint(3, 60))]
        often = set(rng.sample(universe, rng.randint(0, len(universe) // 2)))
        sets = [set(rng.sample(universe, rng.randint(1, len(universe)))) for _ in range(2)]
        prefixes, late = [], []
        for own in sets:
            ordered = sorted(own - often) + sorted(own & often)
            cut = ordered[: rng.randint(1, len(ordered))]
            prefixes.append(np.array([x >> 32 for x in cut], np.uint32))
            late.append(sum(x in often for x in cut))
        bound = ngram_join.most_common(*prefixes, *map(len, sets), *late)
        assert bound >= len(sets[0] & sets[1])
        useful += bound < min(map(len, sets))
    assert useful > 300


def test_frequent_shingles_change_nothing(messy, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "COUNTED", 50)
    component = brute_components(rows)
    found = ngram_join.jaccard_components(messy).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == component


def test_connected_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randrange(200, 260)) for _ in range(80)] + [(3, 3)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert all(found[i] == 100 for i in range(100, 161))
    assert all(found[b] == 7 for a, b in pairs if a == 7)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 2, 6, 9: tokens ------------------------------------------------------------


def test_encoding_equals_the_library(library):
    rng = random.Random(4)
    pairs, fast = bpe.BytePairs(bpe.read_tokenizer(PATH)), library_tokens.LibraryEncoder(bpe.read_tokenizer(PATH))
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "'s", "'", "don't", "12", "!", "é", "日本", " ", "<|endoftext|>", "\r\n", "\x1c", "ᲊ", "."]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    cases += ["a" * 5000, " " * 3000, "ab" * 3000] + [f"a{chr(c)} {chr(c)}1{chr(c)}" for c in (0x558, 0x10940, 0x208F, 0x378)]
    for text in cases:
        ids = ids_of(library, text)
        assert pairs.encode(text) == packed(ids), text
        assert pairs.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(fast.encode([text])[0], fast.kind).tolist() == ids, text


def test_full_memory_is_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    pairs = bpe.BytePairs(bpe.read_tokenizer(PATH))
    text = " ".join(f"word{i} other" for i in range(50))
    assert pairs.encode(text) == packed(ids_of(library, text)) and len(pairs.known) <= 3


def test_bpe_digests(messy, rows, library):
    want = []
    for i, text in rows:
        ids = ids_of(library, text)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = bpe.bpe_digests(messy, PATH).collect()
    assert by_key(map(tuple, found)) == by_key(want)


def test_unsupported_tokenizer_files():
    with pytest.raises(ValueError):
        bpe.BytePairs(bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


def test_token_files(messy, rows, library):
    manifest = token_files.write_token_files(messy, PATH, shards=3, length=16, rows=4)
    found = token_files.read_documents(manifest).orderBy("start").collect()
    known = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert known == sorted(known) and len(found) == len(rows)
    start = 0
    texts_of = {}
    for i, text in rows:
        ids = [*ids_of(library, text), 2]
        texts_of.setdefault(i, []).append((len(ids), zlib.crc32(packed(ids))))
    for r in found:
        assert r.start == start
        texts_of[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    for shard in manifest.collect():
        file = token_files.TokenFile(shard.tokens_file, shard.first_batch, shard.batch_bytes, rows=4)
        streamed = [row for batch in file.batches() for row in batch.column("ids").to_pylist()]
        assert [file.sequence(k)[0].tolist() for k in range(shard.n_sequences)] == streamed
        assert sum(int(file.sequence(k)[1].sum()) for k in range(shard.n_sequences)) == shard.n_tokens


def test_token_files_by_place(messy, spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files.TokenFile, "batches", None)  # nothing streams
    folder = str(tmp_path / "files")
    manifest = token_files.write_token_files(messy, PATH, folder=folder, shards=2, length=16, rows=4)
    assert token_files.read_documents(manifest).count() == messy.count()
    for shard in manifest.collect():
        assert shard.tokens_file.startswith("file:///")
        file = token_files.TokenFile(shard.tokens_file, shard.first_batch, shard.batch_bytes, shard.batch_rows)
        all_ids = np.concatenate([file.sequence(k)[0] for k in range(shard.n_sequences)])
        for start, n in ((0, 1), (15, 2), (63, 3), (64, 64), (5, 300), (shard.n_tokens - 1, 1), (0, shard.n_tokens)):
            assert np.concatenate(list(file.span(start, n))).tolist() == all_ids[start : start + n].tolist()
        assert list(file.span(7, 0)) == []
        with pytest.raises(ValueError):
            list(file.span(shard.n_tokens, 1) if shard.n_tokens % 64 else iter(file.span(0, shard.n_tokens + 1)))


def test_length_histogram(messy, rows, library, spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    lengths = np.array([len(ids_of(library, t)) for _, t in rows])
    histogram = token_counts.length_histogram(token_counts.token_lengths(messy, PATH))
    found = {r.n_tokens: r for r in histogram.collect()}
    assert sorted(found) == sorted(set(lengths.tolist()))
    for n, r in found.items():
        assert r.n_docs == (lengths == n).sum() and r.docs_within == (lengths <= n).sum()
        assert r.tokens_within == lengths[lengths <= n].sum() and r.docs_beyond == (lengths > n).sum()
        assert r.truncated_tokens == np.minimum(lengths, n).sum() and r.lost_tokens == lengths.sum() - r.truncated_tokens
        assert r.quantile == r.docs_within / len(lengths)
    limits = spark.createDataFrame([(0,), (7,), (10**6,)], "context bigint")
    for r in token_counts.at_limits(histogram, limits).collect():
        assert r.truncated_tokens == np.minimum(lengths, r.context).sum() and r.docs_within == (lengths <= r.context).sum()


# -- 3: suffix dedup ------------------------------------------------------------


def brute_dedup(rows, length=suffix_dedup.LENGTH):
    data = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats_are_removed(messy, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 5000)
    want = brute_dedup(rows)
    assert sum(r[2] > 0 for r in want) > 15
    assert by_key(map(tuple, suffix_dedup.dedup_digests(messy).collect())) == by_key(want)


def test_partial_overlaps(spark):
    """Documents that share pieces of all lengths around the limit, at odd places."""
    rng = random.Random(6)
    source = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = []
    for i in range(40):
        a = rng.randrange(0, 2300)
        piece = source[a : a + rng.choice([380, 399, 400, 401, 430, 650])]
        rows.append((i, "".join(rng.choice("ijkl ") for _ in range(rng.randrange(300))) + piece + "".join(rng.choice("mnop ") for _ in range(rng.randrange(300)))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_key(map(tuple, suffix_dedup.dedup_digests(docs).collect())) == by_key(brute_dedup(rows))


@pytest.mark.parametrize("hot", [2000, 2])
@pytest.mark.parametrize("length, key", [(64, 16), (200, 50), (200, 120), (400, 30)])
def test_repeats_of_other_lengths(spark, monkeypatch, length, key, hot):
    """Pieces around the length, circular texts, and one bucket of many different segments, by any rule of bytes."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(length + key)
    source = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    texts = []
    for i in range(30):
        a = rng.randrange(0, 1000)
        piece = source[a : a + length + rng.choice([-20, -1, 0, 1, 30, 2 * length])]
        texts.append("".join(rng.choice("ijkl ") for _ in range(rng.randrange(300))) + piece + "".join(rng.choice("mnop ") for _ in range(rng.randrange(300))))
    texts += ["left " + "é one two. " * 150 + "right", "y" * 900, None, "", source[:length], source[: length - 1]]
    rows = list(enumerate(texts)) + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    cut = suffix_dedup.remove_repeats(docs, rule=suffix_dedup.Passages(length, key)).drop("text")
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in cut.collect()]
    assert by_key(found) == by_key(brute_dedup(rows, length))


def test_a_segment_of_a_text_is_one_row(spark):
    """A text that goes round in a circle has a row for each place in the circle, not for each turn."""
    turn = "er.\nErwhre "
    docs = spark.createDataFrame([(i, turn * n) for i, n in enumerate((100, 1000, 4000))], "doc_id bigint, text string")
    keyed = suffix_dedup.keyed_texts(docs).select("doc_id", "text", "text_hash")
    runs = keyed.mapInArrow(partial(suffix_dedup.find_runs, rule=suffix_dedup.Passages()), suffix_dedup.RUNS).collect()
    for i, n in enumerate((100, 1000, 4000)):
        own = [r for r in runs if r.doc_id == i]
        assert len(own) < 3 * len(turn)
        starts = sorted(s + k for r in own for s in r.starts for k in range(r.n_starts))
        assert starts == list(range(n * len(turn) - suffix_dedup.LENGTH + 1))
    assert by_key(map(tuple, suffix_dedup.dedup_digests(docs).collect())) == by_key(brute_dedup([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize("period", [4, 7, 32, 64])
def test_difference_cover(period):
    cover = suffix_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) < period or period < 5


# -- 4: decontamination ---------------------------------------------------------


def item_texts(rng):
    return [" ".join(f"q{rng.randrange(400)}" for _ in range(n)) for n in (1, 2, 4, 8, 12, 15, 30, 59)]


def brute_edits(item, text):
    costs = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(costs[j] + (a != b), costs[j + 1] + 1, new[j] + 1))
        costs = new
    return min(costs)


def test_window_edits():
    rng = random.Random(1)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        edits, start = decontamination.window_edits(np.array(item, np.uint64), np.array(text, np.uint64))
        assert edits == brute_edits(item, text)
        assert brute_edits(item, text[start:]) == edits


def test_items_are_found(spark, messy):
    rng = random.Random(3)
    items = item_texts(rng)
    benchmark = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "?!"), (None, "x"), (3, items[3])], "item_id bigint, text string")
    texts_ = {100 + i: f"Lead in, here: {item.upper()}! And on." for i, item in enumerate(items)}
    docs = messy.select("doc_id", "text").unionAll(spark.createDataFrame(list(texts_.items()), "doc_id bigint, text string"))
    found = {(r.doc_id, r.item_id): r for r in decontamination.find_items(docs, benchmark).collect()}
    for i, item in enumerate(items):
        assert found[100 + i, i].edits == 0 and found[100 + i, i].first_word == 3
    for (doc_id, item_id), r in found.items():
        assert doc_id >= 100 and brute_edits(items[item_id].split(), re.findall(r"\w+", texts_[doc_id].lower())) == r.edits
    kept = decontamination.decontaminated(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in messy.select("doc_id").collect()}
    assert decontamination.find_items(docs, benchmark.limit(0)).count() == 0
    assert decontamination.decontaminated(messy, benchmark).columns == messy.columns


def test_blocks_of_items_agree(spark, monkeypatch):
    rng = random.Random(9)
    items = item_texts(rng)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(items)), "doc_id bigint, text string")
    whole = sorted(map(tuple, decontamination.find_items(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    assert sorted(map(tuple, decontamination.find_items(docs, benchmark).collect())) == whole


def test_recall_at_the_greatest_share():
    """Items with as many edits as allowed, at random places: at least 0.9 are found."""
    rng = random.Random(5)
    items = [" ".join(f"q{rng.randrange(4000)}" for _ in range(rng.randint(15, 59))) for _ in range(60)]
    block, hits, tries = decontamination.Items(list(range(60)), items), 0, 300
    for _ in range(tries):
        i = rng.randrange(60)
        words = items[i].split()
        for k in range(int(decontamination.EDIT_SHARE * len(words))):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [f"new{k}"] * rng.randint(0, 1) or ["other"]
        text = pa.array(["some words before " + " ".join(words) + " and some behind them"])
        want = brute_edits(items[i].split(), text[0].as_py().split()) <= int(decontamination.EDIT_SHARE * len(items[i].split()))
        found = any(item == i for _, item in block.matches(*decontamination.plain_words(text), decontamination.EDIT_SHARE))
        tries -= not want
        hits += found and want
    assert hits >= 0.9 * tries


@pytest.mark.parametrize("kind", ["swap", "drop", "add"])
def test_recall_at_each_length(kind):
    """Every item of 1 to 60 words is found with as many edits of one kind as allowed, wherever they are."""
    rng = random.Random(kind)
    for n in range(1, 61):
        words = [f"q{rng.randrange(4000)}" for _ in range(n)]
        block = decontamination.Items([0], [" ".join(words)])
        most, copies = int(decontamination.EDIT_SHARE * n), []
        for _ in range(40):
            own = list(words)
            for k, at in enumerate(sorted(rng.sample(range(n), most), reverse=True)):
                own[at : at + (kind != "add")] = [] if kind == "drop" else [f"new{k}"]
            copies.append("some before " + " ".join(own) + " and some behind")
        found = block.matches(*decontamination.plain_words(pa.array(copies)), decontamination.EDIT_SHARE)
        assert {text for text, _ in found} == set(range(40)), n


def hashes(text):
    """The hashes of the words of one text that stands between two others."""
    words, first = decontamination.plain_words(pa.array(["é a", text, "b日"]))
    return words[first[1] : first[2]].tolist()


def test_words_by_unicode_class():
    one = lambda word: decontamination.plain_words(pa.array([word]))[0].tolist()
    apart = lambda *words: [h for word in words for h in one(word)]
    assert hashes("Plain ASCII, 12 words_x") == apart("plain", "ascii", "12", "words", "x")
    assert hashes("“L’ÉTÉ” — DÉJÀ…") == apart("l", "été", "déjà") and hashes("STRASSE") == hashes("Straße")
    assert hashes("e\u0301te\u0301") == hashes("été") and hashes("co\u00adop zero\u200bwidth") == apart("coop", "zerowidth")
    assert hashes("日本語、abc中12文") == apart("日", "本", "語", "abc", "中", "12", "文")
    assert len(hashes("ก็ดี abc")) == 3 and hashes("ก็abc") == apart("ก็", "abc") and len(hashes("नमस्ते दुनिया")) == 2
    assert len(hashes("\u0301 \u0301\u0302x")) == 2 and hashes("") == hashes("…") == []


def test_items_in_other_scripts():
    items = ["请问下列哪一个城市是法国的首都", "L'été dernier, nous avons visité à Besançon l'école préférée de Zoé"]
    texts_ = [f"前面还有一些文字{items[0]}后面也有很多内容。", f"前面{items[0].replace('城', '都')}后面", f"x “{items[1].upper()}” — y", "其他的文字没有关系"]
    block = decontamination.Items([0, 1], items)
    found = block.matches(*decontamination.plain_words(pa.array(texts_)), decontamination.EDIT_SHARE)
    assert {k: v[0] for k, v in found.items()} == {(0, 0): 0, (1, 0): 1, (2, 1): 0}


# -- 5, 7, 10: classifiers --------------------------------------------------------


def test_languages(spark, messy, empty):
    rng = random.Random(1)
    sounds = {"aa": "ka lo mi".split(), "bb": "sch tz err".split(), "cc": "ião ção nh".split()}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30)), lang if i % 7 else None))
    rows += [(900, "", "aa"), (901, None, "bb"), (902, "12 !!", "cc"), (0, "repeated", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language_id.predict_languages(docs).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in rows[:300]}
    held = [r for r in found if r.held_out and truth.get(r.doc_id)]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id >= 900} == {900: "und", 901: "und", 902: "und"}
    assert language_id.predict_languages(messy).count() == messy.count()
    assert language_id.predict_languages(empty).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.predict_languages(unlabelled).collect()} == {"und"}


def test_penalty_makes_weights_sparse():
    leader = language_id.Leader(50, 2)
    rng = np.random.default_rng(0)
    for _ in range(200):
        target = int(rng.integers(2))
        leader.learn(np.array([target, 2 + int(rng.integers(40))]), np.array([1.0, 0.05]), target)
    weights = leader.weights(slice(None))
    assert abs(weights[0]).max() > 0.5 and (weights[2:50] == 0).mean() > 0.5


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    targets = np.array([rng.choice(3, p=p) for p in language_id.softmax(logits)])
    assert 2.2 < language_id.fitted_temperature(3 * logits, targets) < 4


def test_folding():
    assert toxicity.folded("1D10T") == "idiot" and toxicity.folded("ѕtupіd") == "stupid"
    assert toxicity.folded("$tup1d!!") == "stupid!!" and toxicity.folded("in 2024, 3 of 5") == "in 2024, 3 of 5"
    assert toxicity.folded("ｌｏｓｅｒ lo​ser") == "loser loser"


def test_matches_are_whole_words_outside_exceptions():
    lexicon = toxicity.Lexicon({"clown": 2.0, "idiot": 3.0}, ("class clown",))
    automaton = lexicon.automaton()
    weight = lambda text: toxicity.matched_weight(text, automaton)[0]
    assert weight("the clown, an idiot") == 5 and weight("the class clown") == 0
    assert weight("clowns idiotic") == 0 and weight("c1own CLOWN 1diot") == 7 and weight("") == 0
    assert toxicity.matched_weight("a b", toxicity.Lexicon({}, ()).automaton()) == (0.0, 2)


def toxic_table(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for at in rng.sample(range(60), 4):
                words[at] = rng.choice(["moron", "scum", "m0r0n"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, messy, empty, labels, no_labels):
    docs, marks = toxic_table(spark)
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    found = toxicity.toxicity_scores(docs, marks).collect()
    assert len(found) == 400 and all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert toxicity.toxicity_scores(messy, labels).count() == messy.count()
    assert {r.predicted for r in toxicity.toxicity_scores(messy, no_labels).collect()} == {0}
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_quality(spark, messy, empty, labels, no_labels):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(300):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('lmno')}{rng.choice('aeiou')}" for _ in range(80)]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)))
        marks.append((i, int(not bad), 0))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = quality_knn.quality_scores(docs, known, per_label=50).collect()
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) >= 0.98 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    scored = quality_knn.quality_scores(messy, labels)
    assert scored.count() == messy.count()
    assert {r.score for r in quality_knn.quality_scores(messy, no_labels).collect()} == {0.5}
    assert quality_knn.quality_scores(empty, labels).count() == 0


def test_neighbour_vote_is_exact():
    rng = np.random.default_rng(2)
    model = quality_knn.Neighbours(
        np.ones(quality_knn.N_TERMS, np.float32), rng.normal(size=(quality_knn.N_TERMS, 8)).astype(np.float32),
        quality_knn.unit(rng.normal(size=(60, 8)).astype(np.float32)), rng.integers(0, 2, 60).astype(float),
    )
    several = pa.array(["some words to vote on", "OTHER!! words", "", None, "some words to vote on"])
    scores = model.scores(several)
    rows = quality_knn.unit(quality_knn.weighted(quality_knn.term_counts(several), model.idf) @ model.axes)
    for row, score in zip(rows, scores):
        near = sorted(((float(row @ v), label) for v, label in zip(model.vectors, model.labels)), key=lambda x: -x[0])[: quality_knn.NEIGHBOURS]
        weights = [max(s, 0) ** 4 + 1e-9 for s, _ in near]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights), abs=1e-4)
    assert scores[0] == scores[4] and scores[2] == scores[3]


def test_sample_bounds(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(3000)] + [(i, "rare") for i in range(3000, 3007)]
    rows += [(9, None), (9, "a"), (9, "a")]
    table = spark.createDataFrame(rows, "doc_id bigint, label string")
    counts = Counter(r.label for r in labelled.sampled_ids(table, 40, 120).collect())
    assert counts["rare"] == 7 and 36 <= counts["a"] <= 40 and 36 <= counts["b"] <= 40
    few = Counter(r.label for r in labelled.sampled_ids(table, 40, 30).collect())
    assert set(few) == {"a", "b", "rare"} and sum(few.values()) <= 30
    assert {r.label for r in labelled.sampled_ids(table, 40, 1).collect()} == {"a"}
    copies = spark.createDataFrame([(1, "a")] * 60, "doc_id bigint, label string")
    assert labelled.sampled_ids(copies, 40, 40).collect() == [(1, "a")]
    assert labelled.sampled_ids(spark.createDataFrame([], "doc_id bigint, label string"), 40, 2).count() == 0


def test_one_scan_for_any_number_of_languages(spark, tmp_path):
    rows = [(i, f"l{i % 150}") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id bigint, label string").write.parquet(f"{tmp_path}/labelled")
    table = spark.read.parquet(f"{tmp_path}/labelled")
    assert len({r.label for r in labelled.sampled_ids(table, 5, 750).collect()}) == 150
    assert language_id.feature_bits(4) == language_id.BITS and language_id.feature_bits(1024) == 14
    assert all(n << language_id.feature_bits(n) <= 1 << language_id.MOST_WEIGHT_BITS for n in (0, 1, 5, 1025, 80_000))


def test_many_languages(spark):
    rng = random.Random(4)
    names = [f"l{i}" for i in range(230)]
    sounds = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(3)] for n in names}
    rows = [(i, " ".join("".join(rng.choices(sounds[n], k=2)) for _ in range(15)), n) for i, n in enumerate(names * 8)]
    found = language_id.predict_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    truth = {i: n for i, _, n in rows}
    held = [r for r in found if r.held_out]
    assert len({r.lang_pred for r in found}) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.8 * len(held)


# -- 8: quality rules -------------------------------------------------------------


def brute_counts(text):
    words = WORDS.findall(text)
    lines, seen, duplicate = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            duplicate += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicate, len(marked)


def test_quality_rules(messy, rows, empty):
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "# ", "a b c ", "\n", "é "]) for _ in range(rng.randint(0, 40)))
        assert quality_rules.base_counts(text) == brute_counts(text)
    found = quality_rules.quality_rules(messy).collect()
    want = []
    for i, text in rows:
        n_words, *others = brute_counts(text or "")
        want.append((i, n_words, *others, n_words < 50 or 100 * others[3] > 50 * n_words))
    assert by_key(tuple(r)[:7] for r in found) == by_key(want)
    assert not any(r.kept and r.base_failed for r in found)
    assert quality_rules.quality_rules(empty).count() == 0


def test_bands(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2000))
    repeated = " ".join(f"word{i} and {i}" for i in range(30)) + " "
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(4)) for _ in range(3000))
    half = prose[:8000] + "".join(f"line {i % 3} of the same kind {i}\n" for i in range(1500))
    rows = [(1, prose), (2, repeated * 40), (3, noise), (4, half)]
    found = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1].kept and not found[2].kept and not found[4].kept
    strict = quality_rules.Bands(bands=((0, 0.0, 0.5),))
    assert not quality_rules.quality_rules(spark.createDataFrame(rows[2:3], "doc_id bigint, text string"), strict).first().kept


def test_fitted_bands_against_brute_force(spark):
    """Every verdict from limits recomputed by sorting; both sides reject texts that the given limits let pass."""
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))

    def noise(n):
        return " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(7)) for _ in range(n))

    few = prose(60).split()

    def dull(n):
        return " ".join(rng.choice(few) for _ in range(n))

    rows = [(i, prose(rng.choice((60, 130, 260, 520, 1100)))) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(900)]  # copies do not move the limits
    rows += [(2000 + i, noise(n)) for i, n in enumerate((130, 300, 600, 1200))]
    rows += [(3000 + i, dull(n)) for i, n in enumerate((1100, 1200, 1300, 1400))]
    rows += [(4000, None), (4001, ""), (None, prose(300))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    given = quality_rules.Bands()
    measured = {r.text_hash: r for r in quality_rules.measure(table).collect()}
    values = {}
    for r in measured.values():
        if not r.base_failed:
            values.setdefault(r.n_bytes.bit_length() - 1, []).append(math.floor(r.ratio * 1000 + 0.5))
            for ratio in r.chunks:
                values.setdefault("chunks", []).append(math.floor(ratio * 1000 + 0.5))

    def limits(own):
        own = sorted(own)
        low, high = (own[math.ceil(len(own) * q / 4) - 1] / 1000 for q in (1, 3))
        reach = quality_rules.FENCE * max(high - low, quality_rules.LEAST_SPREAD) + quality_rules.UNKNOWN / math.sqrt(len(own))
        return low - reach, high + reach

    def rejected(r):
        if r.ratio is None:
            return False
        low, high = next((a, b) for n, a, b in reversed(given.bands) if r.n_bytes >= n)
        chunk_low, chunk_high = next((a, b) for n, a, b in reversed(given.bands) if given.chunk_bytes >= n)
        bad = sum(not chunk_low <= c <= chunk_high for c in r.chunks)
        failed = not low <= r.ratio <= high or bad > given.bad_chunks * len(r.chunks)
        below = [k for k in values if k != "chunks" and k < r.n_bytes.bit_length()]
        if below:
            low, high = limits(values[max(below)])
            failed |= not low <= r.ratio <= high
        low, high = limits(values["chunks"])
        return failed or sum(not low <= c <= high for c in r.chunks) > given.bad_chunks * len(r.chunks)

    by_id = {r.doc_id: r for r in quality_rules.measure(table).collect()}
    found = {r.doc_id: r for r in quality_rules.quality_rules(table).collect()}
    assert {i: r.bands_failed for i, r in found.items()} == {i: rejected(r) for i, r in by_id.items()}
    assert all(r.kept == (not r.base_failed and not r.bands_failed) for r in found.values())
    assert all(found[i].kept for i in range(400))
    wide = {r.doc_id: r for r in quality_rules.quality_rules(table, fitted=False).collect()}
    for i in (*range(2000, 2004), *range(3000, 3004)):
        assert found[i].bands_failed and not found[i].base_failed
    assert any(wide[i].kept for i in range(2000, 2004)) and any(wide[i].kept for i in range(3000, 3004))


def test_bands_where_no_text_passes_the_base_rules(spark):
    table = spark.createDataFrame([(1, "few words"), (2, "a b c " * 100), (3, None)], "doc_id bigint, text string")
    assert [(r.kept, r.base_failed) for r in quality_rules.quality_rules(table).collect()] == [(False, True)] * 3


# -- texts --------------------------------------------------------------------------


def test_words_and_slices():
    values = ["a B", None, "", "  x\ty ", "y", "é日 a"]
    data, offsets = texts.utf8_bytes(pa.array(values))
    begin, end, first = texts.word_ranges(data, offsets)
    own = [[data[a:b].tobytes().decode() for a, b in zip(begin[i:j], end[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert own == [WORDS.findall(v or "") for v in values]
    hashes, first = texts.word_hashes(data, offsets)
    assert hashes[0] == hashes[-1] and hashes[3] == hashes[4] and len(set(hashes.tolist())) == len(hashes) - 2 + 0
    batch = pa.record_batch({"text": values})
    assert [b.num_rows for b in texts.text_slices(batch, most=3)] == [3, 1, 1, 1] or sum(b.num_rows for b in texts.text_slices(batch, most=3)) == 6


def test_all_operators_on_an_empty_table(empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    assert bpe.bpe_digests(empty, PATH).count() == 0
    assert suffix_dedup.dedup_digests(empty).count() == 0
    assert token_files.read_documents(token_files.write_token_files(empty, PATH)).count() == 0
    assert token_counts.length_histogram(token_counts.token_lengths(empty, PATH)).count() == 0
