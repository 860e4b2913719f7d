"""Licence scans, Merkle manifest and source divergence against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import sentence
from seamline.llm import divergence, licenses, merkle, places, sql, texts

LOWER = {c: c + 32 for c in range(65, 91)}


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# -- places --------------------------------------------------------------------


def test_places_of_a_hot_group_and_equal_rows(spark):
    rows = [("hot", i % 7) for i in range(900)] + [("hot", None)] * 50 + [(f"g{i % 5}", i) for i in range(40)]
    table = spark.createDataFrame(rows, "g string, k int").repartition(5)
    found = places.numbered(table, "g", ["k"]).collect()
    sizes = Counter(g for g, _ in rows)
    of = defaultdict(list)
    for r in found:
        assert r.n == sizes[r.g]
        of[r.g].append((r.at, r.k))
    for g, own in of.items():
        assert sorted(a for a, _ in own) == list(range(sizes[g]))
        assert [k for _, k in sorted(own)] == sorted((k for x, k in rows if x == g), key=lambda k: (k is not None, k))
    assert places.numbered(table.limit(0), "g", ["k"]).count() == 0


# -- 12: Merkle manifest ---------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """The root, and per leaf the list of (left siblings, right siblings)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // 8 * 8
            paths[i].append((level[first:place], level[place + 1 : first + 8]))
        at = [place // 8 for place in at]
        level = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return (level[0] if level else None), paths


def brute_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row.lang].append(row)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {}
    for lang in order:
        own = sorted(trees[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)))
        built[lang] = (own, *brute_tree([brute_leaf(r, r.text) for r in own]))
    root, above = brute_tree([built[lang][1] for lang in order])
    made = []
    for lang, top in zip(order, above):
        own, subroot, paths = built[lang]
        for row, path in zip(own, paths):
            leaf = digest = brute_leaf(row, row.text)
            if row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0 and row.text is not None:
                digest = brute_leaf(row, row.text.translate(LOWER))
            proof = []
            for left, right in path + top:
                proof += left + right
                digest = sha(*left, digest, *right)
            made.append((row.doc_id, leaf, subroot, root, sha(*proof), digest, digest == root))
    return made


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows(documents):
    found = merkle.manifest_digests(documents)
    assert found.columns == MANIFEST
    return [tuple(r) for r in found.collect()]


def test_manifest(messy):
    assert by_key(manifest_rows(messy)) == by_key(brute_manifest(messy.collect()))


def many_documents(spark, n=700):
    rng = random.Random(4)
    langs = ["en"] * 6 + ["de", None, "", "fr", "日本", "x0", "x1", "x2", "x3", "x4"]
    rows = [(i, sentence(rng, 3).title(), rng.choice(langs), f"s{i % 3}", i, i) for i in range(n)] + [(n, "alone", "one", "s", 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, at int").repartition(6)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_many_blocks(spark, monkeypatch, levels):
    """Small blocks: every tree has many of them, and nodes near the root are kept in copies."""
    monkeypatch.setattr(merkle, "_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    docs = many_documents(spark)
    found = manifest_rows(docs)
    assert by_key(found) == by_key(brute_manifest(docs.collect()))
    assert {r[-1] for r in found} == {True, False}


def test_manifest_in_sql(spark, tmp_path):
    many_documents(spark).drop("at").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = db.sql(f"SELECT {', '.join(MANIFEST)} FROM ({sql.statements()['op12_merkle_manifest']})").fetchall()
    assert by_key(theirs) == by_key(manifest_rows(spark.read.parquet(f"{tmp_path}/documents.parquet")))


def test_manifest_without_rows(empty):
    assert manifest_rows(empty) == []


def test_missing_nodes_are_least():
    """What is fetched and what the leaves give is all that their proofs need, and nothing fetched could be derived."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 9, 64, 65, 700):
        for size in {1, min(n, 3), min(n, 40), n}:
            own = rng.choice(n, size, replace=False)
            needed = set(merkle.missing_nodes(own, n))
            sizes, expected, known = merkle.level_sizes(n), set(), set(own.tolist())
            for level in range(len(sizes) - 1):
                run = {i for k in known for i in range(k // 8 * 8, min(k // 8 * 8 + 8, sizes[level]))}
                expected |= {(level, i) for i in run - known}
                known = {k // 8 for k in known}
            assert needed == expected and (size < n or not needed)


def test_proofs_of_some_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    made = merkle.Manifest(many_documents(spark, 300))
    some = made.leaves.where("doc_id % 11 = 0")
    found = {(r.tree, r.at): r for r in merkle.proofs(some, made.leaves, made.nodes, made.paths_above()).collect()}
    rows = some.collect()
    assert len(found) == len(rows) > 20
    for row in rows:
        digest, path = row.digest, found[row.tree, row["at"]]
        for before, after in zip(path.before, path.after):
            digest = sha(before, digest, after)
        assert digest == made.root


# -- 13: source divergence ------------------------------------------------------


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_divergence(rows, reported=200):
    docs = [(r.lang or "", r.source or "", TERM.findall((r.text or "").translate(LOWER))) for r in rows]
    df, counts, groups = Counter(), Counter(), sorted({d[:2] for d in docs})
    for lang, source, terms in docs:
        df.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    made = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for x, t in df if x == lang and df[x, t] >= 3)
        sources = [s for x, s in groups if x == lang]

        def share(count):
            total = sum(count.values())
            return {t: 1 + 1000000000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        whole = share({t: sum(own[s][t] for s in sources) for t in kept})
        shares = {s: share(own[s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (shares[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if own[s][t] and shares[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                kept_items = items if part == "pair" else items[:reported]
                made += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(kept_items)]
    return made


def divergence_rows(documents, **options):
    found = divergence.source_divergence(documents, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return [tuple(r) for r in found.collect()]


def worded(spark, n=240):
    rng = random.Random(9)
    words = "alpha Beta gamma DELTA épée Straße naïve 日本 e-mail x1y one's".split() + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else f"s{min(rng.randrange(14), 8)}"
        text = None if i % 23 == 0 else " ".join(rng.choice(words[: 8 + i % 29]) for _ in range(rng.randrange(0, 30)))
        rows.append((i, text, ("en", "de", None, "", "fr")[min(i % 9, 4)], source, "x", 1))
    # A language of one source, and one without kept terms.
    rows += [(n, "only here only here", "solo", "s1", "y", 2), (n + 1, "a b", "bare", "s1", "", 0), (n + 2, None, "bare", None, "", 0), (n + 2, None, "bare", None, "", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, term string, number int").repartition(5)


def test_divergence(messy):
    assert by_key(divergence_rows(messy)) == by_key(brute_divergence(messy.collect()))


@pytest.mark.parametrize("options", [{}, {"most": 7}, {"at_once": 2}, {"reported": 3, "at_once": 5, "most": 20}])
def test_divergence_spills_and_passes(spark, options):
    """The same rows whether stripes are spilled early and sources come in several passes."""
    docs = worded(spark)
    expected = brute_divergence(docs.collect(), options.get("reported", 200))
    assert by_key(divergence_rows(docs, **options)) == by_key(expected)
    assert {("bare", "", "pair", "s1", 0, 1), ("bare", "s1", "pair", "", 0, 1)} <= set(expected) and not any(r[0] == "solo" and r[2] == "pair" for r in expected)


def test_divergence_without_rows(empty):
    assert divergence_rows(empty) == []


@pytest.mark.parametrize("most", [10**10, 10**13, 10**15])
def test_shares_are_exact_for_large_counts(most):
    rng = random.Random(3)
    counts = [0, 1, 9_300_000_000, most - 7] + [rng.randrange(most) for _ in range(200)]
    own, terms = np.array([sum(counts)], np.int64), np.array([len(counts)], np.int64)
    found = divergence.shares(np.array(counts, np.int64)[:, None], own, terms)[:, 0].tolist()
    assert found == [1 + 10**9 * (c + 1) // (sum(counts) + len(counts)) for c in counts]


def test_best_terms_are_cut_whole():
    """Cutting in between changes nothing."""
    totals = divergence.Totals(np.arange(2), ["en", "en"], ["a", "b"], np.array([900, 100]), np.array([1000, 1000]), np.array([60, 60]))
    stripes = [[{"source": "a", "n": 30 - i % 30}, {"source": "b", "n": i % 4}] for i in range(60)]
    kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
    names = [f"t{i % 7}{i}" for i in range(60)]

    def best(step, cut):
        made = divergence.Divergences(totals, totals, 5)
        for at in range(0, 60, step):
            made.add("en", pa.array(names[at : at + step]), pa.array(stripes[at : at + step], kind))
            if cut:
                made._cut()
        return sorted(str(r) for b in made.rows() for r in b.to_pylist() if r["other"] < 0), [b for b in made.rows()]

    assert best(60, False) == best(7, True)


def test_pieces_cut_no_term():
    unit = re.compile(rb"[a-z\x80-\xff]")
    for text in (b"", b"abc def", "é".encode() * 50, b"one, two;three  " * 20, b"x" * 100):
        for size in (1, 2, 7, 1000):
            parts = list(texts.pieces(text, unit, size))
            assert b"".join(parts) == text
            assert [t for p in parts for t in re.findall(rb"[a-z\x80-\xff]+", p)] == re.findall(rb"[a-z\x80-\xff]+", text)


# -- 11: licence scans ------------------------------------------------------------


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def places_of(own, phrase):
    return [i for i in range(len(own) - len(phrase) + 1) if own[i : i + len(phrase)] == phrase]


def brute_licences(rows, rules):
    """Every offset of every key phrase is tried, without an index."""
    known = {w.decode() for w in rules.numbers}
    df = Counter(w for _, t in rows for w in set(words(t)) & known)
    idf = {w: 1 + math.log((len(rows) + 1) / (df[w] + 1)) for w in known}
    made = []
    for doc_id, text in rows:
        own = words(text)
        starts, base, labels, score = [], set(), set(), 0.0
        for phrase, label in rules.base.items():
            found = places_of(own, words(phrase))
            starts += found
            base |= {label} if found else set()
        for label, notice, keys in rules.notices:
            template = words(notice)
            offsets = [[p - places_of(template, words(k))[0] for p in places_of(own, words(k))] for k in keys]
            for start in {o for some in offsets for o in some}:
                if all(any(start <= o <= start + 2 * rules.slack for o in some) for some in offsets):
                    labels.add(label)
                    held = [w in own[max(0, at + start) : max(0, at + start + 2 * rules.slack + 1)] for at, w in enumerate(template)]
                    score = max(score, sum(idf[w] for w, h in zip(template, held) if h) / sum(idf[w] for w in template))
        score = max(score, licenses.BASE_SCORE) if base else score
        made.append((doc_id, len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 9)))
    return made


def licensed_texts():
    rng = random.Random(8)
    made = []
    for label, notice, _ in licenses.NOTICES:
        made += [notice, f"{sentence(rng, 40)}\n# {notice}.\n{sentence(rng, 30)}", notice.upper(), " * ".join(notice.split())]
        own = notice.split()
        made.append(" ".join(own[: len(own) // 2] + sentence(rng, 9).split() + own[len(own) // 2 :]))
        made.append(" ".join(own[: len(own) // 2] + sentence(rng, 40).split() + own[len(own) // 2 :]))
        rng.shuffle(own)
        made.append(" ".join(own))
    made += ["MIT License mit license MIT-LICENSE", "cc by cc by", "the mit licenses", "Apache\nLicense and the GNU general, public license", "cc éby", "2.0"]
    made.append(" ".join(licenses.NOTICES[i][1] for i in (0, 2, 9)) + " " + sentence(rng, 3000) + " " + licenses.NOTICES[5][1])
    return made


def licence_rows(documents, rules=None):
    found = licenses.scan_licences(documents, rules)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return [(*r[:7], round(r.score, 9)) for r in found.collect()]


@pytest.mark.parametrize("slack", [licenses.SLACK, 2])
def test_licences(spark, messy, slack):
    rules = licenses.Rules(slack=slack)
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()] + [(1000 + i, t) for i, t in enumerate(licensed_texts())]
    docs = spark.createDataFrame([(*r, 3, "w") for r in rows], "doc_id bigint, text string, n_words int, words string").repartition(3)
    assert by_key(licence_rows(docs, rules)) == by_key(brute_licences(rows, rules))


def test_every_notice_is_found(spark):
    docs = spark.createDataFrame([(i, f"some words before {n[1]} and after") for i, n in enumerate(licenses.NOTICES)], "doc_id bigint, text string")
    found = {r[0]: r for r in licence_rows(docs)}
    for i, (label, _, _) in enumerate(licenses.NOTICES):
        assert label in found[i][6].split(",") and found[i][7] == 1.0


def test_licences_without_rows(empty):
    assert licence_rows(empty) == []


def test_a_template_needs_its_phrases():
    with pytest.raises(ValueError):
        licenses.Rules(notices=(("x", "one two three", ("two one",)),))
