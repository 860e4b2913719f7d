from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seamline.functions.text import (
    count_lines, decode_utf8, line_range, preview, split_lines, text_block, unix_newlines,
)
from seamline.operators.chunking import chunk_count, chunk_lines
from seamline.params import IndexParams


def files(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")


def chunks(spark, text, size, overlap, first_only=False):
    rows = chunk_lines(files(spark, text), size, overlap, first_only).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in rows] == list(range(len(rows)))
    return [(r.start_line, r.end_line, r.text) for r in rows]


def brute_force(text, size, overlap):
    lines = text.split("\n")
    lines = [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    starts = range(0, len(lines), size - overlap) if size > overlap else range(0, min(1, len(lines)))
    return [(s + 1, min(s + size, len(lines)), "".join(lines[s : s + size])) for s in starts]


def test_hundred_lines(spark):
    text = "".join(f"line {i}\n" for i in range(1, 101))
    spans = [c[:2] for c in chunks(spark, text, 20, 5)]
    assert spans == [(1, 20), (16, 35), (31, 50), (46, 65), (61, 80), (76, 95), (91, 100)]


def test_file_smaller_than_a_chunk(spark):
    text = "".join(f"line {i}\n" for i in range(1, 11))
    assert chunks(spark, text, 20, 5) == [(1, 10, text)]


@pytest.mark.parametrize("text", ["", None])
def test_empty_and_unreadable(spark, text):
    assert chunks(spark, text, 20, 5) == []
    assert files(spark, text).select(count_lines(F.col("text"))).first()[0] == 0


def test_content(spark):
    text = "def foo():\n    return 42\n\ndef bar():\n    return 'hello'\n"
    got = chunks(spark, text, 3, 1)
    assert [c[:2] for c in got] == [(1, 3), (3, 5), (5, 5)]
    assert got[0][2] == "def foo():\n    return 42\n\n"
    assert "def bar():" in got[1][2]


def test_last_chunk_inside_the_one_before(spark):
    text = "x\n" * 20
    assert [c[:2] for c in chunks(spark, text, 20, 5)] == [(1, 20), (16, 20)]


def test_stride_not_positive_gives_one_chunk(spark):
    assert [c[:2] for c in chunks(spark, "x\n" * 30, 10, 10, True)] == [(1, 10)]
    assert [c[:2] for c in chunks(spark, "x\n" * 30, 10, 12, True)] == [(1, 10)]
    for size, overlap, first_only in ((10, 10, False), (10, 12, False), (10, 2, True)):
        with pytest.raises(ValueError):
            chunk_lines(files(spark, "a"), size, overlap, first_only)
    with pytest.raises(ValueError, match="exceed"):
        IndexParams(chunk_size_lines=10).check()


def test_only_newlines_separate_lines(spark):
    text = "a\x0cb c\x85d\nz"
    assert chunks(spark, text, 5, 1) == [(1, 2, text)]


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        chunk_lines(files(spark, "a"), 0, 0)


def test_against_brute_force(spark):
    @settings(max_examples=8, deadline=None)
    @given(
        st.lists(st.text(st.sampled_from("ab\n é"), max_size=60), min_size=1, max_size=20),
        st.integers(1, 6), st.integers(0, 6),
    )
    def check(texts, size, overlap):
        table = files(spark, *texts)
        got = {}
        first_only = size <= overlap
        for r in chunk_lines(table, size, overlap, first_only).orderBy("path", "chunk_no").collect():
            got.setdefault(int(r.path), []).append((r.start_line, r.end_line, r.text))
        counts = table.select("path", chunk_count(count_lines(F.col("text")), size, overlap, first_only).alias("n"))
        n = {int(r.path): r.n for r in counts.collect()}
        for i, text in enumerate(texts):
            expected = brute_force(text, size, overlap)
            assert got.get(i, []) == expected
            assert n[i] == len(expected)
            if size > overlap:
                covered = {line for s, e, _ in expected for line in range(s, e + 1)}
                assert covered == set(range(1, (expected[-1][1] if expected else 0) + 1))

    check()


def test_decoding(spark):
    cases = {
        b"ok\xff\xc3(bad\xe2\x82 end": "ok(bad end",
        b"a\r\nb\rc\n": "a\nb\nc\n",
        "true � stays".encode(): "true � stays",
        "�\xff".encode() + b"\xff\x01\x010": "�\xff\x01\x010",
        b"\xed\xa0\x80surrogate": "surrogate",
        b"": "",
    }
    for raw, text in cases.items():
        assert raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") == text
    table = spark.createDataFrame([(k,) for k in cases], "content binary")
    got = table.select("content", unix_newlines(decode_utf8(F.col("content"))).alias("t")).collect()
    assert {bytes(r.content): r.t for r in got} == cases


def test_lines_of_mixed_newlines(spark):
    table = spark.createDataFrame([(b"a\r\nb\rc\n",)], "content binary")
    lines = split_lines(unix_newlines(decode_utf8(F.col("content"))))
    assert table.select(lines).first()[0] == ["a", "b", "c"]


@pytest.mark.parametrize(
    "start, end, expected",
    [(1, 2, "a\nb\n"), (2, 3, "b\nc"), (3, 9, "c"), (4, 5, ""), (1, 1, "a\n")],
)
def test_line_range(spark, start, end, expected):
    got = files(spark, "a\nb\nc").select(line_range(F.col("text"), F.lit(start), F.lit(end))).first()[0]
    assert got == expected


@pytest.mark.parametrize("max_lines", [None, 0, 1, 2, 3, 4, 5, 6, 7])
def test_preview(spark, max_lines):
    content = "1\n2\n3\n4\n5\n"
    lines = content.split("\n")
    if max_lines is not None and len(lines) > max_lines:
        half = max_lines // 2
        lines = lines[:half] + ["    ..."] + lines[-half:]
    got = files(spark, content).select(preview(F.col("text"), max_lines)).first()[0]
    assert got == "\n".join(lines)


def test_preview_rejects_negative():
    with pytest.raises(ValueError):
        preview(F.lit("a"), -1)


def test_text_block(spark):
    block = text_block(F.lit("a/b.py"), F.lit(3), F.lit(4), F.lit(0.4567), F.lit("x\ny\n"))
    assert spark.range(1).select(block).first()[0] == "a/b.py:3-4  score=0.46\n    x\n    y\n    \n"
