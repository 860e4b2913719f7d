from __future__ import annotations

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from seamline.functions.paths import extension, language, path_parts, relative_path
from seamline.operators.files import keep_files
from seamline.params import IndexParams, load_params, save_params
from seamline.sources.tree import TreeSource

TREE = (
    "a.py", "B.PY", "__init__.py", ".hid.py", ".github/w.yml", "_pkg/m.py", "build/m.py",
    "Build/m.py", "empty.py", "x.md", "noext", ".gitignore", "t.d.ts", "deep/er/and/deeper/z.rs",
    "deep/node_modules/q/z.rs", "build.py/inside.go", "deep/build",
)
KEPT = set(TREE) - {
    "build/m.py", "x.md", "noext", ".gitignore", "deep/node_modules/q/z.rs", "deep/build",
}


@pytest.fixture
def tree(tmp_path):
    for name in TREE:
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if name == "empty.py" else b"first\r\nsecond \xff\n")
        os.utime(file, (1000.25, 1000.25))
    return tmp_path


def test_extension_and_language(spark):
    names = list(TREE) + ["name.", "a.b/noext", "..x", "dir.d/.y", "A.TXT", "a.BASH", "a.é"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select(
        "path", extension(F.col("path")).alias("ext"), language(F.col("path")).alias("lang")
    ).collect()
    for r in rows:
        assert r.ext == pathlib.PurePosixPath(r.path).suffix.lower(), r.path
    by_path = {r.path: r.lang for r in rows}
    assert by_path["B.PY"] == "python" and by_path["t.d.ts"] == "typescript"
    assert by_path["A.TXT"] == "text" and by_path["a.BASH"] == "shell" and by_path["noext"] is None


def test_keep_files(spark):
    paths = spark.createDataFrame([(n,) for n in TREE], "path string")
    assert {r.path for r in keep_files(paths).collect()} == KEPT


def test_tree_listing(spark, tree):
    rows = TreeSource(spark, str(tree)).listing().collect()
    assert {r.path for r in rows} == KEPT and len(rows) == len(KEPT)
    assert {r.mtime for r in rows} == {1000.25}
    assert {r.path: r.size for r in rows}["empty.py"] == 0


def test_tree_below_an_excluded_name(spark, tree):
    """Folders above the root do not matter."""
    rows = TreeSource(spark, str(tree / "build")).listing().collect()
    assert [r.path for r in rows] == ["m.py"]


def test_tree_links(spark, tree):
    os.symlink(tree / "deep", tree / "linked")
    os.symlink(tree / "a.py", tree / "link.py")
    os.symlink(tree / "nowhere.py", tree / "broken.py")
    rows = {r.path: r.mtime for r in TreeSource(spark, str(tree)).listing().collect()}
    assert set(rows) == KEPT | {"link.py", "broken.py"}
    assert rows["link.py"] == 1000.25 and rows["broken.py"] is None


def test_missing_root_ends_the_job(spark, tree):
    with pytest.raises(Exception, match="nowhere"):
        TreeSource(spark, str(tree / "nowhere")).listing().collect()


def test_tree_read(spark, tree):
    source = TreeSource(spark, str(tree))
    texts = {r.path: r.text for r in source.read_all(source.listing()).collect()}
    assert set(texts) == KEPT
    assert texts["empty.py"] == "" and texts["a.py"] == "first\nsecond \n"
    gone = spark.createDataFrame([("gone.py",)], "path string")
    assert source.read(gone).first().text is None


def test_relative_path(spark):
    row = spark.range(1).select(
        relative_path(F.lit("/x/y/z.py"), "/x/").alias("a"), relative_path(F.lit("/z.py"), "/x").alias("b")
    ).first()
    assert row.a == "y/z.py" and row.b is None


def test_order_of_paths(spark):
    names = ["a-b/x", "a/b", "a", "a/b/c", "B"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").orderBy(path_parts(F.col("path")))
    assert [r.path for r in rows.collect()] == sorted(names, key=lambda n: n.split("/"))


def test_params_round_trip(spark, tmp_path):
    params = IndexParams(embedding_dim=256, include_extensions=[".x"], chunk_size_lines=9)
    save_params(spark, params, str(tmp_path / "p"))
    assert load_params(spark, str(tmp_path / "p")) == params
    with pytest.raises(FileNotFoundError):
        load_params(spark, str(tmp_path / "none"))


def test_params_missing_keys_and_empty_values(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"chunk_size_lines": 7}\n')
    loaded = load_params(spark, str(tmp_path / "p.json"))
    assert loaded == IndexParams(chunk_size_lines=7)
    assert IndexParams("", 0, [], 0, 0) == IndexParams()
    assert IndexParams().chunk_overlap_lines == 16 and len(IndexParams().include_extensions) == 23


def test_params_checks():
    with pytest.raises(ValueError, match="embedding_dim"):
        IndexParams(embedding_dim=100).check()
    assert IndexParams(embedding_dim=100).check((100,))
