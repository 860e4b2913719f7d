"""Merkle manifest of a dataset, with proofs by octopus multiproofs.

Rows are leaves; each tree (one per language) has nodes of up to ARITY children,
and the subroots of all trees are the leaves of one last tree, whose root stands
for the table.

A leaf partition is a block of up to BLOCK neighbouring places of a tree. From
the places that it holds it works out, level by level, the least set of nodes
that it can neither see nor derive: the missing siblings. It fetches these once,
derives all interiors that its leaves share, and expands each leaf's own proof
from them, without another look at the node table. Blocks hold leaves of one
tree only, have a fixed greatest size, and a tree with most of the rows has many
of them; nodes near the root, which all blocks of a tree ask for, are kept in as
many copies as that takes, so no key meets more than BLOCK requests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seamline.llm.labelled import fold
from seamline.llm.places import numbered
from seamline.work import work_folder, written

ARITY = 8
_LEVELS = 4
#: Most leaves of a leaf partition, and most requests that meet at one key.
BLOCK = ARITY**_LEVELS

NODES = "tree string, n bigint, level int, at bigint, digest string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the subroots; trees of languages have other names (see `tree_name`).
TOP = "top"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


def level_sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, the last of them 1."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def missing_nodes(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that the proofs of these leaves need, beyond what they give themselves."""
    known, needed = np.unique(places), []
    for level, size in enumerate(level_sizes(n)[:-1]):
        parents = np.unique(known // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        children = children[children < size]
        needed += [(level, int(i)) for i in np.setdiff1d(children, known, assume_unique=True)]
        known = parents
    return needed


def copies_of(level):
    """In how many copies the nodes of a level are kept: 8^(level + 1) leaves below the parent, BLOCK of them a block."""
    return max(1, ARITY ** (level + 1 - 2 * _LEVELS))


# -- leaves --------------------------------------------------------------------


def tree_name(lang: Column) -> Column:
    """Names of trees order as languages do by their bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def leaf_digest(values: dict[str, Column]) -> Column:
    """sha256 of the fields one after the other: `-` for null, else byte count, `:`, value."""
    parts = []
    for name in FIELDS:
        value = values[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def document_leaves(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, lang, doc_id, digest and, where `tampered` (a condition) holds, the digest of the row with its A-Z lower-cased."""
    fields = {name: F.col(name) for name in FIELDS}
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(tampered, leaf_digest({**fields, "text": lower_ascii(F.col("text"))}))
    return documents.select(
        tree_name(F.col("lang")).alias("tree"), "lang", F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest(fields).alias("digest"), changed.alias("other"),
    )


# -- trees ---------------------------------------------------------------------


def _block(at: str = "at") -> Column:
    return F.expr(f"{at} div {BLOCK}")


def _climb(base: int) -> Callable[[pa.Table], pa.Table]:
    """The nodes above one block of nodes of level `base`, as far as _LEVELS levels or the top of the tree."""

    def climb(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        tree, n = rows.column("tree")[0].as_py(), rows.column("n")[0].as_py()
        top = min(base + _LEVELS, len(level_sizes(n)) - 1)
        digests = [d.encode() for d in rows.column("digest").to_pylist()]
        first, made = rows.column("at")[0].as_py(), []
        for level in range(base + 1, top + 1):
            digests = [digest_of(b"".join(digests[i : i + ARITY])) for i in range(0, len(digests), ARITY)]
            first //= ARITY
            made += [(level, first + i, d.decode()) for i, d in enumerate(digests)]
        levels, places, values = zip(*made) if made else ((), (), ())
        return pa.table({
            "tree": pa.array([tree] * len(made), pa.string()), "n": pa.array([n] * len(made), pa.int64()),
            "level": pa.array(levels, pa.int32()), "at": pa.array(places, pa.int64()), "digest": pa.array(values, pa.string()),
        })

    return climb


def interior_nodes(leaves: DataFrame) -> DataFrame:
    """All nodes above the leaves (tree, n, at, digest): a written table of NODES, partitioned by level.

    One job per _LEVELS levels; each block of nodes becomes its few levels in
    one task, and only block tops go on.
    """
    spark, folder = leaves.sparkSession, work_folder(leaves.sparkSession)
    most = leaves.agg(F.max("n")).first()[0] or 0
    height, base, level = len(level_sizes(most)) - 1 if most else 0, leaves.select("tree", "n", "at", "digest"), 0
    spark.createDataFrame([], NODES).write.partitionBy("level").parquet(folder)
    while level < height:
        made = base.withColumn("block", _block()).groupBy("tree", "block").applyInArrow(_climb(level), NODES)
        made.write.partitionBy("level").mode("append").parquet(folder)
        level += _LEVELS
        # A tree that ended below this level has no row here; one that ends at it is finished too.
        base = spark.read.schema(NODES).parquet(folder).where((F.col("level") == level) & (F.col("n") > ARITY**level))
        base = base.select("tree", "n", "at", "digest")
    return spark.read.schema(NODES).parquet(folder)


def subroots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, subroot: the highest node of each tree, or its only leaf."""
    ended = F.expr("at = 0 and n <= pow(%d, level) and n > pow(%d, level - 1)" % (ARITY, ARITY))
    tops = nodes.where(ended & (F.col("level") > 0)).select("tree", F.col("digest").alias("subroot"))
    return tops.unionAll(leaves.where("n = 1").select("tree", F.col("digest").alias("subroot")))


# -- proofs --------------------------------------------------------------------


def _requests(table: pa.Table) -> pa.Table:
    tree, n, block = (table.column(c)[0].as_py() for c in ("tree", "n", "block"))
    needed = missing_nodes(table.column("at").to_numpy(), n)
    blocks = -(-n // BLOCK)
    # Level -1 asks for the path above the tree's own root, of which a tree of many blocks keeps several copies.
    rows = [(level, at, block % copies_of(level)) for level, at in needed] + [(-1, 0, block % -(-blocks // BLOCK))]
    levels, places, copies = zip(*rows)
    return pa.table({
        "tree": pa.array([tree] * len(rows), pa.string()), "block": pa.array([block] * len(rows), pa.int64()),
        "level": pa.array(levels, pa.int32()), "at": pa.array(places, pa.int64()), "copy": pa.array(copies, pa.int64()),
    })


_FETCHED = "tree string, block bigint, level int, at bigint, digest string, before array<string>, after array<string>"


def fetched_nodes(chosen: DataFrame, leaves: DataFrame, nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """What each block of `chosen` (tree, n, at, ...) asks for: one row per missing node, and one for the path above its tree.

    `above`: tree, n, before, after, or None where the trees' roots are the last.
    """
    asked = chosen.select("tree", "n", "at", _block().alias("block")).groupBy("tree", "block").applyInArrow(
        _requests, "tree string, block bigint, level int, at bigint, copy bigint"
    )
    asked = written(asked)
    levels = sorted(r["level"] for r in asked.select("level").distinct().collect() if r["level"] >= 0)
    empty = F.lit(None).cast("array<string>")
    # Blocks of whole trees never ask below _LEVELS; a subset of leaves may ask for any level.
    known = nodes.where(F.col("level").isin(levels)).select("tree", "level", "at", "digest")
    if 0 in levels:
        known = known.unionAll(leaves.select("tree", F.lit(0).alias("level"), "at", "digest"))
    copies = F.expr(f"cast(greatest(1, pow({ARITY}, level + 1 - {2 * _LEVELS})) as bigint)")
    known = known.select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    rows = asked.where("level >= 0").join(known, ["tree", "level", "at", "copy"])
    rows = rows.select("tree", "block", "level", "at", "digest", empty.alias("before"), empty.alias("after"))
    if above is not None:
        n_copies = F.expr(f"cast(ceil(ceil(n / {BLOCK}) / {BLOCK}) as bigint)")
        paths = above.select("tree", "before", "after", F.explode(F.sequence(F.lit(0), n_copies - 1)).alias("copy"))
        top = asked.where("level = -1").join(paths, ["tree", "copy"])
        rows = rows.unionAll(top.select("tree", "block", "level", "at", F.lit(None).cast("string").alias("digest"), "before", "after"))
    return rows


class Block:
    """The part of a tree that the proofs of some leaves need: what they give themselves, and fetched nodes."""

    def __init__(self, leaves: dict[int, bytes], n: int, fetched: dict[tuple[int, int], bytes]):
        self.sizes = level_sizes(n)
        self.known: list[dict[int, bytes]] = [dict(leaves)]
        for level, size in enumerate(self.sizes[:-1]):
            here, above = self.known[level], {}
            for parent in {i // ARITY for i in here}:
                run = range(parent * ARITY, min(parent * ARITY + ARITY, size))
                for i in run:
                    if i not in here:
                        here[i] = fetched[level, i]
                above[parent] = digest_of(b"".join([here[i] for i in run]))
            self.known.append(above)
        self.root = self.known[-1][0]
        self._rest: dict[tuple[int, int], bytes] = {(len(self.sizes) - 1, 0): b""}

    def around(self, level: int, i: int) -> tuple[bytes, bytes]:
        """The siblings left and right of a node."""
        here, first = self.known[level], i // ARITY * ARITY
        last = min(first + ARITY, self.sizes[level])
        return b"".join([here[k] for k in range(first, i)]), b"".join([here[k] for k in range(i + 1, last)])

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        steps = []
        for level in range(len(self.sizes) - 1):
            steps.append(self.around(level, i))
            i //= ARITY
        return steps

    def siblings(self, level: int, i: int) -> bytes:
        """All siblings on the way up, level by level; shared by all leaves below a node."""
        done = self._rest.get((level, i))
        if done is None:
            before, after = self.around(level, i)
            done = before + after + self.siblings(level + 1, i // ARITY)
            if level:
                self._rest[level, i] = done
        return done


def folded(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a digest and its siblings give."""
    for before, after in path:
        digest = digest_of(before + digest + after)
    return digest


def _block_of(leaves: pa.Table, fetched: pa.Table) -> tuple[Block, list[tuple[bytes, bytes]]]:
    """The block, and the path above its tree."""
    nodes, above = {}, []
    for row in fetched.to_pylist():
        if row["level"] < 0:
            above = [(b.encode(), a.encode()) for b, a in zip(row["before"], row["after"])]
        else:
            nodes[row["level"], row["at"]] = row["digest"].encode()
    own = {at: d.encode() for at, d in zip(leaves.column("at").to_pylist(), leaves.column("digest").to_pylist())}
    return Block(own, leaves.column("n")[0].as_py(), nodes), above


def _cogrouped(leaves: DataFrame, fetched: DataFrame, expand, schema: str) -> DataFrame:
    blocks = leaves.withColumn("block", _block()).groupBy("tree", "block")
    return blocks.cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, schema)


def proofs(chosen: DataFrame, leaves: DataFrame, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """tree, at, before, after: per leaf its siblings of each level, left and right ones concatenated, up to the last root.

    `chosen` (tree, n, at, digest) may be any part of the `leaves` that `nodes` were built from.
    """

    def expand(own: pa.Table, fetched: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"tree": pa.array([], pa.string()), "at": pa.array([], pa.int64()), "before": pa.array([], pa.list_(pa.string())), "after": pa.array([], pa.list_(pa.string()))})
        block, rest = _block_of(own, fetched)
        paths = [block.path(at) + rest for at in own.column("at").to_pylist()]
        sides = [pa.array([[step[side].decode() for step in path] for path in paths], pa.list_(pa.string())) for side in (0, 1)]
        return pa.table({"tree": own.column("tree"), "at": own.column("at"), "before": sides[0], "after": sides[1]})

    rows = chosen.select("tree", "n", "at", "digest")
    return _cogrouped(rows, fetched_nodes(rows, leaves, nodes, above), expand, "tree string, at bigint, before array<string>, after array<string>")


_DIGESTS = "lang string, doc_id bigint, digest string, subroot string, proof_sha256 string, folded_root string"


def proof_digests(leaves: DataFrame, nodes: DataFrame, above: DataFrame) -> DataFrame:
    """lang, doc_id, digest, subroot, proof_sha256, folded_root of each leaf; proofs are expanded and hashed inside the block.

    folded_root comes from `other` where that is not null, else from the leaf,
    with the siblings of the original rows.
    """

    def expand(own: pa.Table, fetched: pa.Table) -> pa.Table:
        rows, made = own.to_pylist(), []
        if rows:
            block, rest = _block_of(own, fetched)
            last, subroot, root = b"".join([b + a for b, a in rest]), block.root.decode(), folded(block.root, rest).decode()
            for row in rows:
                proof = hashlib.sha256(block.siblings(0, row["at"]) + last).hexdigest()
                other = row["other"]
                end = root if other is None or other == row["digest"] else folded(other.encode(), block.path(row["at"]) + rest).decode()
                made.append((row["lang"], row["doc_id"], row["digest"], subroot, proof, end))
        columns = list(zip(*made)) or [()] * 6
        names = [f.split()[0] for f in _DIGESTS.split(", ")]
        return pa.table({n: pa.array(c, pa.int64() if n == "doc_id" else pa.string()) for n, c in zip(names, columns)})

    return _cogrouped(leaves, fetched_nodes(leaves, leaves, nodes, above), expand, _DIGESTS)


class Manifest:
    """The trees of a table of documents: placed leaves, their nodes, the tree of subroots, the root (None without rows)."""

    def __init__(self, documents: DataFrame, tampered: Column | None = None):
        leaves = written(document_leaves(documents, tampered))
        self.leaves = written(numbered(leaves, "tree", ["doc_id", "digest"]))
        self.nodes = interior_nodes(self.leaves)
        trees = subroots(self.leaves, self.nodes).join(self.leaves.groupBy("tree").agg(F.max("n").alias("leaves")), "tree")
        ordered = numbered(trees.select(F.lit(TOP).alias("all"), F.col("tree").alias("name"), "subroot", "leaves"), "all", ["name"])
        self.trees = written(ordered.select("name", "leaves", F.col("all").alias("tree"), "n", "at", F.col("subroot").alias("digest")))
        self.top = interior_nodes(self.trees)
        root = subroots(self.trees, self.top).first()
        self.root = root["subroot"] if root else None

    def paths_above(self) -> DataFrame:
        """tree, n (its leaves), before, after: the way from each tree's subroot to the root."""
        found = proofs(self.trees, self.trees, self.top).select("at", "before", "after")
        return written(self.trees.join(found, "at").select(F.col("name").alias("tree"), F.col("leaves").alias("n"), "before", "after"))


def manifest_digests(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Leaves of a language ascend by doc_id, null first; of rows with one doc_id
    the leaf hashes decide, and rows equal in everything each have a place and a
    proof of their own. Null fields are hashed as `-`, an empty text as `0:`.
    Rows whose doc_id has a crc32 that 3 divides are tampered with (A-Z of the
    text lower-cased); a null doc_id has none and stays as it is. Other columns
    are not part of a leaf. No rows, no result.
    """
    made = Manifest(documents, tampered=fold(F.col("doc_id").cast("bigint"), 3) == 0)
    rows = proof_digests(made.leaves, made.nodes, made.paths_above())
    root = F.lit(made.root).cast("string")
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
