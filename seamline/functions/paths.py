"""Path expressions; a path is relative to its root and uses `/`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from seamline.fixed_values import LANGUAGES


def path_parts(path: Column) -> Column:
    """The sort key of paths: `a/b` comes before `a-b`, unlike in string order."""
    return F.split(path, "/", -1)


def path_key(path: Column) -> Column:
    """A string that orders paths as their parts do, by bytes."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def extension(path: Column) -> Column:
    """Lower-cased last `.x` of the file name; "" for `.name`, `name.` and no dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    return extension(path).isin(sorted({e.lower() for e in extensions}))


def in_excluded_folder(path: Column, folders: Iterable[str]) -> Column:
    """True if any folder above the file bears one of the names, case-sensitively."""
    names = F.array(*[F.lit(f) for f in folders]).cast("array<string>")
    parts = path_parts(path)
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), names)


def language(path: Column) -> Column:
    pairs = [F.lit(item) for pair in LANGUAGES.items() for item in pair]
    return F.element_at(F.create_map(*pairs), extension(path))


def relative_path(path: Column, root: str) -> Column:
    """Path below `root`, null for a path that is not below it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30))
