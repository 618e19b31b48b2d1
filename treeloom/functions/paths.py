"""Path columns: everything derives from ``relative_path`` with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.functions import lookups


def name(path: Column) -> Column:
    """Last path component."""
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Folder of a path, ``.`` at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def suffix(path: Column) -> Column:
    """Last suffix as written; empty for ``Makefile``, ``.profile`` and a trailing dot."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix."""
    return F.lower(suffix(path))


def file_id(path: Column) -> Column:
    """Identifier with ``/``, ``.`` and ``-`` replaced; distinct paths may share one."""
    return F.translate(path, "/.-", "___")


def browser_file_id(path: Column) -> Column:
    """Fallback identifier that keeps dashes."""
    return F.translate(path, "/.", "__")


def ancestors(folder: Column) -> Column:
    """All folders that contain ``folder``'s files: ``.`` first, the folder itself last."""
    parts = F.split(folder, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return F.when(folder == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), prefixes))


def depth(folder: Column) -> Column:
    """Number of folders below the root."""
    return F.when(folder == ".", F.lit(0)).otherwise(F.size(F.split(folder, "/")))


def sort_key(path: Column) -> Column:
    """String whose order is the tree order: folders before files, then lower-cased names.

    It is a function of the path alone, so inventory order needs no global numbering. ``\\x01``
    separates levels and sorts below every name character.
    """
    parts = F.split(path, "/")
    folders = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(F.lit("0"), F.lower(p), F.lit("\x02"), p)
    )
    last = F.element_at(parts, -1)
    leaf = F.concat(F.lit("1"), F.lower(last), F.lit("\x02"), last)
    return F.array_join(F.concat(folders, F.array(leaf)), "\x01")


def language(path: Column) -> Column:
    """Fence language from the file name, ``text`` when unknown."""
    by_name = F.create_map(*[F.lit(x) for kv in lookups.LANGUAGE_BY_NAME.items() for x in kv])
    by_ext = F.create_map(*[F.lit(x) for kv in lookups.LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.coalesce(by_name[name(path)], by_ext[extension(path)], F.lit("text"))


def in_excluded_folder(path: Column) -> Column:
    """True when any folder on the way to the file is never entered."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(folders, lambda p: p.startswith(".") | p.isin(*lookups.EXCLUDED_DIRS))


def is_skipped_name(path: Column) -> Column:
    """True for hidden files and for lock files (suffix test keeps the original case)."""
    base = name(path)
    suffixes = "|".join(s.lstrip(".") for s in lookups.LOCK_SUFFIXES)
    lock = F.contains(F.lower(base), F.lit("lock")) & base.rlike(rf"\.({suffixes})$")
    return base.startswith(".") | lock


def normalise(folder: Column, relative: Column) -> Column:
    """Resolve ``relative`` against ``folder``; null when it leaves the root.

    Goes through the parts from right to left in one fold: a name is dropped if a ``..`` to its
    right still has none to drop, and a ``..`` left over marks the path as outside. Parts without
    a name, as the folder ``.``, count nothing.
    """
    parts = F.reverse(F.split(F.concat(folder, F.lit("/"), relative), "/"))
    start = F.struct(F.lit(0).alias("ups"), F.lit("").alias("path"))

    def step(acc: Column, part: Column) -> Column:
        ups, path = acc["ups"], acc["path"]
        return (
            F.when(part.isin("", "."), acc)
            .when(part == "..", F.struct((ups + 1).alias("ups"), path.alias("path")))
            .when(ups > 0, F.struct((ups - 1).alias("ups"), path.alias("path")))
            .otherwise(F.struct(ups.alias("ups"), F.concat(F.lit("/"), part, path).alias("path")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ups"] == 0, F.substr(acc["path"], F.lit(2))))
