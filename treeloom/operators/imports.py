"""Import and export extraction, and resolution of imports to files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import lookups, paths, text
from treeloom.operators.inventory import KEY

# Patterns. ``U`` makes classes Unicode. What follows the word ``import`` is looked at once, up
# to the next such word: the names on one line, then ``from`` and the module.
IMPORT_WORD = r"(?U)import(?=\s)"
IMPORT_FROM = r"""(?U)^\s(?:\s++|\s*+\S[^\n]*?(?<=\S)\s++)from\s++['"]([^'"]+)['"]"""
SCRIPT_IMPORTS = (
    r"""(?dU)require\(['"]([^'"]+)['"]\)""",
    r"""(?dU)import\(['"]([^'"]+)['"]\)""",
)
PYTHON_EXPORTS = (r"(?mdU)^\s*def\s+(\w+)", r"(?mdU)^\s*class\s+(\w+)")
SCRIPT_EXPORTS = (
    r"(?dU)export\s+(?:default\s+)?(?:function|class|const|let|var)\s+(\w+)",
    r"(?dU)export\s+\{\s*([^}]+)\s*\}",
)
# Line patterns for Python text that does not parse.
PYTHON_FALLBACK = (
    re.compile(r"^\s*import\s+([\w.]+)", re.MULTILINE),
    re.compile(r"^\s*from\s+([\w.]+)\s+import", re.MULTILINE),
)


def _all_matches(content: Column, patterns: tuple[str, ...]) -> Column:
    return F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])


def script_imports(content: Column) -> Column:
    """Distinct imports of a script: relative ones, scoped ones and anything with a slash."""
    named = F.transform(text.after(content, IMPORT_WORD), lambda t: F.regexp_extract(t, IMPORT_FROM, 1))
    found = F.transform(F.concat(named, _all_matches(content, SCRIPT_IMPORTS)), text.strip)
    kept = F.filter(found, lambda i: i.startswith(".") | i.startswith("@") | F.contains(i, F.lit("/")))
    return F.array_distinct(kept)


def _module_names(source: str | None, relative: bool) -> list[str]:
    if source is None:
        return []
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return sorted({m for pattern in PYTHON_FALLBACK for m in pattern.findall(source)})
    except (ValueError, RecursionError, MemoryError):
        return []
    names = set()
    for item in ast.walk(tree):
        if isinstance(item, ast.Import):
            names.update(alias.name for alias in item.names)
        elif isinstance(item, ast.ImportFrom):
            if relative and item.level:
                step = "." if item.level == 1 else "/".join([".."] * (item.level - 1))
                targets = [item.module] if item.module else [alias.name for alias in item.names]
                names.update(f"{step}/{t.replace('.', '/')}" for t in targets)
            elif item.module:
                names.add(item.module)
    return sorted(names)


def python_imports(content: Column, relative: bool = False) -> Column:
    """Module names of a Python text, by syntax tree.

    By default the leading dots of relative imports are lost, so they resolve to nothing;
    ``relative`` turns them into paths.
    """

    @F.pandas_udf("array<string>")
    def modules(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda source: _module_names(source, relative))

    return modules(content)


def imports(files: DataFrame, python_relative: bool = False) -> DataFrame:
    """Rows ``(repo, relative_path, import)``, distinct per file."""
    scripts = files.filter(F.col("extension").isin(*lookups.SCRIPT_SUFFIXES)).select(
        *KEY, F.explode(script_imports(F.col("content"))).alias("import")
    )
    python = files.filter(F.col("extension").isin(*lookups.PYTHON_SUFFIXES)).select(
        *KEY, F.explode(python_imports(F.col("content"), python_relative)).alias("import")
    )
    return scripts.unionByName(python)


def exports(files: DataFrame) -> DataFrame:
    """Rows ``(repo, relative_path, export)``: definitions of Python, export statements of the rest."""
    content = F.col("content")
    found = F.when(F.col("extension") == ".py", _all_matches(content, PYTHON_EXPORTS)).otherwise(
        _all_matches(content, SCRIPT_EXPORTS)
    )
    single = F.flatten(F.transform(found, lambda m: F.split(m, ",")))
    return files.select(*KEY, F.explode(F.array_distinct(F.transform(single, text.strip))).alias("export"))


def _family(extension: Column) -> Column:
    return F.when(extension.isin(*lookups.PYTHON_SUFFIXES), "python").otherwise("script")


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """Rows ``(repo, relative_path, import, target)`` for imports that name a file of the inventory.

    A relative import is tried with its last suffix replaced by each suffix of its family, then
    as a folder with an index file; the first that exists wins. Candidates differ only in the
    suffix, so files are first reduced to their best suffix per stem, and an import needs two
    equi-joins instead of one row per candidate. Target files that very many others import make
    frequent keys on the import side only, which adaptive execution splits.
    """
    ranked = [(s, "python", i) for i, s in enumerate(lookups.PYTHON_SUFFIXES)] + [
        (s, "script", i) for i, s in enumerate(lookups.SCRIPT_SUFFIXES)
    ]
    path = F.col("relative_path")
    own = paths.suffix(path)
    rank = F.create_map(*[F.lit(x) for s, _, i in ranked for x in (s, i)])
    stems = (
        files.filter(own.isin(*[s for s, _, _ in ranked]))
        .select("repo", _family(own).alias("family"), path.alias("target"), own.alias("own"))
        .withColumn("stem", F.expr("left(target, length(target) - length(own))"))
        .groupBy("repo", "family", "stem")
        .agg(F.min_by("target", rank[F.col("own")]).alias("target"))
    )
    resolved = F.col("resolved")
    asked = (
        found.filter(F.col("import").startswith("."))
        # Exploded, as a filter on it would move below it and repeat it; paths that leave the root are dropped.
        .withColumn("resolved", F.explode(F.array_compact(F.array(paths.normalise(paths.parent(path), F.col("import"))))))
        .select(
            *KEY,
            "import",
            _family(paths.extension(path)).alias("family"),
            F.when(resolved != "", F.regexp_replace(resolved, r"(?<=[^/])\.[^./]+$", "")).alias("stem"),
            F.when(resolved != "", F.concat(resolved, F.lit("/index"))).otherwise("index").alias("index_stem"),
        )
    )
    by_index = stems.select("repo", "family", F.col("stem").alias("index_stem"), F.col("target").alias("index_target"))
    return (
        asked.join(stems, ["repo", "family", "stem"], "left")
        .join(by_index, ["repo", "family", "index_stem"], "left")
        .select(*KEY, "import", F.coalesce("target", "index_target").alias("target"))
        .filter("target IS NOT NULL")
    )
