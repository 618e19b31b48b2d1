"""Inventory jobs over a ``files`` table ``(repo, relative_path, size, last_modified, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import lookups, paths

KEY = ["repo", "relative_path"]


def with_path_columns(files: DataFrame) -> DataFrame:
    """Add id, name, parent, extension, language and tree-order key."""
    path = F.col("relative_path")
    return files.withColumns(
        {
            "file_id": paths.file_id(path),
            "name": paths.name(path),
            "parent": paths.parent(path),
            "extension": paths.extension(path),
            "language": paths.language(path),
            "sort_key": paths.sort_key(path),
        }
    )


def admissible(files: DataFrame, max_file_mb: float = lookups.MAX_FILE_MB) -> DataFrame:
    """Keep what a scan would keep: no excluded folder, no hidden or lock file, size within the cap."""
    path = F.col("relative_path")
    return files.filter(
        (F.col("size") <= int(max_file_mb * 1024 * 1024))
        & ~paths.in_excluded_folder(path)
        & ~paths.is_skipped_name(path)
    )


def id_collisions(files: DataFrame) -> DataFrame:
    """Ids shared by several paths of one repository."""
    path = F.col("relative_path")
    return (
        files.groupBy("repo", paths.file_id(path).alias("file_id"))
        .agg(
            F.count("*").alias("n_paths"),
            F.min("relative_path").alias("first_path"),
            F.max("relative_path").alias("last_path"),
        )
        .filter("n_paths > 1")
    )


def latest_per_id(files: DataFrame) -> DataFrame:
    """One file per id: the last in tree order, as later files replace earlier ones."""
    path = F.col("relative_path")
    return (
        files.groupBy("repo", paths.file_id(path).alias("file_id"))
        .agg(F.max_by("relative_path", paths.sort_key(path)).alias("relative_path"))
    )


def extension_stats(files: DataFrame) -> DataFrame:
    """Files and bytes per extension; files without one are left out."""
    return (
        files.select("repo", paths.extension(F.col("relative_path")).alias("extension"), "size")
        .filter("extension <> ''")
        .groupBy("repo", "extension")
        .agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))
    )


def top_extensions(files: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent extensions over all repositories."""
    return (
        extension_stats(files)
        .groupBy("extension")
        .agg(F.sum("n_files").alias("n_files"), F.sum("total_size").alias("total_size"))
        .orderBy(F.desc("n_files"), "extension")
        .limit(k)
    )


def _fold_up(per_folder: DataFrame, sums: list[str]) -> DataFrame:
    """Add per-folder sums into every ancestor.

    Rows are folders, not files, when they are multiplied by depth; the top folder's sum is
    combined map-side.
    """
    return (
        per_folder.select("repo", F.explode(paths.ancestors(F.col("parent"))).alias("directory"), *sums)
        .groupBy("repo", "directory")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files and bytes in the whole subtree of every folder."""
    per_folder = files.groupBy("repo", paths.parent(F.col("relative_path")).alias("parent")).agg(
        F.count("*").alias("file_count"), F.sum("size").alias("total_size")
    )
    return _fold_up(per_folder, ["file_count", "total_size"]).withColumns(
        {"depth": paths.depth(F.col("directory")), "directory_id": paths.file_id(F.col("directory"))}
    )


def _folders(files: DataFrame) -> DataFrame:
    per_folder = files.select("repo", paths.parent(F.col("relative_path")).alias("parent")).distinct()
    return per_folder.select("repo", F.explode(paths.ancestors(F.col("parent"))).alias("directory")).distinct()


def corpus_totals(files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per repository: distinct file ids, distinct folder ids (top included), scan errors.

    Folders come from file paths, so a folder without files counts only if the source lists it.
    """
    ids = files.groupBy("repo").agg(F.countDistinct(paths.file_id(F.col("relative_path"))).alias("total_files"))
    dirs = (
        _folders(files).groupBy("repo").agg(F.countDistinct(paths.file_id(F.col("directory"))).alias("total_dirs"))
    )
    out = ids.join(dirs, "repo")
    if errors is None:
        return out.withColumn("errors", F.lit(0).cast("long"))
    bad = errors.groupBy("repo").agg(F.count("*").alias("errors"))
    return out.join(bad, "repo", "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("long")))


def _flagged(files: DataFrame, selection: DataFrame) -> DataFrame:
    marks = selection.select(*KEY).distinct().withColumn("selected", F.lit(True))
    return files.join(marks, KEY, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def selection_totals(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Distinct selected files and their bytes."""
    chosen = files.join(selection.select(*KEY).distinct(), KEY, "left_semi")
    return chosen.groupBy("repo").agg(F.count("*").alias("selected_files"), F.sum("size").alias("selected_size"))


def selected_per_extension(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected and all files per extension."""
    return (
        _flagged(files.select(*KEY, paths.extension(F.col("relative_path")).alias("extension")), selection)
        .filter("extension <> ''")
        .groupBy("repo", "extension")
        .agg(F.count_if("selected").alias("n_selected"), F.count("*").alias("n_files"))
    )


def extension_visible(chosen: list[str]) -> Column:
    """Predicate of the extension filter; no choice or ``all`` shows everything."""
    if not chosen or "all" in chosen:
        return F.lit(True)
    return paths.extension(F.col("relative_path")).isin(*chosen)


def extension_filter(files: DataFrame, chosen: list[str]) -> DataFrame:
    """Keep the files of the chosen extensions."""
    return files.filter(extension_visible(chosen))


def selected_per_directory(files: DataFrame, selection: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """Selected and visible files in the subtree of every folder."""
    visible = extension_filter(files.select(*KEY), chosen or [])
    per_folder = (
        _flagged(visible, selection)
        .groupBy("repo", paths.parent(F.col("relative_path")).alias("parent"))
        .agg(F.count_if("selected").alias("n_selected"), F.count("*").alias("n_visible"))
    )
    return _fold_up(per_folder, ["n_selected", "n_visible"])


def directory_states(files: DataFrame, selection: DataFrame, empty_dirs: DataFrame | None = None) -> DataFrame:
    """``selected``, ``none`` or ``indeterminate`` per folder.

    A folder without any file is never selected and keeps the folders above it from being so.
    """
    per_folder = (
        _flagged(files.select(*KEY), selection)
        .groupBy("repo", paths.parent(F.col("relative_path")).alias("parent"))
        .agg(F.count_if("selected").alias("n_selected"), F.count("*").alias("n_files"))
        .withColumn("n_empty", F.lit(0).cast("long"))
    )
    if empty_dirs is not None:
        zero = F.lit(0).cast("long")
        per_folder = per_folder.unionByName(
            empty_dirs.select(
                "repo", F.col("directory").alias("parent"), zero.alias("n_selected"), zero.alias("n_files"),
                F.lit(1).cast("long").alias("n_empty"),
            )
        )
    state = (
        F.when(F.col("n_selected") == 0, "none")
        .when((F.col("n_selected") == F.col("n_files")) & (F.col("n_empty") == 0), "selected")
        .otherwise("indeterminate")
    )
    return _fold_up(per_folder, ["n_selected", "n_files", "n_empty"]).select("repo", "directory", state.alias("state"))


def expanded_directories(hits: DataFrame) -> DataFrame:
    """Folders that contain a hit somewhere below."""
    return _folders(hits)


def flat_listing(files: DataFrame) -> DataFrame:
    """Id, path, extension and size of every file."""
    path = F.col("relative_path")
    return files.select(
        "repo", paths.file_id(path).alias("file_id"), "relative_path", paths.extension(path).alias("extension"), "size"
    )


def flatten_nested(trees: DataFrame) -> DataFrame:
    """File rows of stored nested folder records ``tree(files, children(files, children ...))``, to the depth of the schema."""
    node = trees.schema["tree"].dataType
    nodes, out = trees.select("repo", F.col("tree").alias("node")), None
    while True:
        rows = nodes.select("repo", F.explode("node.files").alias("f")).select("repo", "f.*")
        out = rows if out is None else out.unionByName(rows)
        if "children" not in node.names:
            return out
        node = node["children"].dataType.elementType
        nodes = nodes.select("repo", F.explode("node.children").alias("node"))


def tree_order(files: DataFrame) -> DataFrame:
    """Files in tree order: range-partitioned by the path key, so no single task sorts all."""
    return files.orderBy("repo", paths.sort_key(F.col("relative_path")))


def preview(files: DataFrame) -> DataFrame:
    """First characters of each file small enough to preview."""
    head = F.substring("content", 1, lookups.PREVIEW_CHARS)
    cut = F.length("content") >= lookups.PREVIEW_CHARS
    return files.filter(F.col("size") <= lookups.PREVIEW_MAX_BYTES).select(
        *KEY, F.when(cut, F.concat(head, F.lit("\n\n... (truncated)"))).otherwise(head).alias("preview")
    )


# Selection edits --------------------------------------------------------------------------------


def add_to_selection(selection: DataFrame, more: DataFrame) -> DataFrame:
    """Selection with further files."""
    return selection.select(*KEY).union(more.select(*KEY)).distinct()


def remove_from_selection(selection: DataFrame, gone: DataFrame) -> DataFrame:
    """Selection without the given files."""
    return selection.select(*KEY).distinct().join(gone.select(*KEY).distinct(), KEY, "left_anti")


def combine_selection(selection: DataFrame, result: DataFrame, mode: str = "add") -> DataFrame:
    """Apply a selection result: ``replace`` drops what was selected, ``add`` keeps it."""
    if mode == "replace":
        return result.select(*KEY).distinct()
    if mode == "add":
        return add_to_selection(selection, result)
    raise ValueError(f"unknown mode {mode!r}")


def subtree(files: DataFrame, folder: str) -> DataFrame:
    """Files below a folder, for selecting or clearing it as a whole."""
    picked = files if folder == "." else files.filter(F.col("relative_path").startswith(folder + "/"))
    return picked.select(*KEY)


def validate_ids(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requested ids ``(request_id, position, repo, file_id)`` that exist; duplicates are kept."""
    known = files.select("repo", paths.file_id(F.col("relative_path")).alias("file_id")).distinct()
    return requests.join(known, ["repo", "file_id"], "left_semi")
