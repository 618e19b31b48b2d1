"""The import graph: edges ``(repo, src, dst)``, missing files, degrees, metrics, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import paths
from treeloom.operators.inventory import KEY


def _marks(selection: DataFrame, column: str) -> DataFrame:
    return selection.select("repo", F.col("relative_path").alias(column)).distinct()


def edges(resolved: DataFrame, selection: DataFrame) -> DataFrame:
    """One edge per import between two selected files; repeated targets are kept, loops are not."""
    return (
        resolved.select("repo", F.col("relative_path").alias("src"), F.col("target").alias("dst"))
        .filter("src <> dst")
        .join(_marks(selection, "src"), ["repo", "src"], "left_semi")
        .join(_marks(selection, "dst"), ["repo", "dst"], "left_semi")
    )


def missing(resolved: DataFrame, selection: DataFrame) -> DataFrame:
    """Imports of selected files whose target is not selected, one row per import string.

    Resolution found the file, so the suggestion is always that file with full confidence.
    """
    return (
        resolved.join(_marks(selection, "relative_path"), KEY, "left_semi")
        .join(_marks(selection, "target"), ["repo", "target"], "left_anti")
        .select(
            "repo",
            F.col("relative_path").alias("required_by"),
            F.col("import").alias("missing_import"),
            F.col("target").alias("suggested_file"),
            F.lit(1.0).alias("confidence"),
            F.lit("Exact path match found").alias("reason"),
        )
    )


def nodes(selected_files: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Selected files with degrees; an entry has no dependents, a leaf no dependencies."""
    out = edge_rows.groupBy("repo", F.col("src").alias("relative_path")).agg(F.count("*").alias("n_dependencies"))
    into = edge_rows.groupBy("repo", F.col("dst").alias("relative_path")).agg(F.count("*").alias("n_dependents"))
    zero = F.lit(0).cast("long")
    return (
        selected_files.select(*KEY)
        .distinct()
        .join(out, KEY, "left")
        .join(into, KEY, "left")
        .withColumns(
            {
                "n_dependencies": F.coalesce("n_dependencies", zero),
                "n_dependents": F.coalesce("n_dependents", zero),
            }
        )
        .withColumns(
            {
                "file_type": paths.extension(F.col("relative_path")),
                "label": paths.name(F.col("relative_path")),
                "is_entry_point": F.col("n_dependents") == 0,
                "is_leaf": F.col("n_dependencies") == 0,
            }
        )
    )


def metrics(node_rows: DataFrame) -> DataFrame:
    """One row per repository: counts, mean and maximum degree, the most depended-on file, coupling."""
    n = F.count("*")
    total = F.sum("n_dependencies")
    possible = n * (n - 1)
    order = F.struct(-F.col("n_dependents"), paths.sort_key(F.col("relative_path")))
    return node_rows.groupBy("repo").agg(
        n.alias("total_files"),
        F.count_if("is_entry_point").alias("entry_points"),
        F.count_if("is_leaf").alias("leaf_nodes"),
        F.round(total / n, 2).alias("average_dependencies"),
        F.max("n_dependencies").alias("max_dependencies"),
        F.min_by("relative_path", order).alias("most_dependent_file"),
        F.max("n_dependents").alias("dependent_count"),
        F.when(n > 1, F.round(total / possible * 100, 2)).otherwise(0.0).alias("coupling_score"),
    )


def completeness_score(n_selected: Column, n_missing: Column) -> Column:
    """Selected in percent of selected and missing; zero when nothing is selected."""
    return F.when(n_selected > 0, F.round(n_selected / (n_selected + n_missing) * 100, 2)).otherwise(0.0)


def completeness_band(score: Column) -> Column:
    """Display band of a completeness score."""
    return F.when(score >= 90, "high").when(score >= 70, "medium").otherwise("low")


def completeness(requested: DataFrame, missing_rows: DataFrame) -> DataFrame:
    """Score per repository. Every requested row counts, also unknown or repeated ones."""
    asked = requested.groupBy("repo").agg(F.count("*").alias("n_selected"))
    lacking = missing_rows.groupBy("repo").agg(F.count("*").alias("n_missing"))
    both = asked.join(lacking, "repo", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0).cast("long")))
    score = completeness_score(F.col("n_selected"), F.col("n_missing"))
    return both.select(
        "repo", "n_selected", "n_missing", score.alias("completeness_score"), completeness_band(score).alias("band")
    )


def role_filter(node_rows: DataFrame, edge_rows: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a role (``all``, ``entry``, ``leaf``) and the edges with both ends among them."""
    flags = {"all": F.lit(True), "entry": F.col("is_entry_point"), "leaf": F.col("is_leaf")}
    kept = node_rows.filter(flags[role])
    if role == "all":
        return kept, edge_rows
    both = edge_rows.join(_marks(kept, "src"), ["repo", "src"], "left_semi").join(
        _marks(kept, "dst"), ["repo", "dst"], "left_semi"
    )
    return kept, both


def search_nodes(node_rows: DataFrame, query: str) -> DataFrame:
    """Nodes whose path contains the text, ignoring case; the label is the end of the path."""
    return node_rows.filter(F.contains(F.lower("relative_path"), F.lit(query.lower())))


def neighbourhood(edge_rows: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges that touch a focus node ``(repo, node)``, as rows ``(repo, node, src, dst)``."""
    out = edge_rows.join(focus.withColumn("src", F.col("node")), ["repo", "src"])
    into = edge_rows.join(focus.withColumn("dst", F.col("node")), ["repo", "dst"])
    columns = ["repo", "node", "src", "dst"]
    return out.select(columns).union(into.select(columns)).distinct()


def neighbour_labels(edge_rows: DataFrame, node_rows: DataFrame, k: int = 5) -> DataFrame:
    """Per node and side the first ``k`` neighbour labels and how many more there are.

    The rank filter runs on each map side first, so a node with very many neighbours sends only
    ``k`` labels per task; the count is a partial aggregate.
    """
    sides = edge_rows.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit("dependencies").alias("side"), F.col("dst").alias("other")),
                F.struct(F.col("dst").alias("node"), F.lit("dependents").alias("side"), F.col("src").alias("other")),
            )
        ).alias("s"),
    ).select("repo", "s.*")
    known = node_rows.select("repo", F.col("relative_path").alias("other"), "label")
    labelled = sides.join(known, ["repo", "other"], "left").withColumn("label", F.coalesce("label", "other"))
    group = ["repo", "node", "side"]
    totals = sides.groupBy(*group).agg(F.count("*").alias("n"))
    first = Window.partitionBy(*group).orderBy("label", "other")
    shown = (
        labelled.withColumn("r", F.row_number().over(first))
        .filter(F.col("r") <= k)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("r", "label"))).alias("top"))
    )
    return shown.join(totals, group).select(
        *group,
        F.transform("top", lambda t: t["label"]).alias("labels"),
        F.greatest(F.col("n") - k, F.lit(0)).alias("n_more"),
    )


def graph_export(node_rows: DataFrame, edge_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows in the exchange layout."""
    out_nodes = node_rows.select(
        "repo",
        paths.file_id(F.col("relative_path")).alias("id"),
        "label",
        F.col("relative_path").alias("path"),
        F.col("file_type").alias("type"),
        "is_entry_point",
        "is_leaf",
        F.col("n_dependencies").alias("dependency_count"),
        F.col("n_dependents").alias("dependent_count"),
    )
    out_edges = edge_rows.select(
        "repo", paths.file_id(F.col("src")).alias("source"), paths.file_id(F.col("dst")).alias("target")
    )
    return out_nodes, out_edges
