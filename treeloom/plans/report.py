"""End-to-end jobs made of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators import graph, imports, reach
from treeloom.operators.inventory import KEY
from treeloom.session import stage
from treeloom.sources import tables


def dependency_report(
    files: DataFrame, requested: DataFrame, max_cycle_len: int | None = None, python_relative: bool = False
) -> dict[str, DataFrame]:
    """Nodes, edges, missing files, cycles, metrics and completeness of a selection.

    No stage holds content: what is staged are the selected paths, the imports, and these resolved and
    split into edges and missing rows.
    """
    content = files.join(requested.select(*KEY).distinct(), KEY, "left_semi")
    selected = stage(content.drop("content"))
    imported = stage(imports.imports(content, python_relative))
    resolved = stage(imports.resolve(imported, files.select(*KEY)))
    edge_rows = stage(graph.edges(resolved, selected))
    node_rows = graph.nodes(selected, edge_rows)
    lacking = graph.missing(resolved, selected)
    cycle_rows, truncated = reach.cycles(edge_rows, max_cycle_len)
    return {
        "nodes": node_rows,
        "imports": imported,
        "exports": imports.exports(content),
        "edges": edge_rows,
        "missing": lacking,
        "cycles": cycle_rows.withColumn("truncated", F.lit(truncated)),
        "metrics": graph.metrics(node_rows),
        "completeness": graph.completeness(requested, lacking),
    }


def save_report(parts: dict[str, DataFrame], path: str, analysis_id: str) -> None:
    """Write all parts of a report under one id."""
    tables.write_snapshot(parts, path, analysis_id)
