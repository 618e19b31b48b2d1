"""Diagram checks over lines ``(diagram_id, line_no, line)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.text import count_of, strip
from treeloom.operators.scans import unmatched_closers

# Patterns.
NODE_ID = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
NODE_DEFINITION = r"^([a-zA-Z_][a-zA-Z0-9_]*)(?:\[.*?\]|\(.*?\)|\{.*?\})"
ARROW = r"([^-\s]*)\s*-{1,3}>\s*(.+)$"
SUBGRAPH = r"subgraph\s+([^\[]+)"
CLASS_PROPERTIES = r"classDef\s+\w+\s+(.+)$"
STROKE_WIDTH = r"stroke-width:\s*(\d+(?:\.\d+)?)(px)?"
COLOR = r"(?:fill|stroke):\s*(#[0-9a-fA-F]{6}|#[0-9a-fA-F]{3}|[a-zA-Z]+)"
# A node is a word with its bracket, a stretch up to a closing bracket, or a word; the second can
# only occur up to the last closing bracket, so the text is counted in two parts.
STATISTIC_HEAD = r"\w+\[|[^\]]+\]"
STATISTIC_TAIL = r"\w+"
STATISTIC_CONNECTION = r"-->|--|<-|\.\."
SHOWN_NODES = 5

LINE = ["diagram_id", "line_no"]


def blocks(documents: DataFrame, key: list[str], column: str) -> DataFrame:
    """Fenced diagrams of each document with their index, trimmed."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"```mermaid\n([\s\S]*?)```"), F.lit(1))
    return documents.select(*key, F.posexplode(found).alias("block", "diagram")).withColumn(
        "diagram", strip(F.col("diagram"))
    )


def to_lines(diagrams: DataFrame, key: list[str], column: str) -> DataFrame:
    """Numbered lines of each diagram, counted from one."""
    return diagrams.select(*key, F.posexplode(F.split(column, "\n")).alias("at", "line")).select(
        *key, (F.col("at") + 1).alias("line_no"), "line"
    )


def _checked(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    return lines.select(*LINE, strip(F.col("line")).alias("line")).filter("line <> '' AND NOT startswith(line, '%%')")


def _problems(df: DataFrame, tests: list[tuple[Column, Column]]) -> DataFrame:
    shown = F.array_compact(F.array(*[F.when(test, message) for test, message in tests]))
    return df.select(*LINE, F.explode(shown).alias("problem"))


def strict_lint(lines: DataFrame) -> DataFrame:
    """Problems that keep a diagram from being drawn, one row each."""
    line = F.col("line")
    styled = line.startswith("classDef ")
    rest = F.regexp_replace(line, r"^classDef\s+\w+\s+", "")

    def has(piece: str) -> Column:
        return F.contains(line, F.lit(piece))

    return _problems(
        _checked(lines),
        [
            (styled & line.endswith(","), F.lit("classDef statement ends with trailing comma")),
            (styled & rest.endswith(","), F.lit("classDef properties end with trailing comma")),
            (line.rlike("classDef.*classDef"), F.lit("Multiple classDef statements on same line - need line breaks")),
            (has("-->") & ~has(" "), F.lit("Arrow syntax needs spaces around operators")),
            (has("[") & ~has("]"), F.lit("Unclosed square brackets")),
            (has("(") & ~has(")"), F.lit("Unclosed parentheses")),
        ],
    )


def _is_subgraph(line: Column) -> Column:
    return line.startswith("subgraph ")


def _statements(lines: DataFrame) -> DataFrame:
    """Checked lines that are neither chart headers nor block lines."""
    return _checked(lines).filter(
        ~F.col("line").startswith("pie") & ~_is_subgraph(F.col("line")) & (F.col("line") != "end")
    )


def _block_lines(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return (
        _checked(lines)
        .withColumn("delta", F.when(_is_subgraph(line), 1).when(line == "end", -1))
        .filter("delta IS NOT NULL")
        .select(*LINE, "delta")
    )


def unmatched_ends(lines: DataFrame) -> DataFrame:
    """``end`` lines without a block to close."""
    return unmatched_closers(_block_lines(lines), ["diagram_id"], "line_no", "delta").select(*LINE)


def unclosed_blocks(lines: DataFrame) -> DataFrame:
    """Block lines never closed: the same rule read from the last line backwards."""
    mirrored = _block_lines(lines).select(
        "diagram_id", (-F.col("line_no")).alias("line_no"), (-F.col("delta")).alias("delta")
    )
    return unmatched_closers(mirrored, ["diagram_id"], "line_no", "delta").select(
        "diagram_id", (-F.col("line_no")).alias("line_no")
    )


def definitions(lines: DataFrame) -> DataFrame:
    """Node definitions ``(diagram_id, line_no, node)``."""
    node = F.regexp_extract("line", NODE_DEFINITION, 1)
    return _statements(lines).select(*LINE, node.alias("node")).filter("node <> ''")


def first_definitions(lines: DataFrame) -> DataFrame:
    """First line of each node; combined map-side, so a node defined very often is no hot spot."""
    return definitions(lines).groupBy("diagram_id", "node").agg(F.min("line_no").alias("first_line"))


def duplicate_nodes(lines: DataFrame) -> DataFrame:
    """Second and later definitions of a node."""
    return (
        definitions(lines)
        .join(first_definitions(lines), ["diagram_id", "node"])
        .filter("line_no > first_line")
        .select(*LINE, "node")
    )


def _arrows(lines: DataFrame) -> DataFrame:
    target = strip(F.regexp_extract("line", ARROW, 2))
    return (
        _statements(lines)
        .filter(F.col("line").rlike(ARROW))
        .select(
            *LINE,
            strip(F.regexp_extract("line", ARROW, 1)).alias("source"),
            F.regexp_extract(target, r"^\S+", 0).alias("target"),
        )
    )


def _known_names(lines: DataFrame) -> DataFrame:
    """Names an arrow end may use: a node, or a numbered node without its number."""
    base = F.regexp_extract("node", r"^(.*)_\d+$", 1)
    names = F.when(F.col("node").rlike(r"_\d+$"), F.array("node", base)).otherwise(F.array("node"))
    return (
        first_definitions(lines)
        .select("diagram_id", F.explode(names).alias("name"), "first_line")
        .groupBy("diagram_id", "name")
        .agg(F.min("first_line").alias("first_line"))
    )


def undefined_ends(lines: DataFrame) -> DataFrame:
    """Arrow ends not defined on the same or an earlier line: ``(.., side, name, available)``.

    Every such source counts; a target counts only when it is not a plain name. ``available``
    shows the first nodes known at that line.
    """
    arrows = _arrows(lines)
    end = F.explode(
        F.array(
            F.struct(F.lit("source").alias("side"), F.col("source").alias("name")),
            F.struct(F.lit("target").alias("side"), F.col("target").alias("name")),
        )
    )
    ends = arrows.select(*LINE, end.alias("e")).select(*LINE, "e.*")
    doubtful_target = (F.col("name") != "") & F.col("name").rlike("^[a-zA-Z_]") & ~F.col("name").rlike(NODE_ID)
    unknown = (
        ends.filter((F.col("side") == "source") | doubtful_target)
        .join(_known_names(lines), ["diagram_id", "name"], "left")
        .filter("first_line IS NULL OR first_line > line_no")
        .drop("first_line")
    )
    early = Window.partitionBy("diagram_id").orderBy("first_line")
    first_nodes = (
        first_definitions(lines)
        .withColumn("r", F.row_number().over(early))
        .filter(F.col("r") <= SHOWN_NODES + 1)
        .groupBy("diagram_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("first_line").cast("long").alias("first_line"), "node"))).alias("first_nodes"))
    )
    none = F.array().cast("array<struct<first_line:bigint,node:string>>")
    seen = F.filter(F.coalesce("first_nodes", none), lambda n: n["first_line"] <= F.col("line_no"))
    listed = F.array_join(F.slice(F.transform(seen, lambda n: n["node"]), 1, SHOWN_NODES), ", ")
    more = F.when(F.size(seen) > SHOWN_NODES, "...").otherwise("")
    return unknown.join(first_nodes, "diagram_id", "left").select(
        *LINE, "side", "name", F.concat(listed, more).alias("available")
    )


def _line_tests(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    pairs = (("brackets", "[", "]"), ("parentheses", "(", ")"), ("braces", "{", "}"))
    tests = [(count_of(line, o) != count_of(line, c), F.lit(f"Unmatched {label}")) for label, o, c in pairs]
    properties = F.regexp_extract(line, CLASS_PROPERTIES, 1)
    trailing = line.startswith("classDef ") & properties.endswith(",")
    tests.append((trailing, F.lit("classDef statement has trailing comma - remove the comma at the end")))
    tests.append((trailing, F.concat(F.lit("  Current:  "), line)))
    tests.append((trailing, F.concat(F.lit("  Fix:      "), F.expr("left(line, length(line) - 1)"))))
    tests.append((trailing, F.lit("Suggested complete fix:")))
    tests.append((trailing, F.concat(F.lit("  Fixed:    "), F.expr("left(line, length(line) - 1)"))))
    return _problems(_statements(lines), tests)


def _property_tests(lines: DataFrame) -> DataFrame:
    properties = F.regexp_extract("line", CLASS_PROPERTIES, 1)
    rows = (
        _statements(lines)
        .filter(F.col("line").startswith("classDef ") & F.col("line").rlike(CLASS_PROPERTIES))
        .select(*LINE, F.explode(F.split(properties, ",")).alias("p"))
        .withColumn("p", strip(F.col("p")))
        .filter("p <> ''")
    )
    p = F.col("p")

    def has(piece: str) -> Column:
        return F.contains(p, F.lit(piece))

    return _problems(
        rows,
        [
            (~has(":"), F.concat(F.lit("Incomplete property '"), p, F.lit("' in classDef - missing value after colon"))),
            (
                has("stroke-width:") & ~p.rlike(STROKE_WIDTH),
                F.lit("Invalid stroke-width format - should be 'stroke-width:2px' or 'stroke-width:2'"),
            ),
            (
                (has("fill:") | has("stroke:")) & ~p.rlike(COLOR),
                F.concat(F.lit("Invalid color format in '"), p, F.lit("' - use hex (#ff0000) or named colors (red)")),
            ),
        ],
    )


def _header_tests(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    unclear = (
        line.startswith("pie") & F.contains(line, F.lit("-->")) & F.contains(line, F.lit("graph"))
        & ~F.contains(line, F.lit("TD")) & ~F.contains(line, F.lit("LR"))
    )
    name = strip(F.regexp_extract(line, SUBGRAPH, 1))
    bad_name = _is_subgraph(line) & line.rlike(SUBGRAPH) & ~name.rlike(NODE_ID)
    return _problems(
        _checked(lines),
        [
            (unclear, F.lit("Graph direction might be unclear")),
            (bad_name & ~line.startswith("pie"), F.lit("Subgraph name contains invalid characters")),
        ],
    )


def detailed_lint(lines: DataFrame) -> DataFrame:
    """All warnings of the detailed check, one row each."""
    ends = unmatched_ends(lines).select(*LINE, F.lit("'end' without matching 'subgraph'").alias("problem"))
    unclosed = unclosed_blocks(lines).select(*LINE, F.lit("Unclosed subgraph").alias("problem"))
    repeated = duplicate_nodes(lines).select(
        *LINE, F.concat(F.lit("Duplicate node ID '"), "node", F.lit("'")).alias("problem")
    )
    undefined = undefined_ends(lines).select(
        *LINE,
        F.concat(
            F.lit("Undefined "), "side", F.lit(" node '"), "name", F.lit("'. Available nodes: "), "available"
        ).alias("problem"),
    )
    parts = [_header_tests(lines), ends, unclosed, repeated, undefined, _line_tests(lines), _property_tests(lines)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def statistics(diagrams: DataFrame, key: list[str], column: str) -> DataFrame:
    """Word-like pieces, connectors and a size level per diagram, in linear time."""
    code = F.col(column)
    tail = F.substring_index(code, "]", -1)
    head = F.left(code, F.length(code) - F.length(tail))
    nodes = F.regexp_count(head, F.lit(STATISTIC_HEAD)) + F.regexp_count(tail, F.lit(STATISTIC_TAIL))
    level = F.when(nodes > 20, "High").when(nodes > 10, "Medium").otherwise("Low")
    return diagrams.select(
        *key,
        nodes.alias("n_nodes"),
        F.regexp_count(code, F.lit(STATISTIC_CONNECTION)).alias("n_connections"),
        level.alias("complexity"),
    )
