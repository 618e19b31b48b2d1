"""Structure of source files as long tables and per-file summaries.

Everything is a column expression on the file's own row, so no job here shuffles content. The
one exception to built-in expressions is the brace-matched function body, which runs as one
Arrow-batched call per file.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import paths, text
from treeloom.operators.inventory import KEY

# Patterns of the script summary.
JS_FUNCTION = re.compile(r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)\s*{")
JS_ARROW = re.compile(r"const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")
JS_LISTENER = r"""(?U)(\w+)\.addEventListener\(['"](\w+)['"],"""
JS_FETCH = r"""fetch\(['"]([^'"]+)['"]"""
JS_DOM = r"""document\.(?:getElementById|querySelector(?:All)?)\(['"]([^'"]+)['"]"""

# Patterns of the style summary.
CSS_COLOR = r"(#[0-9a-fA-F]{3,6}|rgba?\([^)]+\))"
CSS_RULE = r"(?U)\.([a-zA-Z0-9_-]+)\s*\{([^}]+)\}"
CSS_MEDIA = r"(?U)@media\s*([^{]+)"
CSS_REM = r"(?U)(\d+(?:\.\d+)?rem)"

# Patterns of the Python summary. The first group is the indented block that starts
# at the match, up to the next line that begins with a visible character.
_BLOCK = r"(?=([^\n]*+(?:\n(?!\S)[^\n]*+)*+))"
PY_CLASS = r"(?U)(?=class\s)" + _BLOCK + r"class\s+(\w+)(?:\([^)]*\))?:"
PY_METHOD = r"(?U)(?=def\s)" + _BLOCK + r"def\s+(\w+)\s*\([^)]*\):"
PY_ROUTE = r"(?U)(?=@app)" + _BLOCK + r"""@app\.route\(['"]([^'"]+)['"]"""
PY_IMPORT = r"(?U)(?:from\s+[\w.]+\s+)?import\s+([\w,\s]+)"
PY_ATTRIBUTE = r"(?U)self\.(\w+)\s*="

# Patterns of the page summary.
HTML_TAG = r"(?U)<(\w+)"
HTML_SCRIPT = ("<script", r"""^[^>]*src=['"]([^'"]+)['"]""")
HTML_LINK = ("<link", r"""^[^>]*href=['"]([^'"]+)['"]""")

# Languages per extractor; all others get the generic summary.
SCRIPT_LANGUAGES = ("javascript", "js", "jsx")

# Flow and logic tags in their order, with the words that show them.
FLOW_TAGS = (
    ("conditional", "if"),
    ("async_call", "fetch|await"),
    ("iteration", "forEach|map|filter|reduce"),
    ("return", "return"),
    ("error_handling", "try"),
)
LOGIC_TAGS = (
    ("loop", "for|while"),
    ("conditional", "if"),
    ("error_handling", "try"),
    ("return", "return"),
    ("generator", "yield"),
    ("async", "async|await"),
)


def targets(content: Column, pattern: tuple[str, str]) -> Column:
    """The values of an attribute in all tags of a kind; each tag's text is looked at once."""
    tag, value = pattern
    found = F.transform(text.after(content, tag), lambda t: F.regexp_extract(t, value, 1))
    return F.filter(found, lambda v: v != "")


def extract(content: Column, pattern: str, group: int = 1) -> Column:
    """All matches of one group, in order."""
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def _first(content: Column, pattern: str, limit: int) -> Column:
    """First match, stripped and cut; null when there is none."""
    found = F.regexp_extract(content, pattern, 1)
    return F.when(content.rlike(pattern), F.substring(text.strip(found), 1, limit))


def _pairs(content: Column, pattern: str, name_group: int, value_group: int) -> Column:
    """Array of ``(name, value)`` from two groups of one pattern."""
    return F.zip_with(
        extract(content, pattern, name_group),
        extract(content, pattern, value_group),
        lambda n, v: F.struct(n.alias("name"), v.alias("value")),
    )


def _keep_last(df: DataFrame, column: str) -> DataFrame:
    """Of array entries with one name keep the last: sort by name and position, compare neighbours."""
    ordered = f"{column}_ordered"
    indexed = F.transform(
        column, lambda x, i: F.struct(x["name"].alias("name"), i.alias("at"), x.alias("entry"))
    )
    df = df.withColumn(ordered, F.array_sort(indexed))
    last = F.filter(ordered, lambda x, i: F.coalesce(F.get(F.col(ordered), i + 1)["name"] != x["name"], F.lit(True)))
    return df.withColumn(column, F.transform(last, lambda x: x["entry"])).drop(ordered)


# Shared text rules -------------------------------------------------------------------------------


def purpose(code: Column) -> Column:
    """First block comment, else first line comment, else a default."""
    return F.coalesce(
        _first(code, r"(?U)/\*\*?\s*([^\n*]+)", 100), _first(code, r"(?dU)//\s*(.+)", 100), F.lit("Processing logic")
    )


def docstring(code: Column) -> Column:
    """First docstring, else first comment, else empty."""
    return F.coalesce(_first(code, r'"""([^"]+)"""', 150), _first(code, r"(?dU)#\s*(.+)", 150), F.lit(""))


def _tags(code: Column, tags, limit: int, separator: str, default: str) -> Column:
    shown = F.array_compact(F.array(*[F.when(code.rlike(rf"(?U)\b({w})\b"), F.lit(t)) for t, w in tags]))
    return F.when(F.size(shown) > 0, F.array_join(F.slice(shown, 1, limit), separator)).otherwise(default)


def flow(code: Column) -> Column:
    """Flow tags joined with arrows."""
    return _tags(code, FLOW_TAGS, len(FLOW_TAGS), " → ", "simple_execution")


def logic(code: Column) -> Column:
    """Up to four logic tags."""
    return _tags(code, LOGIC_TAGS, 4, " + ", "simple_processing")


def http_method(code: Column) -> Column:
    """Method named by a route."""

    def named(method: str) -> Column:
        return F.contains(code, F.lit(f"methods=['{method}']"))

    return (
        F.when(named("POST") | F.contains(code, F.lit("method: 'POST'")), "POST")
        .when(named("GET"), "GET")
        .when(named("PUT"), "PUT")
        .when(named("DELETE"), "DELETE")
        .otherwise("GET")
    )


def return_type(code: Column) -> Column:
    """Kind of response a route gives."""

    def has(word: str) -> Column:
        return F.contains(code, F.lit(word))

    return (
        F.when(has("jsonify"), "JSON")
        .when(has("send_file"), "File")
        .when(has("render_template"), "HTML")
        .when(has("redirect"), "Redirect")
        .otherwise("Unknown")
    )


# Scripts -----------------------------------------------------------------------------------------


class _Braces:
    """Brace positions of one text, indexed so that each block end is a binary search."""

    def __init__(self, source: str):
        self.at, self.depth, self.opens = [], [], []
        self.closing = defaultdict(list)
        level = 0
        for hit in re.finditer("[{}]", source):
            i = len(self.at)
            self.at.append(hit.start())
            if hit.group() == "{":
                level += 1
                self.opens.append(i)
            else:
                level -= 1
                self.closing[level].append(i)
            self.depth.append(level)

    def end_of_block(self, start: int) -> int:
        """End of the first balanced block after ``start``; ``start`` itself if none closes."""
        i = bisect_left(self.at, start)
        k = bisect_left(self.opens, i)
        if k == len(self.opens):
            return start
        outer = self.depth[i - 1] if i else 0
        ends = self.closing[outer]
        j = bisect_right(ends, self.opens[k])
        return self.at[ends[j]] + 1 if j < len(ends) else start


def _script_functions(source: str | None) -> list[dict]:
    if not source:
        return []
    braces = _Braces(source)
    found = {}
    for hit in JS_FUNCTION.finditer(source):
        kind = "async" if "async" in hit.group() else "sync"
        body = source[hit.start() : braces.end_of_block(hit.start())]
        found[hit.group(1)] = {"name": hit.group(1), "kind": kind, "body": body}
    for hit in JS_ARROW.finditer(source):
        found[hit.group(1)] = {"name": hit.group(1), "kind": "arrow", "body": None}
    return list(found.values())


_FUNCTIONS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "kind", "body")]))


@F.pandas_udf(_FUNCTIONS)
def script_functions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Functions of each script with their bodies; of one name the last counts."""
    for batch in batches:
        yield batch.map(_script_functions, na_action=None)


def _function_facts(f: Column) -> Column:
    plain = f["kind"] != "arrow"
    body = f["body"]
    return F.struct(
        f["kind"].alias("type"),
        F.when(plain, purpose(body)).otherwise("Arrow function").alias("purpose"),
        F.when(plain, extract(body, JS_FETCH)).alias("api_calls"),
        F.when(plain, extract(body, JS_DOM)).alias("dom_interactions"),
        F.when(plain, flow(body)).alias("flow"),
        F.when(plain, text.line_count(body)).otherwise(1).alias("lines"),
    )


def is_script(path: Column) -> Column:
    """Files that get the script summary."""
    return paths.language(path).isin(*SCRIPT_LANGUAGES)


def js_functions(files: DataFrame) -> DataFrame:
    """One row per function of a script."""
    return (
        files.filter(is_script(F.col("relative_path")))
        .select(*KEY, F.explode(script_functions("content")).alias("f"))
        .select(*KEY, F.col("f.name").alias("name"), _function_facts(F.col("f")).alias("facts"))
        .select(*KEY, "name", "facts.*")
    )


def _handlers(content: Column) -> Column:
    return F.transform(_pairs(content, JS_LISTENER, 1, 2), lambda p: F.concat(p["name"], F.lit("→"), p["value"]))


def _globals(content: Column) -> Column:
    head = F.when(
        F.contains(content, F.lit("function")), F.substring_index(content, "function", 1)
    ).otherwise(F.substring(content, 1, 1000))
    names = F.concat(extract(head, r"(?U)\blet\s+(\w+)"), extract(head, r"(?U)\bconst\s+(\w+)"))
    return F.slice(F.array_sort(F.array_distinct(names)), 1, 15)


def js_event_handlers(files: DataFrame) -> DataFrame:
    """Rows ``target→event`` in order of appearance."""
    return files.filter(is_script(F.col("relative_path"))).select(
        *KEY, F.posexplode(_handlers(F.col("content"))).alias("position", "handler")
    )


def js_globals(files: DataFrame) -> DataFrame:
    """Up to 15 global names of each script, in name order."""
    return files.filter(is_script(F.col("relative_path"))).select(*KEY, F.explode(_globals(F.col("content"))).alias("name"))


# Styles ------------------------------------------------------------------------------------------


def _styles(files: DataFrame) -> DataFrame:
    return files.filter(paths.language(F.col("relative_path")) == "css")


def _rule_facts(props: Column) -> Column:
    spaced = F.contains(props, F.lit("padding")) | F.contains(props, F.lit("margin"))
    return F.struct(
        _first(props, r"(?U)display:\s*([^;]+)", 2**31 - 1).alias("display"),
        _first(props, r"(?U)background[^:]*:\s*([^;]+)", 50).alias("background"),
        F.when(spaced, "custom").alias("spacing"),
    )


def _components(styles: DataFrame) -> DataFrame:
    """Add ``components``: class name and key properties; classes without any are left out."""
    rules = F.transform(
        _pairs(F.col("content"), CSS_RULE, 1, 2), lambda r: F.struct(r["name"].alias("name"), _rule_facts(r["value"]).alias("value"))
    )
    telling = F.filter(
        rules, lambda r: F.coalesce(r["value"]["display"], r["value"]["background"], r["value"]["spacing"]).isNotNull()
    )
    return _keep_last(styles.withColumn("components", telling), "components")


def css_components(files: DataFrame) -> DataFrame:
    """One row per class with its key properties."""
    return _components(_styles(files)).select(*KEY, F.explode("components").alias("c")).select(
        *KEY, F.col("c.name").alias("class_name"), "c.value.*"
    )


def _tokens(content: Column) -> Column:
    rems = extract(content, CSS_REM)
    spacing = F.when(
        F.size(rems) > 0,
        F.concat(F.lit("rem-based ("), F.array_min(rems), F.lit(" to "), F.array_max(rems), F.lit(")")),
    ).otherwise("pixel-based")
    font = F.coalesce(_first(content, r"(?U)font-family:\s*([^;]+)", 60), F.lit("default-font"))
    return F.struct(
        F.slice(F.array_sort(F.array_distinct(extract(content, CSS_COLOR))), 1, 15).alias("colors"),
        spacing.alias("spacing"),
        font.alias("typography"),
    )


def css_tokens(files: DataFrame) -> DataFrame:
    """Colours, spacing range (by text order) and font of each style sheet."""
    return _styles(files).select(*KEY, _tokens(F.col("content")).alias("t")).select(*KEY, "t.*")


def css_media(files: DataFrame) -> DataFrame:
    """First five media queries of each style sheet."""
    return _styles(files).select(
        *KEY, F.posexplode(F.slice(extract(F.col("content"), CSS_MEDIA), 1, 5)).alias("position", "media_query")
    )


# Python ------------------------------------------------------------------------------------------


def _python(files: DataFrame) -> DataFrame:
    return files.filter(paths.language(F.col("relative_path")) == "python")


def _with_classes(files: DataFrame) -> DataFrame:
    return _keep_last(files.withColumn("classes", _pairs(F.col("content"), PY_CLASS, 2, 1)), "classes")


def _with_routes(files: DataFrame) -> DataFrame:
    return _keep_last(files.withColumn("routes", _pairs(F.col("content"), PY_ROUTE, 2, 1)), "routes")


def _attributes(body: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(extract(body, PY_ATTRIBUTE))), 1, 10)


def _class_rows(files: DataFrame) -> DataFrame:
    return _with_classes(_python(files)).select(*KEY, F.explode("classes").alias("c")).select(
        *KEY, F.col("c.name").alias("class_name"), F.col("c.value").alias("body")
    )


def py_classes(files: DataFrame) -> DataFrame:
    """One row per class with up to ten attributes, in name order."""
    return _class_rows(files).select(*KEY, "class_name", _attributes(F.col("body")).alias("attributes"))


def py_methods(files: DataFrame) -> DataFrame:
    """One row per method. A method's text runs to the end of its class."""
    with_methods = _class_rows(files).withColumn("methods", _pairs(F.col("body"), PY_METHOD, 2, 1))
    body = F.col("m.value")
    return _keep_last(with_methods, "methods").select(*KEY, "class_name", F.explode("methods").alias("m")).select(
        *KEY,
        "class_name",
        F.col("m.name").alias("method"),
        docstring(body).alias("purpose"),
        logic(body).alias("logic"),
        text.line_count(body).alias("lines"),
    )


def py_routes(files: DataFrame) -> DataFrame:
    """One row per route. A route's text is its decorator line."""
    body = F.col("r.value")
    return _with_routes(_python(files)).select(*KEY, F.explode("routes").alias("r")).select(
        *KEY,
        F.col("r.name").alias("route"),
        http_method(body).alias("method"),
        flow(body).alias("flow"),
        return_type(body).alias("returns"),
    )


def _import_list(content: Column) -> Column:
    split = F.flatten(F.transform(extract(content, PY_IMPORT), lambda m: F.split(m, ",")))
    return F.slice(F.transform(split, text.strip), 1, 15)


def py_imports(files: DataFrame) -> DataFrame:
    """First 15 import texts of each file, in order."""
    return _python(files).select(*KEY, F.posexplode(_import_list(F.col("content"))).alias("position", "import"))


# Pages and the rest ------------------------------------------------------------------------------


def html_tags(pages: DataFrame, key: list[str], column: str) -> DataFrame:
    """Opening tags per page and tag name, case-sensitive."""
    return pages.select(*key, F.explode(extract(F.col(column), HTML_TAG)).alias("tag")).groupBy(*key, "tag").agg(
        F.count("*").alias("n")
    )


def html_links(pages: DataFrame, key: list[str], column: str) -> DataFrame:
    """External scripts and styles of each page."""
    content = F.col(column)
    links = F.concat(
        F.transform(targets(content, HTML_SCRIPT), lambda u: F.struct(F.lit("script").alias("kind"), u.alias("target"))),
        F.transform(targets(content, HTML_LINK), lambda u: F.struct(F.lit("style").alias("kind"), u.alias("target"))),
    )
    return pages.select(*key, F.explode(links).alias("l")).select(*key, "l.*")


def generic(files: DataFrame) -> DataFrame:
    """Lines and characters of files without an extractor of their own."""
    language = paths.language(F.col("relative_path"))
    return files.filter(~language.isin(*SCRIPT_LANGUAGES, "css", "python", "html")).select(
        *KEY,
        language.alias("type"),
        text.line_count(F.col("content")).alias("total_lines"),
        F.length("content").alias("size"),
    )


# Per-file summary --------------------------------------------------------------------------------


def summaries(files: DataFrame) -> DataFrame:
    """One JSON summary per file, by language, in a single pass over the content.

    Files of other languages hand the function extractor a null, so only scripts reach Python.
    """
    path = F.col("relative_path")
    content = F.col("content")
    df = files.withColumn("language", paths.language(path))
    language = F.col("language")

    def only(*names: str) -> Column:
        return F.when(language.isin(*names), content)

    df = df.withColumns(
        {
            "functions": script_functions(only(*SCRIPT_LANGUAGES)),
            "classes": _pairs(only("python"), PY_CLASS, 2, 1),
            "routes": _pairs(only("python"), PY_ROUTE, 2, 1),
            "components": F.filter(
                F.transform(
                    _pairs(only("css"), CSS_RULE, 1, 2),
                    lambda r: F.struct(r["name"].alias("name"), _rule_facts(r["value"]).alias("value")),
                ),
                lambda r: F.coalesce(r["value"]["display"], r["value"]["background"], r["value"]["spacing"]).isNotNull(),
            ),
            "tags": extract(only("html"), HTML_TAG),
        }
    )
    for column in ("classes", "routes", "components"):
        df = _keep_last(df, column)

    def as_map(column: str, facts) -> Column:
        return F.map_from_entries(F.transform(column, lambda e: F.struct(e["name"], facts(e))))

    def methods(body: Column) -> Column:
        # Of one name the last method wins; the facts come from its own text.
        pairs = _pairs(body, PY_METHOD, 2, 1)
        names = F.array_distinct(extract(body, PY_METHOD, 2))
        last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1))
        return F.map_from_entries(
            F.transform(
                last,
                lambda m: F.struct(
                    m["name"],
                    F.struct(
                        docstring(m["value"]).alias("purpose"),
                        logic(m["value"]).alias("logic"),
                        text.line_count(m["value"]).alias("lines"),
                    ),
                ),
            )
        )

    head = [path.alias("file")]
    lines = text.line_count(content).alias("total_lines")
    script = F.struct(
        *head,
        F.lit("javascript").alias("type"),
        as_map("functions", _function_facts).alias("functions"),
        _handlers(content).alias("event_handlers"),
        _globals(content).alias("globals"),
        F.size("functions").alias("complexity_score"),
        lines,
    )
    style = F.struct(
        *head,
        F.lit("css").alias("type"),
        _tokens(content).alias("design_tokens"),
        as_map("components", lambda e: e["value"]).alias("components"),
        F.slice(extract(content, CSS_MEDIA), 1, 5).alias("media_queries"),
        lines,
    )
    python = F.struct(
        *head,
        F.lit("python").alias("type"),
        as_map(
            "classes",
            lambda e: F.struct(methods(e["value"]).alias("methods"), _attributes(e["value"]).alias("attributes")),
        ).alias("classes"),
        as_map(
            "routes",
            lambda e: F.struct(
                http_method(e["value"]).alias("method"),
                flow(e["value"]).alias("flow"),
                return_type(e["value"]).alias("returns"),
            ),
        ).alias("routes"),
        _import_list(content).alias("imports"),
        (F.size("classes") + F.size("routes")).alias("complexity_score"),
        lines,
    )
    tag_counts = F.map_from_entries(
        F.transform(
            F.array_distinct("tags"), lambda t: F.struct(t, F.size(F.filter("tags", lambda x: x == t)))
        )
    )
    page = F.struct(
        *head,
        F.lit("html").alias("type"),
        tag_counts.alias("structure"),
        targets(content, HTML_SCRIPT).alias("external_scripts"),
        targets(content, HTML_LINK).alias("external_styles"),
        lines,
    )
    other = F.struct(
        *head, language.alias("type"), lines, F.length(content).alias("size"), F.lit("Generic text file").alias("summary")
    )
    summary = (
        F.when(language.isin(*SCRIPT_LANGUAGES), F.to_json(script))
        .when(language == "css", F.to_json(style))
        .when(language == "python", F.to_json(python))
        .when(language == "html", F.to_json(page))
        .otherwise(F.to_json(other))
    )
    return df.select(*KEY, "language", F.length(content).alias("n_chars"), summary.alias("summary"))


def complexity(files: DataFrame) -> DataFrame:
    """Distinct function names of scripts; distinct classes and routes of Python files."""
    scripts = files.filter(is_script(F.col("relative_path"))).select(
        *KEY, F.size(script_functions("content")).alias("complexity_score")
    )
    content = F.col("content")
    python = _python(files).select(
        *KEY,
        (
            F.size(F.array_distinct(extract(content, PY_CLASS, 2)))
            + F.size(F.array_distinct(extract(content, PY_ROUTE, 2)))
        ).alias("complexity_score"),
    )
    return scripts.union(python)
