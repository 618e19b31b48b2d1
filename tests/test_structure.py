"""Structure extraction and diagram rules on literal texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from treeloom.operators import diagrams, imports, inventory, quality, scans, structure


def files_of(spark, path, content):
    return spark.createDataFrame([("r", path, content)], "repo string, relative_path string, content string")


def test_js_block_rules(spark):
    code = (
        "function f({a}) { return a }\n"
        "function open(x) { if (x) {\n"
        "async function g() { /** does things\n*/ await x; for (;;) {} }\n"
        "function g(b) { // last wins\n fetch('/u') }\n"
        "const h = async (e) => e\nconst f2 = (x) => x\n"
        "function asyncLoad() { try { return 1 } catch (e) {} }\n"
    )
    got = {r["name"]: r for r in structure.js_functions(files_of(spark, "a.js", code)).collect()}
    # The parameter's brace closes the block; an unclosed block is empty with one line.
    assert (got["f"]["flow"], got["f"]["lines"]) == ("simple_execution", 1)
    assert (got["open"]["flow"], got["open"]["lines"], got["open"]["purpose"]) == ("simple_execution", 1, "Processing logic")
    assert (got["g"]["purpose"], got["g"]["api_calls"], got["g"]["type"]) == ("last wins", ["/u"], "sync")
    assert (got["h"]["type"], got["f2"]["purpose"], got["h"]["flow"]) == ("arrow", "Arrow function", None)
    assert (got["asyncLoad"]["type"], got["asyncLoad"]["flow"]) == ("async", "return → error_handling")
    assert set(got) == {"f", "open", "g", "h", "f2", "asyncLoad"}


def naive_block(source, start):
    level, inside = 0, False
    for i in range(start, len(source)):
        if source[i] == "{":
            level, inside = level + 1, True
        elif source[i] == "}":
            level -= 1
            if level == 0 and inside:
                return i + 1
    return start


def test_block_ends_match_a_plain_scan():
    rng = random.Random(5)
    for _ in range(300):
        source = "".join(rng.choice("{}a") for _ in range(rng.randint(0, 30)))
        braces = structure._Braces(source)
        for start in range(len(source) + 1):
            assert braces.end_of_block(start) == naive_block(source, start)


def test_python_blocks(spark):
    code = (
        "class A(B):\n    x = 1\n\n    def m(self):\n        self.k = 1\n        yield 2\n    def n(self):\n        \"\"\" Doc \"\"\"\n"
        "        self.a  = 2\nclass A:\n    def late(self): pass\n\nclass C: pass\n"
        "@app.route('/x', methods=['PUT'])\ndef h():\n    return jsonify(1)\n"
    )
    files = files_of(spark, "a.py", code)
    assert {(r["class_name"], tuple(r["attributes"])) for r in structure.py_classes(files).collect()} == {("A", ()), ("C", ())}
    first = files_of(spark, "a.py", code.split("class A:")[0])
    methods = {r["method"]: r for r in structure.py_methods(first).collect()}
    # A method's text runs to the end of its class.
    assert (methods["m"]["purpose"], methods["m"]["logic"]) == ("Doc", "generator")
    assert (methods["n"]["lines"], methods["n"]["logic"]) == (4, "simple_processing")
    assert structure.py_classes(first).collect()[0]["attributes"] == ["a", "k"]
    route = structure.py_routes(files).collect()[0]
    assert (route["route"], route["method"], route["flow"], route["returns"]) == ("/x", "PUT", "simple_execution", "Unknown")


def test_css_rules(spark):
    code = (
        ".a { display: flex }\n.a { left: 1px }\n.b { background: url(x) ; margin: 0 }\n#add { }\n"
        "p { width: 10rem; height: 2rem; color: #fff }\n.c { color: red }"
    )
    files = files_of(spark, "a.css", code)
    got = {r["class_name"]: (r["display"], r["background"], r["spacing"]) for r in structure.css_components(files).collect()}
    # A later rule without key properties does not replace an earlier one.
    assert got == {"a": ("flex", None, None), "b": (None, "url(x)", "custom")}
    tokens = structure.css_tokens(files).collect()[0]
    assert tokens["colors"] == ["#add", "#fff"]
    assert tokens["spacing"] == "rem-based (10rem to 2rem)" and tokens["typography"] == "default-font"


def test_summary_agrees_with_long_tables(spark):
    code = "function f() { fetch('/a') }\nlet z = 1\nconst g = (x) => x\nel.addEventListener('click', f)"
    row = structure.summaries(files_of(spark, "a.js", code)).select(
        F.get_json_object("summary", "$.functions.f.api_calls[0]").alias("api"),
        F.get_json_object("summary", "$.event_handlers[0]").alias("handler"),
        F.get_json_object("summary", "$.complexity_score").alias("score"),
        F.get_json_object("summary", "$.functions.g.flow").alias("arrow_flow"),
    ).collect()[0]
    assert tuple(row) == ("/a", "el→click", "2", None)


def naive_unmatched(deltas):
    stack, bad = 0, []
    for i, d in enumerate(deltas):
        if d > 0:
            stack += 1
        elif stack:
            stack -= 1
        else:
            bad.append(i)
    return bad


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_unmatched_closers_in_slices(spark, width):
    rng = random.Random(width)
    deltas = [rng.choice([1, -1, -1]) for _ in range(60)]
    df = spark.createDataFrame([("g", i, d) for i, d in enumerate(deltas)], "g string, n long, d int")
    got = sorted(r["n"] for r in scans.unmatched_closers(df, ["g"], "n", "d", width).collect())
    assert got == naive_unmatched(deltas)


def lines_of(spark, code):
    df = spark.createDataFrame([("d", code)], "diagram_id string, code string")
    return diagrams.to_lines(df, ["diagram_id"], "code")


def problems(df):
    return {(r["line_no"], r["problem"]) for r in df.collect()}


def test_detailed_lint(spark):
    code = (
        "graph TD\n%% note (\n\nsubgraph one [Title]\na[x] --> b\nend\nend\na_1[y]\nz --> a\nsubgraph x y\npie graph -->\n"
        "classDef c fill:#ff0000,stroke-width:2px\nq --> r.s"
    )
    got = problems(diagrams.detailed_lint(lines_of(spark, code)))
    assert got == {
        (5, "Undefined source node 'a[x]'. Available nodes: a"),
        (7, "'end' without matching 'subgraph'"),
        (9, "Undefined source node 'z'. Available nodes: a, a_1"),
        (10, "Subgraph name contains invalid characters"),
        (10, "Unclosed subgraph"),
        (11, "Graph direction might be unclear"),
        (13, "Undefined source node 'q'. Available nodes: a, a_1"),
        (13, "Undefined target node 'r.s'. Available nodes: a, a_1"),
    }


def test_numbered_variant_defines_its_base(spark):
    got = problems(diagrams.detailed_lint(lines_of(spark, "n_12[x]\nn --> m\nn_1 --> m")))
    assert got == {(3, "Undefined source node 'n_1'. Available nodes: n_12")}


def test_available_nodes_are_cut(spark):
    code = "\n".join(f"k{i}[x]" for i in range(6)) + "\nq --> a"
    assert problems(diagrams.detailed_lint(lines_of(spark, code))) == {
        (7, "Undefined source node 'q'. Available nodes: k0, k1, k2, k3, k4...")
    }


def test_strict_lint(spark):
    got = problems(diagrams.strict_lint(lines_of(spark, "a-->b\nclassDef x fill:red,\nclassDef a classDef b\nn[(x\n%% a-->b")))
    assert got == {
        (1, "Arrow syntax needs spaces around operators"),
        (2, "classDef statement ends with trailing comma"),
        (2, "classDef properties end with trailing comma"),
        (3, "Multiple classDef statements on same line - need line breaks"),
        (4, "Unclosed square brackets"),
        (4, "Unclosed parentheses"),
    }


def test_statistics(spark):
    texts = ["a[b] --> c", "]]x[y", "", "one two", "a[b c]d] e f[g"]
    import re

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["n_nodes"] for r in diagrams.statistics(df, ["t"], "t").collect()}
    assert got == {t: len(re.findall(r"(?:\w+)\[|[^\]]+\]|\w+", t)) for t in texts}


def test_language_dispatch(spark):
    files = inventory.with_path_columns(files_of(spark, "a.ts", "x\ny"))
    assert structure.js_functions(files).count() == 0
    assert [(r["type"], r["total_lines"], r["size"]) for r in structure.generic(files).collect()] == [("typescript", 2, 3)]


@pytest.mark.parametrize("word", ["import x ", "import ", "import   \n", "<script ", "<link a ", "/* ", "from '", " "])
def test_patterns_take_linear_time(spark, word):
    """One megabyte of a hostile word on one line."""
    text = word * (1_000_000 // len(word))
    df = spark.createDataFrame([("r", "a.css", text)], "repo string, relative_path string, content string")
    start = time.time()
    df.select(imports.script_imports(F.col("content"))).collect()
    structure.html_links(df, ["repo"], "content").collect()
    quality.style_balance(df, "content").collect()
    assert time.time() - start < 20


def test_import_forms(spark):
    text = (
        "import a from './a'\nimport { b,\n c } from './no'\nimport\n d from './d'\nimport e\n from './e'\nimport  from './f'\n"
        "import x from 'x'; import y from \"./y\"\nimport * as z from './import/z'\nimport './side'\nconst q = import('./q')"
    )
    df = spark.createDataFrame([(text,)], "content string")
    got = df.select(imports.script_imports(F.col("content")).alias("i")).first()["i"]
    assert sorted(got) == ["./a", "./d", "./e", "./f", "./import/z", "./q", "./y"]


def test_comments_that_do_not_close(spark):
    rows = [("/* { */ a {} /* {",), ("a {} /*/ { */ }",), ("/*/ {",), ("a { } */",), ("",)]
    df = quality.style_balance(spark.createDataFrame(rows, "content string"), "content")
    want = [len(re.findall(r"{", t)) == len(re.findall(r"}", t)) for t in (re.sub(r"(?s)/\*.*?\*/", "", r[0]) for r in rows)]
    assert [r["valid"] for r in df.collect()] == want
