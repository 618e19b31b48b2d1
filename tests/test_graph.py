"""Import resolution and graph jobs on small hand-made graphs and against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest

from treeloom.operators import graph, imports, inventory, matching, reach
from treeloom.plans import fixtures, report
from treeloom.session import Stages


def files_of(spark, rows):
    df = spark.createDataFrame([("r", p, c) for p, c in rows], "repo string, relative_path string, content string")
    return inventory.with_path_columns(df)


def edges_of(spark, pairs, repo="r"):
    return spark.createDataFrame([(repo, a, b) for a, b in pairs], "repo string, src string, dst string")


def resolved_pairs(spark, rows):
    files = files_of(spark, rows)
    out = imports.resolve(imports.imports(files), files)
    return {(r["relative_path"], r["import"], r["target"]) for r in out.collect()}


def test_suffix_is_replaced_and_index_found(spark):
    got = resolved_pairs(
        spark,
        [
            ("x/a.ts", "import s from './foo.service'\nimport d from './dir'\nimport up from '../top'\nimport o from '../../out'"),
            ("x/foo.js", ""), ("x/foo.ts", ""), ("x/dir/index.ts", ""), ("top.jsx", ""), ("out.js", ""),
        ],
    )
    assert got == {
        ("x/a.ts", "./foo.service", "x/foo.js"),
        ("x/a.ts", "./dir", "x/dir/index.ts"),
        ("x/a.ts", "../top", "top.jsx"),
    }


def test_file_wins_over_index_and_root_index(spark):
    got = resolved_pairs(
        spark,
        [("a.js", "require('./m')\nimport x from '.'"), ("m.tsx", ""), ("m/index.js", ""), ("index.jsx", "")],
    )
    assert got == {("a.js", "./m", "m.tsx"), ("a.js", ".", "index.jsx")}


def test_python_relative_imports_give_no_edge_by_default(spark):
    files = files_of(spark, [("p/a.py", "from .b import c\nfrom .. import d\nimport os"), ("p/b.py", ""), ("d.py", "")])
    default = imports.imports(files)
    assert {r["import"] for r in default.collect()} == {"b", "os"}
    assert imports.resolve(default, files).count() == 0
    relative = imports.resolve(imports.imports(files, python_relative=True), files)
    assert {(r["import"], r["target"]) for r in relative.collect()} == {("./b", "p/b.py"), ("../d", "d.py")}


def test_python_fallback_on_syntax_error(spark):
    files = files_of(spark, [("p/a.py", "import os\nfrom .b import c\ndef broken(:\n"), ("p/b.py", "")])
    assert {r["import"] for r in imports.imports(files).collect()} == {"os", ".b"}


def test_script_import_rules(spark):
    files = files_of(spark, [("a.js", "import r from 'react'\nimport s from '@s/x'\nimport {\n b } from './no'\nconst q = import('lib/deep')")])
    assert {r["import"] for r in imports.imports(files).collect()} == {"@s/x", "lib/deep"}


def test_exports(spark):
    files = files_of(
        spark,
        [("a.js", "export default function f() {}\nexport { a, b }\nexport const c = 1"), ("b.py", "class K:\n    def m(self): pass")],
    )
    got = {(r["relative_path"], r["export"]) for r in imports.exports(files).collect()}
    assert got == {("a.js", "f"), ("a.js", "a"), ("a.js", "b"), ("a.js", "c"), ("b.py", "K"), ("b.py", "m")}


def test_metrics_and_completeness(spark):
    rows = files_of(spark, [(p, "") for p in ("a.js", "b.js", "c.js")])
    edges = edges_of(spark, [("a.js", "b.js"), ("b.js", "c.js"), ("a.js", "c.js")])
    got = graph.metrics(graph.nodes(rows, edges)).collect()[0]
    assert (got["coupling_score"], got["average_dependencies"], got["max_dependencies"]) == (50.0, 1.0, 2)
    assert (got["most_dependent_file"], got["entry_points"], got["leaf_nodes"]) == ("c.js", 1, 1)
    missing = spark.createDataFrame([("r", "a.js")], "repo string, required_by string")
    score = graph.completeness(rows, missing).collect()[0]
    assert (score["completeness_score"], score["band"]) == (75.0, "medium")


def test_edges_and_missing_split_the_resolved_imports(spark):
    files = files_of(spark, [("a.js", "import b from './b'\nimport c from './c'"), ("b.js", "import a from './a'"), ("c.js", "")])
    chosen = files.filter("relative_path <> 'c.js'")
    parts = report.dependency_report(files, chosen)
    assert {(r["src"], r["dst"]) for r in parts["edges"].collect()} == {("a.js", "b.js"), ("b.js", "a.js")}
    assert [(r["required_by"], r["suggested_file"]) for r in parts["missing"].collect()] == [("a.js", "c.js")]
    assert [r["cycle"] for r in parts["cycles"].collect()] == [["a.js", "b.js"]]
    resolved = imports.resolve(imports.imports(files), files)
    grown = reach.dependency_closure(graph.edges(resolved, files), chosen)
    assert graph.missing(resolved, grown).count() == 0


def brute_cycles(pairs):
    nodes = sorted({x for p in pairs for x in p})
    links = set(pairs)
    found = set()
    for n in range(2, len(nodes) + 1):
        for seq in itertools.permutations(nodes, n):
            if seq[0] == min(seq) and all((seq[i], seq[(i + 1) % n]) in links for i in range(n)):
                found.add(seq)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(7)]
    pairs = sorted({(a, b) for a in nodes for b in nodes if a != b and rng.random() < 0.3})
    got, truncated = reach.cycles(edges_of(spark, pairs))
    want = brute_cycles(pairs)
    assert {tuple(r["cycle"]) for r in got.collect()} == want
    assert got.count() == len(want) and not truncated
    limited, cut = reach.cycles(edges_of(spark, pairs), max_len=3)
    assert {tuple(r["cycle"]) for r in limited.collect()} == {c for c in want if len(c) <= 3}
    assert cut or all(len(c) <= 3 for c in want)


def test_cyclic_core_keeps_exactly_edges_inside_components(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("z", "a"), ("d", "c")]
    core = {(r["src"], r["dst"]) for r in reach.cyclic_core(edges_of(spark, pairs)).collect()}
    assert core == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("d", "c")}


def test_reach_keeps_repositories_apart(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a")], "r").union(edges_of(spark, [("a", "x")], "s"))
    seeds = spark.createDataFrame([("r", "a")], "repo string, node string")
    assert {(r["repo"], r["node"]) for r in reach.reach(edges, seeds).collect()} == {("r", "a"), ("r", "b"), ("r", "c")}
    back = spark.createDataFrame([("s", "x")], "repo string, node string")
    assert {r["node"] for r in reach.connected(edges, back).collect()} == {"a", "x"}


def test_long_chain_is_compacted(spark):
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    seeds = spark.createDataFrame([("r", "n00")], "repo string, node string")
    assert reach.reach(edges_of(spark, pairs), seeds).count() == 21


def test_hierarchy_ends_at_repeats_and_lists_flat_without_entries(spark):
    nodes = files_of(spark, [(p, "") for p in ("a", "b", "c")])
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b")])
    tree, cut = reach.hierarchy(graph.nodes(nodes, edges), edges)
    rows = tree.collect()
    assert not cut and reach.hierarchy(graph.nodes(nodes, edges), edges, max_depth=1)[1]
    assert {(tuple(r["path"]), r["repeated"]) for r in rows} == {
        (("a",), False), (("a", "b"), False), (("a", "b", "c"), False), (("a", "b", "c", "b"), True),
    }
    ring = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    flat = reach.hierarchy(graph.nodes(nodes, ring), ring)[0].collect()
    assert {tuple(r["path"]) for r in flat} == {("a",), ("b",), ("c",)}


def test_contains_pairs_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 14))) for _ in range(80)]
    needles = sorted({"".join(rng.choice("ab/") for _ in range(rng.randint(1, 8))) for _ in range(60)})
    left = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    right = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = [(r["id"], r["needle"]) for r in matching.contains_pairs(left, "t", right, "needle").collect()]
    want = {(i, n) for i, t in enumerate(texts) for n in needles if n in t}
    assert set(got) == want and len(got) == len(want)


def test_suggestions(spark):
    files = files_of(spark, [("a/config.js", ""), ("b/config.js", ""), ("b/main.ts", ""), ("z.py", "")])
    missing = spark.createDataFrame(
        [("r", p) for p in ("a/config.js", "q/config.js", "q/my_main.ts", "q/mai", "q/zzz")], "repo string, missing_path string"
    )
    got = {r["missing_path"]: (r["suggested_path"], r["confidence"]) for r in matching.suggest_missing(missing, files).collect()}
    assert got == {
        "a/config.js": ("a/config.js", 1.0), "q/config.js": ("a/config.js", 0.8), "q/my_main.ts": ("b/main.ts", 0.5),
        "q/mai": ("b/main.ts", 0.5), "q/zzz": (None, 0.0),
    }


def test_reach_reads_the_buckets_of_its_frontier(spark, monkeypatch):
    """A long chain: a round looks among the visited nodes of a few buckets only, and finds the same nodes."""
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("n020", "n000"), ("n005", "n030")]
    seeds = spark.createDataFrame([("r", "n010")], "repo string, node string")
    want = {r["node"] for r in reach.reach(edges_of(spark, pairs), seeds).collect()}
    read, real = [], reach.Visited.near
    monkeypatch.setattr(reach, "BUCKET_ROWS", 2)
    monkeypatch.setattr(reach.Visited, "near", lambda self, found: read.append((self, real(self, found))) or read[-1][1])
    got = {r["node"] for r in reach.reach(edges_of(spark, pairs), seeds).collect()}
    assert got == want and len(got) == 41
    visited, last = read[-2]  # the last round finds nothing
    assert visited.buckets == 21 and last.count() <= 6 < visited.all().count()
    assert "PartitionFilters: [isnotnull(bucket" in last._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in last._jdf.queryExecution().toString()


def test_paths_that_cannot_close_do_not_grow(spark, monkeypatch):
    """Layers that lead back to the smallest node only: paths from other nodes could never close, so none begins."""
    layers = [["b"], *([f"{name}{i}" for i in range(3)] for name in "cde"), ["a"]]
    pairs = [("a", "b"), ("b", "a")] + [(x, y) for one, other in zip(layers, layers[1:]) for x in one for y in other]
    want = {("a", "b"), *(("a", "b", f"c{i}", f"d{j}", f"e{k}") for i in range(3) for j in range(3) for k in range(3))}
    sizes, real = [], reach.Stages.write
    monkeypatch.setattr(reach.Stages, "write", lambda self, df, measure=None: sizes.append((df.columns, real(self, df, measure))) or sizes[-1][1])
    got, _ = reach.cycles(edges_of(spark, pairs))
    assert {tuple(r["cycle"]) for r in got.collect()} == want
    assert max(size for columns, size in sizes if "path" in columns) <= len(want)


def test_rounds_on_larger_graphs_send_no_side_through_the_driver(spark, monkeypatch):
    """Beyond the bound every join of a round is a shuffle; cycles are the same either way."""
    rings = [(10 * r + i, 10 * r + (i + 1) % 10) for r in range(6) for i in range(10)] + [(3, 14), (0, 5), (61, 62)]
    edge_rows = spark.createDataFrame([("r", f"n{a:03}", f"n{b:03}") for a, b in rings], "repo string, src string, dst string")
    plans = []
    write = Stages.write

    def seen(self, df, measure=None):
        plans.append(df._jdf.queryExecution().toString())
        return write(self, df, measure)

    monkeypatch.setattr(Stages, "write", seen)
    few = sorted(tuple(r.cycle) for r in reach.cycles(edge_rows)[0].collect())
    assert any("BroadcastHashJoin" in p for p in plans) and len(few) == 7
    plans.clear()
    monkeypatch.setattr(reach, "SENT_ROWS", 0)
    assert sorted(tuple(r.cycle) for r in reach.cycles(edge_rows)[0].collect()) == few
    assert plans and not any("Broadcast" in p for p in plans)


def test_text_of_source_files_is_shuffled_once(spark, tmp_path, capsys):
    """Targets are looked up without the text; repeated numbers still multiply, and a missing one finds nothing."""
    ids = [*range(130), 7, 7, 66, None, None]
    rows = [(i, f"s{n % 3}", "en", f"text {n}", 6) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for i, source, lang, *_ in rows:
        at.setdefault(i, []).append(f"{source}/{lang}/mod_{i}")
    want = Counter()
    for i, source, lang, *_ in rows:
        if i is not None and i % 6 < 3:
            first = i - i % 60
            chain = at.get(i if first == 0 else (i * 7 + 3) % first, [])
            ring = at.get((first + (i % 60 + 6) % 60) % len(rows), [])
            path = f"{source}/{lang}/mod_{i}" + [".js", ".ts", ".jsx"][i % 6]
            want.update((path, f"'../../{a}'", f"'../../{b}'") for a in chain for b in ring)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = fixtures.src_files(spark, str(tmp_path))
        files.explain("formatted")
        shuffled = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
        assert sum("text#" in columns for columns in shuffled) == 1 < len(shuffled)
        got = Counter()
        for r in files.collect():
            if r.extension in (".js", ".ts", ".jsx") and r.content is not None:
                got[(r.relative_path, *re.findall(r"'\.\./\.\./[^']*'", r.content))] += 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == want and max(want.values()) > 1


def test_an_import_path_is_resolved_once(spark):
    """The fold over a path's parts stands once in the plan, not also in a filter and in the columns made from it."""
    found = spark.createDataFrame([("r", "x/a.js", "./b"), ("r", "x/a.js", "../../out")], "repo string, relative_path string, import string")
    files = spark.createDataFrame([("r", "x/a.js"), ("r", "x/b.ts"), ("r", "out.js")], "repo string, relative_path string")
    out = imports.resolve(found, files)
    assert [(r["import"], r["target"]) for r in out.collect()] == [("./b", "x/b.ts")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_files_without_content_import_nothing(spark):
    rows = [("x/a.py", None), ("x/b.js", None), ("x/c.py", "import os")]
    out = imports.imports(files_of(spark, rows)).collect()
    assert [(r["relative_path"], r["import"]) for r in out] == [("x/c.py", "os")]
