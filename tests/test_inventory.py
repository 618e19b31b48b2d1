"""Hand-worked cases for paths, sizes, selection, search, sources and saved tables."""

import itertools
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from treeloom.functions import paths, text
from treeloom.operators import archive, bundle, callstats, inventory, matching, quality, replies, scans, search
from treeloom.sources import tables, tree


def files_of(spark, rows):
    return spark.createDataFrame([("r", p, s) for p, s in rows], "repo string, relative_path string, size long")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    "path,ext,language",
    [("Makefile", "", "makefile"), ("a/.env", "", "text"), ("a/b.PY", ".py", "python"), ("x.tar.gz", ".gz", "text"), ("a/Dockerfile", "", "dockerfile")],
)
def test_extension_and_language(spark, path, ext, language):
    assert one(spark, paths.extension(F.lit(path))) == ext
    assert one(spark, paths.language(F.lit(path))) == language


@pytest.mark.parametrize(
    "folder,relative,want",
    [("a/b", "../x/./y", "a/x/y"), (".", "./m", "m"), ("a", "../../m", None), ("a", "..", ""), ("a", "../../a/m", None)],
)
def test_normalise(spark, folder, relative, want):
    assert one(spark, paths.normalise(F.lit(folder), F.lit(relative))) == want


def test_normalise_is_a_walk_from_left_to_right(spark):
    """Folding from the right gives what walking from the left gives, also for paths that come back after leaving."""
    chance = random.Random(5)
    pairs = [tuple("/".join(chance.choices(["a", "b.js", "..", "..", ".", ""], k=chance.randint(1, n))) for n in (4, 7)) for _ in range(400)]

    def walk(folder, relative):
        held = []
        for part in f"{folder}/{relative}".split("/"):
            if part == ".." and not held:
                return None
            held = held[:-1] if part == ".." else held + [part] * (part not in ("", "."))
        return "/".join(held)

    df = spark.createDataFrame([*pairs, ("a", None), (None, "a")], "folder string, relative string")
    got = [r.x for r in df.select(paths.normalise(F.col("folder"), F.col("relative")).alias("x")).collect()]
    assert got == [*(walk(*p) for p in pairs), None, None] and 50 < got.count(None) < 350


def test_skip_rules(spark):
    rows = [
        ("package-lock.json", 1), ("Lock.YAML", 1), ("yarn.lock", 1), ("big.js", 10 * 1024 * 1024 + 1), ("edge.js", 10 * 1024 * 1024),
        ("a/.git/x", 1), ("node_modules/x.js", 1), ("Build/x.js", 1), (".hidden", 1), ("_priv/__init__.py", 1),
    ]
    kept = {r["relative_path"] for r in inventory.admissible(files_of(spark, rows)).collect()}
    assert kept == {"Lock.YAML", "yarn.lock", "edge.js", "Build/x.js", "_priv/__init__.py"}


@pytest.mark.parametrize("size,shown", [(1152, "1.12 KB"), (0, "0.00 B"), (1024, "1.00 KB"), (1023, "1023.00 B"), (1024**4 * 3, "3.00 TB")])
def test_human_size(spark, size, shown):
    assert one(spark, text.human_size(F.lit(size).cast("long"))) == shown


def test_browser_size(spark):
    assert one(spark, text.browser_size(F.lit(None).cast("long"))) == "0 B"
    assert one(spark, text.browser_size(F.lit(1024**4).cast("long"))) == "1024.00 GB"


def test_collision_and_totals(spark):
    files = files_of(spark, [("a-b.py", 1), ("a_b.py", 2), ("x/c.py", 3)])
    got = inventory.id_collisions(files).collect()
    assert [(r["file_id"], r["n_paths"]) for r in got] == [("a_b_py", 2)]
    totals = inventory.corpus_totals(files).collect()[0]
    assert (totals["total_files"], totals["total_dirs"]) == (2, 2)
    root = inventory.directory_rollup(files).filter("directory = '.'").collect()[0]
    assert (root["file_count"], root["total_size"]) == (3, 6)


def test_directory_states(spark):
    files = files_of(spark, [("a/x", 1), ("a/y", 1), ("b/z", 1), ("c/d/w", 1), ("c/v", 1)])
    chosen = files.filter("relative_path IN ('a/x', 'a/y', 'c/d/w')")
    got = {r["directory"]: r["state"] for r in inventory.directory_states(files, chosen).collect()}
    assert got == {".": "indeterminate", "a": "selected", "b": "none", "c": "indeterminate", "c/d": "selected"}
    empty = spark.createDataFrame([("r", "a/void")], "repo string, directory string")
    got = {r["directory"]: r["state"] for r in inventory.directory_states(files, chosen, empty).collect()}
    assert (got["a"], got["a/void"]) == ("indeterminate", "none")


def test_tree_order(spark):
    files = files_of(spark, [("b.txt", 1), ("A.txt", 1), ("z/k", 1), ("z/a/k", 1), ("Y/k", 1)])
    got = [r["relative_path"] for r in inventory.tree_order(files).collect()]
    assert got == ["Y/k", "z/a/k", "z/k", "A.txt", "b.txt"]


def test_preview_edges(spark):
    rows = [("r", str(n), "x" * n, n) for n in (4999, 5000, 5001)]
    got = inventory.preview(spark.createDataFrame(rows, "repo string, relative_path string, content string, size long"))
    lengths = {r["relative_path"]: len(r["preview"]) for r in got.collect()}
    more = len("\n\n... (truncated)")
    assert lengths == {"4999": 4999, "5000": 5000 + more, "5001": 5000 + more}


def test_selection_modes(spark):
    a, b = files_of(spark, [("a", 1)]), files_of(spark, [("b", 1)])
    assert inventory.combine_selection(a, b, "add").count() == 2
    assert inventory.combine_selection(a, b, "replace").collect()[0]["relative_path"] == "b"
    with pytest.raises(ValueError):
        inventory.combine_selection(a, b, "other")


def test_search_scores_and_empty_query(spark):
    files = files_of(spark, [("main.py", 1), ("x/main.py", 1), ("my_main.py", 1), ("none.txt", 1)])
    got = {r["relative_path"]: r["match_score"] for r in search.search(files, "main.py").collect()}
    assert got == {"main.py": 130.0, "x/main.py": 120.0, "my_main.py": 60.0}
    assert search.search(files, "").count() == 0
    dots = {r["relative_path"]: r["match_score"] for r in search.search(files, "/").collect()}
    assert dots == {"x/main.py": 25.0}


def test_name_parsing_and_priority(spark):
    names = matching.parse_names(spark, " main.py ,\n, nope\nX/MAIN")
    assert [r["name"] for r in names.orderBy("position").collect()] == ["main.py", "nope", "X/MAIN"]
    files = files_of(spark, [("main.py", 1), ("x/main.py", 1)])
    hits = matching.bulk_select(files, names)
    assert {(r["relative_path"], r["name"]) for r in hits.collect()} == {("main.py", "main.py"), ("x/main.py", "main.py"), ("x/main.py", "X/MAIN")}
    assert [r["name"] for r in matching.not_found(names, hits).collect()] == ["nope"]
    # Folders come before files in tree order; the match is case-sensitive.
    assert [(r["name"], r["relative_path"]) for r in matching.priority_select(files, names).collect()] == [("main.py", "x/main.py")]


def test_nested_listing(spark):
    rows = spark.createDataFrame(
        [("r", ([("f1",)], [([("f2",), ("f3",)],)]))],
        "repo string, tree struct<files array<struct<file_id string>>, children array<struct<files array<struct<file_id string>>>>>",
    )
    assert {r["file_id"] for r in inventory.flatten_nested(rows).collect()} == {"f1", "f2", "f3"}


# Sources and saved tables ------------------------------------------------------------------------


@pytest.fixture()
def real_tree(tmp_path):
    root = tmp_path / "proj"
    for name, data in {
        "a.py": b"import os\n", "_priv/__init__.py": b"", ".hidden": b"x", ".git/config": b"x", "node_modules/m.js": b"x",
        "pkg/package-lock.json": b"{}", "pkg/yarn.lock": b"", "pkg/bad.txt": b"caf\xe9 \r\nx", "pkg/deep/er/z.js": b"1", "big.bin": b"x" * 3000,
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (root / "empty").mkdir()
    return root


@pytest.mark.parametrize("parts", ["1", "3", "64"])
def test_tree_source(spark, real_tree, parts):
    spark.dataSource.register(tree.TreeSource)

    def reader():
        return spark.read.format("source_tree").option("path", str(real_tree)).option("min_partitions", parts)

    rows = reader().option("max_file_mb", str(2000 / 1024 / 1024)).option("content", "true").load()
    got = tree.decoded(tree.files(rows))
    content = {r["relative_path"]: r["content"] for r in got.collect()}
    assert content == {
        "a.py": "import os\n", "_priv/__init__.py": "", "pkg/yarn.lock": "", "pkg/bad.txt": "caf� \nx", "pkg/deep/er/z.js": "1",
    }
    folders = [r["directory"] for r in tree.directories(rows).collect()]
    assert sorted(folders) == [".", "_priv", "empty", "pkg", "pkg/deep", "pkg/deep/er"]
    assert tree.scan_errors(rows).count() == 0
    facts = {r["relative_path"]: r["size"] for r in tree.files(reader().load()).collect()}
    assert facts["big.bin"] == 3000 and "content" not in reader().load().columns


def test_flat_folder_is_read_by_many_tasks(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"f{i}.txt").write_text(str(i))
    rows = tree.read_tree(spark, [str(tmp_path)], content=True, split_files="100")
    per_task = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 30 and max(r["count"] for r in per_task) < 200
    got = {r["name"]: bytes(r["content"]) for r in tree.files(rows).collect()}
    assert got == {f"f{i}.txt": str(i).encode() for i in range(3000)}
    assert tree.directories(rows).count() == 1 and rows.count() == 3001


def test_filters_reach_the_tree_source(spark, real_tree):
    def fresh(pushdown=True):
        return tree.files(tree.read_tree(spark, [str(real_tree)], content=True, pushdown=pushdown))

    tests = [
        F.col("name").endswith(".py"), F.col("size") > 2, ~F.col("name").contains("a"), F.col("relative_path").startswith("pkg/"),
        F.col("name").isin("a.py", "z.js"), F.col("size").isNull(), ~(F.col("size") >= 5), F.col("repo") == "nope",
        F.col("name").isNotNull() & F.col("last_modified").isNotNull(), ~F.col("size").isin(0, 1), F.col("size").eqNullSafe(0),
    ]
    everything = fresh(False).collect()
    plain = spark.createDataFrame(everything, fresh(False).schema)
    for test in tests:
        assert sorted(fresh().filter(test).collect()) == sorted(plain.filter(test).collect())
    plan = fresh().filter(tests[0])._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan.split("BatchScan")[0]  # the source decides, no filter is left
    assert tree.holds(ds.Not(ds.EqualTo(("size",), 1)), {"size": None}) is None
    assert tree.holds(ds.In(("size",), (1, None)), {"size": 2}) is None
    reader = tree.FilteredTreeReader({"path": str(real_tree), "content": "true"})
    late = ds.GreaterThan(("last_modified",), 0)
    assert list(reader.pushFilters([ds.EqualTo(("kind",), "file"), late])) == [late]
    assert all(r[0] == "file" for p in reader.partitions() for r in reader.read(p))


def test_tree_source_reports_errors(spark, real_tree):
    (real_tree / "pkg" / "loop").symlink_to(real_tree / "pkg" / "loop")
    spark.dataSource.register(tree.TreeSource)
    rows = spark.read.format("source_tree").option("path", str(real_tree)).load()
    assert tree.files(rows).count() == 6
    assert tree.scan_errors(rows).count() == 0  # a link in a circle is neither file nor folder
    reader = tree.TreeReader({"path": str(real_tree)})
    gone = list(reader._folder(str(real_tree), str(real_tree / "gone"), None))
    assert [(r[0], r[3]) for r in gone] == [("dir", "gone"), ("error", "gone")] and "gone" in gone[1][7]
    with pytest.raises(Exception, match="does not exist"):
        spark.read.format("source_tree").option("path", str(real_tree / "nope")).load().count()


def test_snapshot_is_replaced_by_id(spark, tmp_path):
    path = str(tmp_path / "snap")
    tables.write_snapshot({"files": files_of(spark, [("a", 1)])}, path, "one")
    tables.write_snapshot({"files": files_of(spark, [("b", 1), ("c", 1)])}, path, "two")
    tables.write_snapshot({"files": files_of(spark, [("d", 1)])}, path, "two")
    assert [r["relative_path"] for r in tables.read_snapshot(spark, path, "files", "two").collect()] == ["d"]
    assert [r["relative_path"] for r in tables.read_snapshot(spark, path, "files", "one").collect()] == ["a"]


def test_store_grows_by_new_texts_only(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    tables.add_originals(path, archive.originals(first))
    more = spark.createDataFrame([("y",), ("z",)], "text string")
    tables.add_originals(path, archive.originals(more, store=spark.read.parquet(path)))
    assert sorted(r["content"] for r in spark.read.parquet(path).collect()) == ["x", "y", "z"]


def test_bundle_text_file_is_the_document(spark, tmp_path):
    files = spark.createDataFrame(
        [("r", "a.py", "x = 1", 5, 0), ("r", "b/c.txt", "hi", 2, 60)],
        "repo string, relative_path string, content string, size long, at long",
    ).withColumn("last_modified", F.timestamp_seconds("at")).drop("at")
    asked = spark.createDataFrame(
        [("k", 1, "r", "b/c.txt"), ("k", 2, "r", "gone"), ("k", 3, "r", "a.py")],
        "bundle_id string, position long, repo string, relative_path string",
    )
    rows = bundle.parts(asked, files, "2024-01-01 00:00:00")
    bundle.write_markdown(rows, str(tmp_path / "out"))
    folder = tmp_path / "out" / "bundle_id=k"
    got = "".join((folder / n).read_text() for n in sorted(os.listdir(folder)) if n.startswith("part"))
    fence = "```"
    want = "\n".join(
        [
            "# Aggregated Source Code", "\n**Generated at:** 2024-01-01 00:00:00", "**Root Directory:** `r`", "**Total Files:** 3",
            "**Compression Type:** none", "\n## Table of Contents\n", "1. [b/c.txt](#b_c_txt)", "3. [a.py](#a_py)", "\n---\n",
            "\n## b/c.txt\n", "**File Size:** 2.00 B  ", "**Last Modified:** 1970-01-01 00:01:00  ", "", f"{fence}text", "hi", fence, "\n---",
            "\n## a.py\n", "**File Size:** 5.00 B  ", "**Last Modified:** 1970-01-01 00:00:00  ", "", f"{fence}python", "x = 1", fence, "\n---",
        ]
    )
    assert got == want + "\n"
    facts = bundle.manifest(rows, asked, "s").collect()[0]
    assert (facts["size"], facts["file_count"], facts["filename"]) == (len(want), 3, "source_code_none_s.md")
    parsed = bundle.parse(spark.createDataFrame([("k", want)], "bundle_id string, text string"))
    assert [(r["file"], r["language"], r["code"]) for r in parsed.orderBy("position").collect()] == [
        ("b/c.txt", "text", "hi"), ("a.py", "python", "x = 1"),
    ]
    with pytest.raises(ValueError):
        bundle.check_mode("zip")


def test_bundle_parse_of_adjacent_headings(spark):
    fence = "```"
    md = f"x\n## a\n## b\n{fence}js\n1\n{fence}\n## c\n\n## d\n{fence}py\n\n{fence}"
    parsed = bundle.parse(spark.createDataFrame([(md,)], "text string"))
    # The line end of a heading is used up by it, so the next line is text, not a heading.
    assert [(r["file"], r["language"], r["code"]) for r in parsed.orderBy("position").collect()] == [("a", "js", "1"), ("d", "py", "")]


# Statistics, replies, checks ---------------------------------------------------------------------


def calls_of(spark, rows):
    return spark.createDataFrame(
        [(i, m, ok, t, c, i) for i, (m, ok, t, c) in enumerate(rows)],
        "event_id long, model_name string, success boolean, response_time double, complexity int, at long",
    ).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_degraded_and_best(spark):
    rows = [("fails", True, 1.0, 1)] * 2 + [("fails", False, None, 0)] * 4
    rows += [("slow", True, 46.0, 1)] * 3 + [("fine", True, 1.0, 1)] * 3 + [("fine", False, None, 0)] * 2 + [("once", True, 0.1, 1)]
    stats = callstats.model_statistics(calls_of(spark, rows))
    got = {r["model_name"]: r["degraded"] for r in callstats.degraded(stats).collect()}
    assert got == {"fails": True, "slow": True, "fine": False, "once": False}
    assert not any(r["degraded"] for r in callstats.degraded(stats, auto_switch=False).collect())
    routing = spark.createDataFrame(
        [("t", "s", 0, "once"), ("t", "s", 1, "slow"), ("t", "s", 2, "fine"), ("u", "", 0, "never"), ("u", "", 1, "once")],
        "task string, subtask string, rank int, model string",
    )
    best = {(r["task"], r["subtask"]): r["model"] for r in callstats.best_models(routing, stats).collect()}
    assert best == {("t", "s"): "fine", ("u", ""): "never"}
    asked = spark.createDataFrame([("t", "s"), ("t", "x"), ("u", "x"), ("v", "")], "task string, subtask string")
    routed = {(r["task"], r["subtask"]): r["model"] for r in callstats.route(asked, routing, stats, "d").collect()}
    assert routed == {("t", "s"): "fine", ("t", "x"): "d", ("u", "x"): "never", ("v", ""): "d"}
    off = callstats.route(asked, routing, stats, "d", auto_switch=False).filter("subtask = 's'").collect()[0]
    assert off["model"] == "once"


def test_running_mean_across_slices(spark):
    rows = [("m", True, float(i), i) for i in range(1, 8)]
    got = callstats.running_mean(calls_of(spark, rows), rows_per_slice=2).orderBy("event_id").collect()
    assert [r["avg_response_time"] for r in got] == [(i + 1) / 2 for i in range(1, 8)]


def test_running_mean_of_a_burst_and_of_nulls(spark, monkeypatch):
    """Calls at one time spread evenly over slices; a model without a name is a model."""
    rows = [("m" if i % 3 else None, True, float(i), 5) for i in range(300)]
    staged = []
    real = scans.stage
    monkeypatch.setattr(scans, "stage", lambda df: staged.append(real(df)) or staged[-1])
    got = callstats.running_mean(calls_of(spark, rows), rows_per_slice=30).collect()
    per_slice = [r["count"] for r in staged[-1].groupBy("_slice").count().collect()]
    assert len(per_slice) == 10 and max(per_slice) <= 60
    sums = {}
    for r in sorted(got, key=lambda r: r["event_id"]):
        sums.setdefault(r["model_name"], []).append(r["response_time"])
        assert r["success_count"] == len(sums[r["model_name"]])
        assert r["avg_response_time"] == pytest.approx(sum(sums[r["model_name"]]) / r["success_count"])
    assert len(got) == 300


def test_replies(spark):
    fence = "```"
    texts = ["not json", f"{fence}json\n{{\"files\":[{{\"file_id\":\"a\"}}]}}\n{fence}", '{"a":1} {"b":2}', "[]", "null", "{'files':[]}", f"{fence}\n{{}}{fence}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, reply string")
    got = {r["id"]: (len(r["files"]), r["reasoning"], r["confidence"]) for r in replies.parse_replies(df).collect()}
    bad = (0, replies.FAILED, 0.0)
    assert got[0] == bad and got[2] == bad and got[5] == bad
    assert got[1] == (1, "", 0.0) and got[6] == (0, "", 0.0)


def bundles_of(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "x = 'é'", 8, 0), ("r", "b/c.txt", 'say "hi"\n\U0001f600', 13, 60), ("r", "d.txt", "", 0, 60)],
        "repo string, relative_path string, content string, size long, at long",
    ).withColumn("last_modified", F.timestamp_seconds("at")).drop("at")
    asked = [("k", 1, "r", "b/c.txt"), ("k", 2, "r", "gone"), ("k", 3, "r", "a.py"), ("none", 1, "r", "gone")]
    asked += [("k", 3, "r", "d.txt")] + [("long", i, "r", "a.py") for i in range(500)]  # two at one position, one file often
    return files, spark.createDataFrame(asked, "bundle_id string, position long, repo string, relative_path string")


@pytest.mark.parametrize("mode", bundle.MODES)
def test_bundle_files_hold_the_rows_in_order(spark, tmp_path, mode):
    files, asked = bundles_of(spark)
    folder = str(tmp_path / "out")
    bundle.write(asked, files, folder, "2024-01-01 00:00:00", mode)
    rows = bundle.generate(asked, files, "2024-01-01 00:00:00", mode).collect()
    suffix = "md" if mode == "none" else "json"
    assert sorted(os.listdir(folder)) == [f"{n}.{suffix}" for n in ("k", "long", "none")]
    for name in ("k", "long", "none"):
        with open(f"{folder}/{name}.{suffix}", encoding="utf-8", newline="") as handle:
            got = handle.read()
        want = sorted((r["part"], r["position"], r["text"]) for r in rows if r["bundle_id"] == name)
        if mode == "none":
            tied = {(p, at): sorted(t for q, a, t in want if (q, a) == (p, at)) for p, at, _ in want}
            assert len(got) == sum(len(t) + 1 for *_, t in want) - 1
            place = 0
            for texts in tied.values():  # texts at one position may come in any order
                size = sum(len(t) + 1 for t in texts) - 1
                assert got[place : place + size] in {"\n".join(p) for p in itertools.permutations(texts)}
                place += size + 1
        else:
            found = json.loads(got)
            assert sorted(map(json.dumps, found)) == sorted(json.dumps(json.loads(t)) for *_, t in want)
            if name == "k":
                first = next(json.loads(t) for _, at, t in want if at == 1)
                assert found[0] == first
    sizes = {r["bundle_id"]: r["size"] for r in bundle.manifest(
        bundle.generate(asked, files, "2024-01-01 00:00:00", mode), asked, "s", mode).collect()}
    for name, size in sizes.items():
        with open(f"{folder}/{name}.{suffix}", encoding="utf-8", newline="") as handle:
            assert len(handle.read()) == size


def test_bundle_files_are_refused_replaced_and_aborted(spark, tmp_path):
    files, asked = bundles_of(spark)
    folder = str(tmp_path / "out")
    bundle.write(asked, files, folder, "t")
    with pytest.raises(Exception, match="Path exists"):
        bundle.write(asked, files, folder, "t")
    bundle.write(asked.filter("bundle_id = 'k'"), files, folder, "t", "semantic", overwrite=True)
    assert os.listdir(folder) == ["k.json"]
    bad = spark.createDataFrame([("x", 0, b"ab"), ("../y", 0, b"c")], "filename string, position long, data binary")
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("placed_files").option("path", folder).mode("overwrite").save()
    gap = spark.createDataFrame([("x", 0, b"ab"), ("x", 5, b"c")], "filename string, position long, data binary")
    with pytest.raises(Exception, match="overlap or leave gaps"):
        gap.write.format("placed_files").option("path", str(tmp_path / "gap")).mode("append").save()
    assert sorted(os.listdir(tmp_path)) == ["out"] and os.listdir(folder) == ["k.json"]
    none = asked.limit(0)
    bundle.write(none, files, str(tmp_path / "empty"), "t", "hybrid")
    assert os.listdir(tmp_path / "empty") == []


def test_section_of_an_unreadable_file(spark):
    files, asked = bundles_of(spark)
    error = F.when(F.col("relative_path") == "a.py", "Permission denied")
    rows = bundle.sections(asked.filter("bundle_id = 'k'"), files.withColumn("error", error)).collect()
    got = {r["relative_path"]: r["text"] for r in rows}
    assert got["a.py"].endswith("\n\n**Error reading file:** Permission denied\n\n---") and "x = " not in got["a.py"]
    assert "**Error" not in got["b/c.txt"]


def test_generations_survive_a_failure_between_the_steps(spark, tmp_path):
    store = tables.Generations(spark, str(tmp_path / "store"))
    assert store.current() is None and store.sweep() == []
    with pytest.raises(ValueError, match="no generation"):
        store.read()
    texts = spark.createDataFrame([("x",), ("y",), ("z",)], "text string")
    first = store.replace(archive.originals(texts))
    lost = store.write(archive.originals(texts.limit(1)))  # the job ends before the switch
    assert store.current() == first and store.read().count() == 3
    reader = store.read()
    named = archive.originals(spark.createDataFrame([("y",), ("q",)], "text string"))
    assert archive.sweep_store(store, named) == [lost]
    assert [r["content"] for r in store.read().collect()] == ["y"]
    assert reader.count() == 3  # one that began before the switch still finishes
    assert archive.sweep_store(store, named.limit(0)) == [first]
    assert store.read().collect() == []


def test_prompt_packs_hold_every_file_once_within_the_budget(spark):
    rows = [("a", f"{'x' * (i % 90)}/{i}.py", i) for i in range(400)] + [("b", "only.js", None), (None, "p.js", 1), ("a", "0.py", 7), ("a", "0.py", 7)]
    files = spark.createDataFrame(rows, "repo string, relative_path string, size long")
    packs = replies.packed_facts(files, budget=700, rows_per_slice=50)
    got = packs.orderBy("repo", "chunk").collect()
    assert max(r["n_chars"] for r in got) <= 700 and all(len(r["files_json"]) == r["n_chars"] for r in got)
    assert [r["chunk"] for r in got if r["repo"] == "a"] == list(range(sum(r["repo"] == "a" for r in got)))
    held = [(r["repo"], f["relative_path"]) for r in got for f in json.loads(r["files_json"])]
    assert held == sorted(((r, p) for r, p, _ in rows), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    asked = spark.createDataFrame([(i, r, "q") for i, r in enumerate(["a", "b", "c", None])], "query_id long, repo string, query string")
    prompts = {r["query_id"]: r for r in replies.prompts(asked, packs).collect()}
    assert prompts[1]["n_chunks"] == 1 and prompts[2]["n_chunks"] == 0 and prompts[0]["n_files"] == 402 and prompts[3]["n_files"] == 1
    text_of = one(spark, replies.rendered(F.lit(prompts[1]["opening"]), F.lit("[1]")))
    assert "**User Query (in Korean):** q\n\n**Project Structure:**\n[1]\n\n**Task:**" in text_of
    tight = replies.packed_facts(files, budget=10).collect()  # no fact fits: one file each, longer than the budget
    assert sum(r["n_files"] for r in tight) == 404
    assert replies.packed_facts(files.limit(0)).collect() == []


def test_archive_properties(spark):
    df = spark.createDataFrame([(0, ""), (1, "é\n" * 500)], "id int, text string")
    records = archive.lossless(df, ["id"])
    assert {r["id"]: r["content"] for r in archive.restore_lossless(records, ["id"]).collect()} == {0: "", 1: "é\n" * 500}
    facts = {r["id"]: r for r in records.collect()}
    assert facts[0]["compression_ratio"] == 0.0 and facts[1]["original_size"] == 1000 and facts[1]["compressed_size"] < 100


def test_balance_messages(spark):
    df = spark.createDataFrame([("{}()[]",), ("{(",), ("(]",)], "c string")
    got = {r["c"]: r["message"] for r in quality.bracket_balance(df, "c").collect()}
    assert got == {"{}()[]": "Syntax appears valid", "{(": "Mismatched braces: 1 vs 0", "(]": "Mismatched parentheses: 1 vs 0"}


def test_roots_with_one_folder_name_stay_apart(spark, tmp_path):
    for top in ("a", "b"):
        (tmp_path / top / "src").mkdir(parents=True)
        (tmp_path / top / "src" / "x.py").write_text("x = 1")
    assert tree.repo_names(["/a/src", "/b/src", "/c"]) == {"/a/src": "a/src", "/b/src": "b/src", "/c": "c"}
    spark.dataSource.register(tree.TreeSource)
    rows = spark.read.format("source_tree").option("path", f"{tmp_path}/a/src\n{tmp_path}/b/src").load()
    assert sorted((r["repo"], r["relative_path"]) for r in tree.files(rows).collect()) == [("a/src", "x.py"), ("b/src", "x.py")]


def test_decoding_replaces_broken_bytes(spark):
    from treeloom.sources import encoding

    rows = [("é".encode("utf-16"), "é"), (b"\xff\xfea\x00\x00\xd8", "a\ufffd"), (b"\xff\xfea", "\ufffd"), (b"\xef\xbb\xbfok", "ok"), (b"a\xff", "a\ufffd"), ("z".encode("utf-32"), "z"), (None, None)]
    df = spark.createDataFrame([(c,) for c, _ in rows], "content binary")
    assert [r["content"] for r in tree.decoded(df).collect()] == [t for _, t in rows]
    assert df.select(encoding.decode(F.col("content"))).count() == len(rows)


def test_highlight_folds_all_letters(spark):
    df = spark.createDataFrame([("\u00c9t\u00e9",)], "t string")
    assert df.select(text.highlight(F.col("t"), "\u00e9").alias("h")).first()["h"] == "<mark>\u00c9</mark>t<mark>\u00e9</mark>"


def test_archives_and_tree_reads_hold_parts_not_whole_batches(tmp_path):
    """What a task's Python holds of results is bounded in bytes, however many rows Spark sends or asks for at once."""
    big = [("x" * 1_000_000 + str(i)) if i % 5 else None for i in range(20)]
    packed = [a for a in archive._by_parts(iter([pa.array(big)]), lambda data: bytes(data), pa.binary())]
    assert [v.as_py() for a in packed for v in a] == [t and t.encode() for t in big]
    assert len(packed) > 4 and all(a.nbytes <= archive.PART + 2_000_000 for a in packed)
    assert [len(a) for a in archive._by_parts(iter([pa.array([], pa.string())]), lambda data: bytes(data), pa.binary())] == [0]
    for i in range(12):
        (tmp_path / f"f{i}.txt").write_bytes(b"y" * 500_000)
    for options in ({}, {"pushdown": "true"}):
        reader = tree.TreeSource({"path": str(tmp_path), "content": "true", **options}).reader(None)
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        assert all(isinstance(b, pa.RecordBatch) and b.nbytes <= tree.PART + 1_000_000 for b in batches) and len(batches) > 2
        rows = [r for b in batches for r in b.to_pylist() if r["kind"] == "file"]
        assert sorted(r["name"] for r in rows) == sorted(f"f{i}.txt" for i in range(12)) and all(len(r["content"]) == r["size"] == 500_000 for r in rows)
