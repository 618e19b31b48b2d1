"""The stored search index against the direct search, its plan, and how its work grows."""

from __future__ import annotations

import random

import pytest

from treeloom.operators import search, search_index

QUERIES = ["main", "MAIN.py", "src/app", "js", "a", "/", ".", "-", "py js main", "app test util main", "nope", "s", "main main", "src/app/main.py", "x y", "é", "../", "_"]


def paths(n, seed=1):
    rng = random.Random(seed)
    words = ["main", "app", "util", "test", "a", "mainly", "my_main", "é1", "x", "Src"]
    return [
        ("r" + str(rng.randrange(2)), "/".join(["src"] * (i % 2) + [rng.choice(words) for _ in range(rng.randrange(3))] + [f"{rng.choice(words)}{rng.choice(['', i])}{rng.choice(['.py', '.js', '-b.ts'])}"]))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def files(spark):
    rows = paths(300)
    return spark.createDataFrame(rows + rows[:5], "repo string, relative_path string").distinct()


@pytest.mark.parametrize("limit, rare", [(50, 4), (5, 1), (7, 0)])
def test_index_equals_direct_search(spark, files, tmp_path, monkeypatch, limit, rare):
    monkeypatch.setattr(search_index, "RARE", rare)
    index = search_index.build(files, str(tmp_path / "index"), 4)
    asked = [(i, q) for i, q in enumerate(QUERIES + QUERIES[:3] + ["", None])]
    got = search_index.search_many(index, spark.createDataFrame(asked, "query_id long, query string"), limit).collect()
    for i, query in asked:
        want = [(r.relative_path, r.repo, round(r.match_score, 6)) for r in search.search(files, query or "", limit).collect()]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.position)
        assert [(r.relative_path, r.repo, round(r.match_score, 6)) for r in mine] == want, query
    index.close()


@pytest.mark.parametrize("listed", [1000, 2])
def test_one_query_equals_direct_search(spark, files, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(search_index, "LISTED", listed)
    index = search_index.build(files, str(tmp_path / "index"), 4)
    for query in ("Main.py js", "/", "", "nope"):
        assert search_index.search(index, query).collect() == search.search(files, query).collect()


def test_only_the_buckets_of_a_term_are_read(spark, files, tmp_path):
    index = search_index.build(files, str(tmp_path / "index"), 8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = index.paths_of(["main"])._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    assert {r.relative_path for r in index.paths_of(["util"]).collect()} == {
        r.relative_path for r in files.collect() if "util" in __import__("re").findall(r"\w+", r.relative_path.lower())
    }


def test_an_index_is_opened_again(spark, files, tmp_path):
    path = str(tmp_path / "index")
    built = search_index.build(files, path, 4)
    want = search_index.search(built, "main").collect()
    built.close()
    assert search_index.search(search_index.SearchIndex(spark, path, 4), "main").collect() == want


def test_rows_grow_with_files_and_queries_not_with_their_product(spark, tmp_path):
    """Four times the files and four times the queries must not make sixteen times the rows."""
    counts = {}
    for n in (400, 1600):
        files = spark.createDataFrame([("r", f"src{i % 20}/en/mod_{i}.{('js', 'ts')[i % 2]}") for i in range(n)], "repo string, relative_path string")
        index = search_index.build(files, str(tmp_path / str(n)), 4)
        asked = spark.createDataFrame([(q,) for i in range(n // 4) for q in (f"mod_{i}.js", f"ts en mod_{3 * i}", f"src{i % 20}/en")], "asked string").distinct()
        counts[n] = sum(part.count() for part in search_index.candidates(index, asked, 5).values())
    assert counts[1600] <= 6 * counts[400]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "repo string, relative_path string")
    index = search_index.build(none, str(tmp_path / "none"), 4)
    asked = spark.createDataFrame([(1, "main"), (2, "/")], "query_id long, query string")
    assert search_index.search(index, "main").collect() == [] and search_index.search_many(index, asked).collect() == []
    some = search_index.build(spark.createDataFrame([("r", "main.py")], none.schema), str(tmp_path / "some"), 4)
    assert search_index.search_many(some, asked.limit(0)).collect() == []
