"""A stored search index over paths, and the best paths for many queries through it.

A path is split into runs: its words, and what stands between them. Three tables are kept under one folder:

- ``postings``: a row per distinct run and path, in buckets by run, sorted by run inside;
- ``terms``: the dictionary, a row per run with its number of paths;
- ``heads``: the first paths of each run, by path, as many as a search may return.

A word of a query lies inside one word of a path that contains it, and a query without words inside one run
between words, so substring probes go to the dictionary, never to all paths.

The score of a path for a query is 20 times the share of query words that are words of the path, and a part
for paths that contain the whole query. So the best paths of a query are among

1. paths that contain the query, ranked by their whole score, once per distinct query text;
2. paths with a rare word of the query, all of them;
3. for the query's frequent words, the paths with most of them, ranked once per distinct set of such words:
   two or more words meet in the postings of all but the most frequent one, and of paths with one word only
   the first can be among the best, which are the word's head;
4. for each distinct token, the first paths that contain it anywhere: the first of the heads of its runs.

Any other path comes after as many as a search returns. These candidates are scored in full, and query ids are
joined last, so rows before a rank grow with the files and the distinct queries, not with their product.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import lookups, text
from treeloom.operators.inventory import KEY
from treeloom.operators.matching import contains_pairs
from treeloom.operators.search import _score, _spaced
from treeloom.session import stage, stage_root

BUCKETS = 32
FEW = 8  # buckets of an index that lasts for one job
LISTED = 1000  # matched runs that a single search names in its filter, so that other buckets are not read
RARE = 4  # a word is rare if it has at most this many times as many paths as a search returns

RUNS = r"(?U)(\w+|\W+)"


def runs(path: Column) -> Column:
    """Distinct words of a lower-cased path and the runs between them."""
    return F.array_distinct(F.regexp_extract_all(path, F.lit(RUNS), F.lit(1)))


class SearchIndex:
    """The three tables of an index written at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.name = f"search_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (term STRING, repo STRING, relative_path STRING) USING parquet "
            f"CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{path}/postings'"
        )
        self.buckets = buckets

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, n_files long").parquet(f"{self.path}/terms")

    @property
    def heads(self) -> DataFrame:
        return self.spark.read.schema("term string, repo string, relative_path string").parquet(f"{self.path}/heads")

    def paths_of(self, terms: list[str]) -> DataFrame:
        """Paths that have one of a few runs; only their buckets are read."""
        return self.postings.filter(F.col("term").isin(terms)).select(*KEY).distinct()

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def build(files: DataFrame, path: str, buckets: int = BUCKETS, limit: int = lookups.SEARCH_LIMIT) -> SearchIndex:
    """Write an index of ``files`` at ``path``; ``limit`` is the most that a search may return.

    Rows are dealt by bucket and path before they are written, so a run that most paths have is spread over
    several tasks and files.
    """
    index = SearchIndex(files.sparkSession, path, buckets)
    rows = files.select(*KEY).distinct().select(F.explode(runs(F.lower("relative_path"))).alias("term"), *KEY)
    bucket, salt = F.pmod(F.hash("term"), F.lit(buckets)), F.pmod(F.xxhash64(*KEY), F.lit(4))
    rows.repartition(bucket, salt).write.insertInto(index.name)
    index.postings.groupBy("term").agg(F.count("*").alias("n_files")).sort("term").write.parquet(f"{path}/terms")
    first = F.row_number().over(Window.partitionBy("term").orderBy("relative_path", "repo"))
    index.postings.withColumn("place", first).filter(F.col("place") <= limit).drop("place").write.parquet(f"{path}/heads")
    return index


def build_temporary(files: DataFrame) -> SearchIndex:
    """An index in the shared folder for staged tables."""
    spark = files.sparkSession
    return build(files, f"{stage_root(spark)}/treeloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}", FEW)


def _tokens(asked: Column) -> Column:
    """The words of a query, or all of it if it has none."""
    words = F.array_distinct(text.words(asked))
    return F.when(F.size(words) > 0, words).otherwise(F.array(asked))


def _scored(rows: DataFrame) -> DataFrame:
    """``rows`` (asked, repo, relative_path) with their score."""
    folded = F.lower("relative_path")
    asked = F.col("asked")
    return rows.withColumn("match_score", _score(folded, _spaced(F.col("relative_path")), asked, F.array_distinct(text.words(asked))))


def search(index: SearchIndex, query: str, limit: int = lookups.SEARCH_LIMIT) -> DataFrame:
    """Best ``limit`` paths for one query, ties by path. An empty query finds nothing."""
    asked = query.lower()
    if not asked:
        return index.postings.select(*KEY, F.lit(0.0).alias("match_score")).limit(0)
    wanted = _tokens(F.lit(asked))
    matched = index.terms.filter(F.exists(wanted, lambda t: F.contains(F.col("term"), t))).select("term")
    listed = [r.term for r in matched.limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        hits = index.paths_of(listed)
    else:
        hits = index.postings.join(matched, "term", "left_semi").select(*KEY).distinct()
    return (
        _scored(hits.withColumn("asked", F.lit(asked))).select(*KEY, "match_score")
        .orderBy(F.desc("match_score"), "relative_path", "repo")
        .limit(limit)
    )


def _first(rows: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "relative_path", "repo"))
    return rows.withColumn("position", rank).filter(F.col("position") <= limit)


def candidates(index: SearchIndex, asked: DataFrame, limit: int = lookups.SEARCH_LIMIT) -> dict[str, DataFrame]:
    """Paths among which the best of each distinct query lie: (asked, repo, relative_path), by where they come from.

    ``asked`` has the distinct lower-cased queries.
    """
    tokens = stage(asked.select("asked", F.explode(_tokens(F.col("asked"))).alias("token"), (F.size(text.words(F.col("asked"))) > 0).alias("words")))
    probes = stage(contains_pairs(index.terms, "term", tokens.select("token").distinct(), "token"))
    exact = tokens.filter("words").join(index.terms.withColumnRenamed("term", "token"), "token").select("asked", "token", "n_files")
    rare = exact.filter(F.col("n_files") <= RARE * limit).select("asked", "token")
    often = stage(
        exact.filter(F.col("n_files") > RARE * limit).groupBy("asked")
        .agg(F.sort_array(F.collect_list(F.struct("n_files", "token"))).getField("token").alias("often"))
    )
    sets = often.select("often").distinct().filter(F.size("often") > 1).select(
        "often", F.explode(F.slice("often", F.lit(1), F.size("often") - 1)).alias("term")
    )
    # A path that contains the query contains each of its tokens, so one token's paths are enough.
    matches = probes.groupBy("token").agg(F.sum("n_files").alias("n"))
    fewest = tokens.join(matches, "token", "left").groupBy("asked").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    )
    none = F.lit(None)
    text_of, set_of = none.cast("string").alias("asked"), none.cast("array<string>").alias("often")
    wanted = (
        fewest.join(probes, "token").select(F.lit("whole").alias("kind"), "asked", set_of, "term")
        .unionByName(rare.select(F.lit("rare").alias("kind"), "asked", set_of, F.col("token").alias("term")))
        .unionByName(sets.select(F.lit("sets").alias("kind"), text_of, "often", "term"))
    )
    met = wanted.join(index.postings, "term").drop("term")
    # Which postings a query meets is decided before they are ranked, so this is staged once for three readers.
    met = stage(met.filter((F.col("kind") != "whole") | F.contains(F.lower("relative_path"), F.col("asked"))))
    spaced = _spaced(F.col("relative_path"))
    shared = F.size(F.filter("often", lambda w: F.contains(spaced, F.concat(F.lit(" "), w, F.lit(" ")))))
    several = _first(
        met.filter("kind = 'sets'").select("often", *KEY).distinct().withColumn("shared", shared).filter("shared > 1"),
        ["often"], limit, F.desc("shared"),
    )
    whole = _first(_scored(met.filter("kind = 'whole'").select("asked", *KEY).distinct()), ["asked"], limit, F.desc("match_score"))
    weak = _first(probes.select("token", "term").join(index.heads, "term").select("token", *KEY).distinct(), ["token"], limit)
    single = often.select("asked", F.explode("often").alias("term")).join(index.heads, "term")
    found = {
        "whole": whole,
        "rare": met.filter("kind = 'rare'"),
        "sets": often.join(several, "often"),
        "single": single,
        "weak": tokens.join(weak, "token"),
    }
    return {k: v.select("asked", *KEY) for k, v in found.items()}


def search_many(index: SearchIndex, queries: DataFrame, limit: int = lookups.SEARCH_LIMIT) -> DataFrame:
    """The best ``limit`` paths of each query ``(query_id, query)``: query_id, position, repo, relative_path, match_score.

    Equal queries are searched once; their ids are joined to the ranked paths. ``limit`` is at most that of the
    index. Empty and null queries find nothing.
    """
    ids = queries.filter("query <> ''").select("query_id", F.lower("query").alias("asked"))
    asked = stage(ids.select("asked").distinct())
    rows = None
    for part in candidates(index, asked, limit).values():
        rows = part if rows is None else rows.unionByName(part)
    best = _first(_scored(rows.distinct()), ["asked"], limit, F.desc("match_score"))
    return ids.join(best, "asked").select("query_id", "position", *KEY, "match_score")
