"""Path search with scores over the paths themselves; ``search_index`` searches a stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import lookups, paths, text
from treeloom.operators.inventory import KEY


def _spaced(path: Column) -> Column:
    """Lower-cased words of a path, each between spaces, so that a word is found by ``contains``."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(path), r"(?U)\W+", " "), F.lit(" "))


def _score(folded: Column, spaced: Column, query: Column, asked_words: Column) -> Column:
    base = paths.name(folded)
    place = (
        F.when(base == query, 100.0)
        .when(F.contains(base, query), 50.0)
        .when(F.contains(folded, query), 25.0)
        .otherwise(0.0)
    )
    shared = F.size(F.filter(asked_words, lambda w: F.contains(spaced, F.concat(F.lit(" "), w, F.lit(" ")))))
    overlap = F.when(F.size(asked_words) > 0, shared / F.size(asked_words) * 20.0).otherwise(0.0)
    return place + overlap + F.when(folded.startswith(query), 10.0).otherwise(0.0)


def match_score(path: Column, query: Column) -> Column:
    """Score of a path for a lower-cased query.

    100 for the whole file name, 50 for a part of it, 25 for a part of the path; up to 20 for
    the share of query words among the path words; 10 when the path starts with the query.
    """
    return _score(F.lower(path), _spaced(path), query, F.array_distinct(text.words(query)))


def _tokens(query: Column) -> Column:
    """What a path may contain to match: any word of the query or all of it."""
    return F.array_union(text.words(query), F.array(query))


def search(files: DataFrame, query: str, limit: int = lookups.SEARCH_LIMIT) -> DataFrame:
    """Best ``limit`` paths for one query, ties by path. An empty query finds nothing."""
    if not query:
        return files.select(*KEY, F.lit(0.0).alias("match_score")).limit(0)
    asked = F.lower(F.lit(query))
    folded = F.lower("relative_path")
    hit = F.exists(_tokens(asked), lambda token: F.contains(folded, token))
    return (
        files.filter(hit)
        .select(*KEY, match_score(F.col("relative_path"), asked).alias("match_score"))
        .orderBy(F.desc("match_score"), "relative_path", "repo")
        .limit(limit)
    )


def postings(files: DataFrame) -> DataFrame:
    """Inverted index rows ``(term, repo, file_id)``: file-name words and the whole path.

    Kept as rows: a list per term would put a frequent term into one record.
    """
    folded = F.lower("relative_path")
    terms = F.array_union(text.words(paths.name(folded)), F.array(folded))
    return files.select(
        "repo", paths.file_id(F.col("relative_path")).alias("file_id"), F.explode(terms).alias("term")
    ).distinct()


def term_counts(files: DataFrame) -> DataFrame:
    """Number of files per index term."""
    return postings(files).groupBy("term").agg(F.count("*").alias("n_files"))
