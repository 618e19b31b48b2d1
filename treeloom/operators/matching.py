"""Name matching: substring joins without comparing every text with every name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import paths, text
from treeloom.operators.inventory import KEY
from treeloom.session import stage, stage_counted


# Substring lengths used as join keys. Longer ones tell needles apart better, at the price of more keys per text.
GRAM_SIZES = (1, 2, 3, 6)


def _grams(value: Column, n: int | Column) -> Column:
    """Distinct substrings of length ``n``; none when the value is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.sequence(F.lit(1), F.length(value) - n + 1)
    return F.when(
        F.length(value) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, n)))
    ).otherwise(F.array().cast("array<string>"))


def _all_grams(value: Column, sizes: list[int]) -> Column:
    return F.concat(*[_grams(value, n) for n in sizes])


def contains_pairs(
    texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str, scope: list[str] | None = None
) -> DataFrame:
    """All ``(text row, needle row)`` pairs where the text contains the needle.

    A text that contains a needle also contains each substring of it, so an equi-join on one
    substring per needle finds all pairs; ``contains`` then removes the false ones. The key has
    the largest length that fits and is the rarest such substring. ``scope``
    names columns of both tables that must be equal as well; all other column names must
    differ. Needles and keys are staged, so the joins are broadcasts only where their real size
    allows that; otherwise rows are shuffled by key and adaptive execution splits frequent ones.
    """
    scope = scope or []
    length = F.length("_needle")
    # Needles per length are counted while they are staged; the last count is for all longer ones.
    lengths = range(1, max(GRAM_SIZES) + 2)
    per_length = F.array(*[F.count_if(F.least(length, F.lit(lengths[-1])) == n) for n in lengths])
    needles, counts = stage_counted(
        needles.withColumn("_needle", F.col(needle_col)).filter("_needle <> ''"), per_length
    )
    size_of = {n: max(g for g in GRAM_SIZES if g <= n) for n, count in zip(lengths, counts) if count}
    size = F.lit(GRAM_SIZES[0])
    for n in GRAM_SIZES[1:]:
        size = F.when(length >= n, n).otherwise(size)
    wanted = needles.select(*scope, "_needle").distinct().withColumn("_size", size)
    exact = wanted.filter(length == F.col("_size")).select(*scope, "_needle", F.col("_needle").alias("_gram"))
    keys = exact
    longer_sizes = sorted({g for n, g in size_of.items() if n > g})
    if longer_sizes:
        longer = wanted.filter(length > F.col("_size"))
        candidates = (
            longer.select("_needle", "_size").distinct()
            .select("_needle", F.explode(_grams(F.col("_needle"), F.col("_size"))).alias("_gram"))
        )
        frequency = (
            texts.select(F.explode(_all_grams(F.col(text_col), longer_sizes)).alias("_gram"))
            .join(candidates.select("_gram").distinct(), "_gram", "left_semi")
            .groupBy("_gram")
            .agg(F.count("*").alias("_n"))
        )
        rarest = (
            candidates.join(frequency, "_gram", "left")
            .groupBy("_needle")
            .agg(
                F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"),
                F.count_if(F.col("_n").isNull()).alias("_absent"),
            )
            # A needle with a substring that no text has cannot match.
            .filter("_absent = 0")
            .select("_needle", "_gram")
        )
        keys = stage(exact.unionByName(longer.drop("_size").join(rarest, "_needle")))
    sizes = sorted(set(size_of.values())) or [1]
    return (
        texts.withColumn("_gram", F.explode(_all_grams(F.col(text_col), sizes)))
        .join(keys, [*scope, "_gram"])
        .filter(F.contains(F.col(text_col), F.col("_needle")))
        .drop("_gram")
        .join(needles, [*scope, "_needle"])
        .drop("_needle")
    )


def parse_names(spark: SparkSession, pasted: str) -> DataFrame:
    """Names from a pasted list, separated by newlines or commas."""
    return parse_name_lists(spark.createDataFrame([(pasted,)], "pasted string"), "pasted").select("position", "name")


def parse_name_lists(lists: DataFrame, column: str) -> DataFrame:
    """The same for a column of pasted lists; blank names are dropped."""
    return (
        lists.select("*", F.posexplode(F.split(column, r"[\n,]")).alias("position", "name"))
        .withColumn("name", text.strip(F.col("name")))
        .filter("name <> ''")
    )


def bulk_select(files: DataFrame, names: DataFrame) -> DataFrame:
    """One row per file and name whose lower-cased form occurs in the lower-cased path."""
    folded = files.select(*KEY, F.lower("relative_path").alias("_path"))
    wanted = names.select("name", F.lower("name").alias("_name")).distinct()
    return contains_pairs(folded, "_path", wanted, "_name").select(*KEY, "name")


def not_found(names: DataFrame, matches: DataFrame) -> DataFrame:
    """Names without any match."""
    return names.select("name").distinct().join(matches.select("name").distinct(), "name", "left_anti")


def priority_select(files: DataFrame, names: DataFrame) -> DataFrame:
    """Per name the first file in tree order whose path contains it, case-sensitive.

    A path that equals the name or ends with it contains it too, so one test covers all.
    """
    texts = files.select(*KEY, F.col("relative_path").alias("_path"))
    wanted = names.select("name", F.col("name").alias("_name")).distinct()
    return (
        contains_pairs(texts, "_path", wanted, "_name")
        .groupBy("repo", "name")
        .agg(F.min_by("relative_path", paths.sort_key(F.col("relative_path"))).alias("relative_path"))
    )


def suggest_missing(missing: DataFrame, files: DataFrame) -> DataFrame:
    """A replacement for each missing path ``(repo, missing_path)`` of a repository.

    Exact path: confidence 1.0. Otherwise the first file in tree order whose name equals the
    missing name (0.8) or where one name contains the other (0.5). Otherwise null. File names
    are collapsed to their first file before they are matched, so a name used by very many files
    counts once.
    """
    wanted = missing.select("repo", "missing_path").distinct()
    exact = wanted.join(
        files.select("repo", F.col("relative_path").alias("missing_path")), ["repo", "missing_path"], "left_semi"
    ).select("repo", "missing_path", F.col("missing_path").alias("suggested_path"), F.lit(1.0).alias("confidence"))
    rest = wanted.join(exact.select("repo", "missing_path"), ["repo", "missing_path"], "left_anti").withColumn(
        "missing_name", paths.name(F.col("missing_path"))
    )
    first_by_name = files.groupBy("repo", paths.name(F.col("relative_path")).alias("name")).agg(
        F.min(F.struct(paths.sort_key(F.col("relative_path")).alias("key"), "relative_path")).alias("first")
    )
    missing_names = rest.select("repo", "missing_name").distinct()
    columns = ["repo", "missing_name", "name", "first"]
    longer = contains_pairs(first_by_name, "name", missing_names, "missing_name", ["repo"]).select(columns)
    shorter = contains_pairs(missing_names, "missing_name", first_by_name, "name", ["repo"]).select(columns)
    best = (
        longer.unionByName(shorter)
        .withColumn("confidence", F.when(F.col("name") == F.col("missing_name"), 0.8).otherwise(0.5))
        .groupBy("repo", "missing_name")
        .agg(F.min_by(F.struct(F.col("first.relative_path").alias("path"), "confidence"), "first").alias("best"))
    )
    similar = rest.join(best, ["repo", "missing_name"], "left").select(
        "repo",
        "missing_path",
        F.col("best.path").alias("suggested_path"),
        F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"),
    )
    reason = (
        F.when(F.col("confidence") == 1.0, F.lit("Exact path match found"))
        .when(F.col("confidence") == 0.8, F.concat(F.lit("Filename matches: "), "suggested_path"))
        .when(F.col("confidence") == 0.5, F.concat(F.lit("Similar filename: "), "suggested_path"))
        .otherwise(F.lit("File not found"))
    )
    return exact.unionByName(similar).withColumn("reason", reason)
