"""Model replies and prompts as data: parsing what came back, preparing what is sent. No calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import paths, text
from treeloom.operators.scans import running_sums
from treeloom.session import stage

# The reply layout and what stands in for a reply that is not JSON.
FILES = "array<struct<file_id string, relative_path string, reason string, confidence double>>"
REPLY = f"array<struct<files {FILES}, reasoning string, confidence double>>"
FAILED = "Failed to parse AI response"


# The prompt.
OPENING = (
    "You are an expert code analyzer. Analyze the following project structure and identify files related to the user's query.\n\n"
    "**User Query (in Korean):** "
)
STRUCTURE = "\n\n**Project Structure:**\n"
TASK = """

**Task:**
1. Understand the user's intent from the Korean query
2. Analyze each file's path, name, and extension
3. Identify files that are likely related to the query
4. Provide reasoning for each selection

**Output Format (JSON):**
{
    "files": [
        {
            "file_id": "unique_file_identifier",
            "relative_path": "path/to/file.ext",
            "reason": "Why this file is relevant",
            "confidence": 0.95
        }
    ],
    "reasoning": "Overall analysis explanation in Korean",
    "confidence": 0.85
}

**Selection Criteria:**
- File names and paths that suggest relevant functionality
- Common patterns (e.g., "upload", "download", "transfer" for file transfer)
- File types that typically contain such logic (e.g., .py, .js for backend/frontend)
- Configuration files that might define related settings

Respond ONLY with valid JSON, no additional text."""


def unfenced(reply: Column) -> Column:
    """Reply without the code fence around it."""
    opened = F.regexp_replace(F.regexp_replace(text.strip(reply), r"\A```json", ""), r"\A```", "")
    return text.strip(F.regexp_replace(opened, r"```\z", ""))


def parse_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Add ``files``, ``reasoning`` and ``confidence``; a failed reply gets the stand-in.

    The text is parsed as the single element of an array, so anything before, after or beside
    one object makes it invalid.
    """
    wrapped = F.concat(F.lit("["), unfenced(F.col(column)), F.lit("]"))
    parsed = replies.withColumn("_reply", F.from_json(wrapped, REPLY, {"allowSingleQuotes": "false"}))
    valid = F.coalesce((F.size("_reply") == 1) & F.get("_reply", F.lit(0)).isNotNull(), F.lit(False))
    one = F.get("_reply", F.lit(0))
    return parsed.withColumns(
        {
            "files": F.coalesce(F.when(valid, one["files"]), F.array().cast(FILES)),
            "reasoning": F.when(valid, F.coalesce(one["reasoning"], F.lit(""))).otherwise(FAILED),
            "confidence": F.when(valid, F.coalesce(one["confidence"], F.lit(0.0))).otherwise(0.0),
        }
    ).drop("_reply")


def reply_files(parsed: DataFrame, key: list[str]) -> DataFrame:
    """One row per file named by a reply, in its order."""
    return parsed.select(*key, F.posexplode("files").alias("position", "f")).select(*key, "position", "f.*")


def confidence_band(confidence: Column) -> Column:
    """Display band of a confidence."""
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").otherwise("low")


def file_fact_chunks(files: DataFrame, per_chunk: int = 2000) -> DataFrame:
    """File facts as JSON arrays, in chunks of about ``per_chunk`` files of one folder.

    A prompt can hold only so much; big folders are cut by path hash, so no repository or folder
    is gathered as a whole and every file is in exactly one chunk.
    """
    listed = files.select(
        "repo",
        paths.parent(F.col("relative_path")).alias("folder"),
        "relative_path",
        paths.file_id(F.col("relative_path")).alias("id"),
        paths.extension(F.col("relative_path")).alias("extension"),
        "size",
    )
    sizes = listed.groupBy("repo", "folder").agg(F.ceil(F.count("*") / per_chunk).alias("n_chunks"))
    return (
        listed.join(sizes, ["repo", "folder"])
        .withColumn("chunk", F.expr("pmod(xxhash64(relative_path), n_chunks)"))
        .groupBy("repo", "folder", "chunk")
        .agg(
            F.count("*").alias("n_files"),
            F.to_json(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("relative_path", "id", "extension", "size"))),
                    lambda f: F.struct(f["id"].alias("id"), f["relative_path"].alias("relative_path"),
                                       f["extension"].alias("extension"), f["size"].alias("size")),
                )
            ).alias("files_json"),
        )
    )


def packed_facts(files: DataFrame, budget: int = 100_000, rows_per_slice: int = 1_000_000) -> DataFrame:
    """File facts packed in path order into chunks of at most ``budget`` characters: ``(repo, chunk, n_files, n_chars, files_json)``.

    A chunk takes the files whose facts start in one stretch of the repository's list. A stretch is
    shorter than the budget by the repository's longest fact, so no chunk is longer than the budget
    unless a single fact is. Every file is in one chunk, ``chunk`` counts from 0 without gaps. Only a chunk's own facts
    are ever gathered.
    """
    fact = F.struct(
        paths.file_id(F.col("relative_path")).alias("id"), "relative_path",
        paths.extension(F.col("relative_path")).alias("extension"), "size",
    )
    listed = stage(
        files.select("repo", "relative_path", F.monotonically_increasing_id().alias("_row"), F.to_json(fact).alias("fact"))
    )
    longest = listed.groupBy("repo").agg(F.max(F.length("fact") + 1).alias("longest"))
    # Two brackets around, one comma after each fact.
    width = F.greatest(F.lit(budget - 2) - F.col("longest"), F.lit(1))
    summed = running_sums(listed, ["repo"], ["relative_path", "_row"], {"end": (F.length("fact") + 1).cast("long")}, rows_per_slice)
    start = F.col("end") - F.length("fact") - 1
    placed = summed.alias("s").join(longest.alias("l"), F.col("s.repo").eqNullSafe(F.col("l.repo"))).select(
        "s.repo", "relative_path", "_row", "fact", F.floor(start / width).alias("stretch")
    )
    ordered = F.array_sort(F.collect_list(F.struct("relative_path", "_row", "fact")))
    packed = stage(
        placed.groupBy("repo", "stretch").agg(
            F.count("*").alias("n_files"),
            F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda f: f["fact"]), ","), F.lit("]")).alias("files_json"),
        )
    )
    numbers = running_sums(packed.select("repo", "stretch"), ["repo"], ["stretch"], {"number": F.lit(1).cast("long")}, rows_per_slice)
    same = F.col("p.repo").eqNullSafe(F.col("n.repo")) & (F.col("p.stretch") == F.col("n.stretch"))
    return packed.alias("p").join(numbers.alias("n"), same).select(
        "p.repo", (F.col("n.number") - 1).alias("chunk"), "n_files", F.length("files_json").alias("n_chars"), "files_json"
    )


def prompts(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per query ``(query_id, repo, query)``: its opening and how many chunks of its repository follow.

    The prompts of a query are its opening with each chunk in turn, ``rendered`` as they are sent; chunks
    are kept once per repository, so rows are queries and chunks, not their product. A query on a
    repository without files has no chunk.
    """
    counts = chunks.groupBy(F.col("repo").alias("_repo")).agg(F.count("*").alias("n_chunks"), F.sum("n_files").alias("n_files"))
    return queries.join(counts, F.col("repo").eqNullSafe(F.col("_repo")), "left").drop("_repo").withColumns(
        {
            "opening": F.concat(F.lit(OPENING), F.coalesce("query", F.lit("")), F.lit(STRUCTURE)),
            "n_chunks": F.coalesce("n_chunks", F.lit(0)).cast("long"),
            "n_files": F.coalesce("n_files", F.lit(0)).cast("long"),
        }
    )


def rendered(opening: Column, files_json: Column) -> Column:
    """The text of one prompt: a query's opening, one chunk, the task."""
    return F.concat(opening, files_json, F.lit(TASK))
