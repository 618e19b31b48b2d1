"""Bundles: one Markdown document per request, built and read as rows.

A bundle may be of any size, so it is never one string: it is rows ``(bundle_id, part, position,
text)`` whose order gives the document and whose texts are joined by newlines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import paths, text
from treeloom.operators import archive
from treeloom.operators.inventory import KEY
from treeloom.operators.scans import running_sums
from treeloom.operators.structure import summaries
from treeloom.session import stage
from treeloom.sources import bundle_files

# Bundle modes.
MODES = ("none", "semantic", "lossless", "hybrid")

# Parts of the document in order.
HEADER, CONTENTS, RULE, SECTION = 0, 1, 2, 3


def check_mode(mode: str) -> str:
    """Refuse an unknown bundle mode."""
    if mode not in MODES:
        raise ValueError(f"bundle mode must be one of {', '.join(MODES)}")
    return mode


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _bold(label: str, value: Column, end: str = "") -> Column:
    return F.concat(F.lit(f"**{label}:** "), value, F.lit(end))


def section(content: Column = None, error: Column = None) -> Column:
    """Section of one file: heading, size, time, fenced content, or the reason it cannot be read."""
    path = F.col("relative_path")
    content = F.col("content") if content is None else content
    failed = F.lit(None).cast("string") if error is None else error
    body = F.when(failed.isNotNull(), F.concat(F.lit("**Error reading file:** "), failed)).otherwise(
        _lines(F.concat(F.lit("```"), paths.language(path)), content, "```")
    )
    return _lines(
        F.concat(F.lit("\n## "), path, F.lit("\n")),
        _bold("File Size", text.human_size(F.col("size")), "  "),
        _bold("Last Modified", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"), "  "),
        "",
        body,
        "\n---",
    )


def contents(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Table-of-contents lines; the number is the position asked for, unknown files leave gaps."""
    path = F.col("relative_path")
    known = requests.join(files.select(*KEY).distinct(), KEY, "left_semi")
    line = F.concat(
        F.col("position").cast("string"), F.lit(". ["), path, F.lit("](#"), paths.file_id(path), F.lit(")")
    )
    return known.select("bundle_id", "position", line.alias("text"))


def sections(requests: DataFrame, files: DataFrame) -> DataFrame:
    """One section per requested file that exists; a file with an ``error`` states it in place of its content."""
    error = F.col("error") if "error" in files.columns else None
    return requests.join(files, KEY).select("bundle_id", "position", *KEY, section(error=error).alias("text"))


def parts(requests: DataFrame, files: DataFrame, generated_at: str, mode: str = "none") -> DataFrame:
    """All rows of the bundles asked for in ``requests(bundle_id, position, repo, relative_path)``."""
    check_mode(mode)
    asked = requests.groupBy("bundle_id").agg(F.count("*").alias("n"), F.min("repo").alias("root"))
    zero = F.lit(0).cast("long")
    header = _lines(
        "# Aggregated Source Code",
        F.concat(F.lit("\n"), _bold("Generated at", F.lit(generated_at))),
        _bold("Root Directory", F.concat(F.lit("`"), "root", F.lit("`"))),
        _bold("Total Files", F.col("n").cast("string")),
        _bold("Compression Type", F.lit(mode)),
        "\n## Table of Contents\n",
    )

    def rows(df: DataFrame, part: int, position: Column, value: Column) -> DataFrame:
        return df.select("bundle_id", F.lit(part).alias("part"), position.cast("long").alias("position"), value.alias("text"))

    return (
        rows(asked, HEADER, zero, header)
        .unionByName(rows(contents(requests, files), CONTENTS, F.col("position"), F.col("text")))
        .unionByName(rows(asked, RULE, zero, F.lit("\n---\n")))
        .unionByName(rows(sections(requests, files), SECTION, F.col("position"), F.col("text")))
    )


def reduced(requests: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """Rows of a bundle that is a JSON array, one record ``text`` per requested file that exists.

    ``semantic`` has the summaries; ``hybrid`` adds to each the hash and name of the stored original and the
    original itself; ``lossless`` has the packed content.
    """
    wanted = files.join(requests.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "content")
    if check_mode(mode) == "semantic":
        records = summaries(wanted).select(*KEY, F.col("summary").alias("text"))
    elif mode == "hybrid":
        both = archive.hybrid(wanted.join(summaries(wanted).select(*KEY, "summary"), KEY), KEY, "content", "summary")
        records = both.select(*KEY, F.to_json(F.struct("structure", "hash", "filename", "original_content")).alias("text"))
    elif mode == "lossless":
        packed = archive.lossless(wanted, KEY, "content")
        records = packed.select(*KEY, F.to_json(F.struct("relative_path", "hash", "encoding", "data")).alias("text"))
    else:
        raise ValueError("a plain bundle is made of parts")
    return requests.join(records, KEY).select("bundle_id", F.lit(SECTION).alias("part"), F.col("position").cast("long").alias("position"), *KEY, "text")


def generate(requests: DataFrame, files: DataFrame, generated_at: str, mode: str = "none") -> DataFrame:
    """Rows ``(bundle_id, part, position, text)`` of the bundles in their mode's form."""
    return parts(requests, files, generated_at) if check_mode(mode) == "none" else reduced(requests, files, mode).drop(*KEY)


def manifest(bundle_parts: DataFrame, requests: DataFrame, stamp: str, mode: str = "none") -> DataFrame:
    """One row per bundle: file name, characters as written, files asked for, mode.

    ``bundle_parts`` are the rows of ``generate``: lines of Markdown, or elements of one JSON array.
    """
    asked = requests.groupBy("bundle_id").agg(F.count("*").alias("file_count"))
    # Joined by single newlines or commas, so one fewer of these than rows; an array has two brackets.
    ends = -1 if mode == "none" else 1
    sizes = bundle_parts.groupBy("bundle_id").agg((F.sum(F.length("text")) + F.count("*") + ends).alias("size"))
    suffix = "md" if mode == "none" else "json"
    return sizes.join(asked, "bundle_id").select(
        "bundle_id",
        F.lit(f"source_code_{check_mode(mode)}_{stamp}.{suffix}").alias("filename"),
        "size",
        "file_count",
        F.lit(mode).alias("compression_type"),
    )


def semantic_metadata(requests: DataFrame, files: DataFrame, bundle_parts: DataFrame) -> DataFrame:
    """Size of a bundle before and after it is reduced to summaries.

    The reduced size is that of the compact JSON array of the summaries.
    """
    chosen = requests.select("bundle_id", *KEY)
    wanted = files.join(chosen.select(*KEY).distinct(), KEY, "left_semi")
    reduced = (
        chosen.join(summaries(wanted), KEY)
        .groupBy("bundle_id")
        .agg((F.sum(F.length("summary")) + F.count("*") + 1).alias("compressed_size"), F.count("*").alias("files_count"))
    )
    sizes = bundle_parts.groupBy("bundle_id").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("original_size"))
    return sizes.join(reduced, "bundle_id").withColumns(
        {
            "compression_ratio": text.percent(F.col("compressed_size"), F.col("original_size")),
            "compression_type": F.lit("semantic_lossy"),
        }
    )


def placed(requests: DataFrame, files: DataFrame, generated_at: str, mode: str = "none", rows_per_slice: int = 100_000) -> DataFrame:
    """Bundles as rows ``(bundle_id, position, data)``: bytes, and the byte of the bundle's file they start at.

    A plain bundle is its parts joined by newlines. The others are one JSON array; without elements it
    is ``[]``. Places are running sums over narrow rows; texts are
    staged once and meet their place by row number.
    """
    check_mode(mode)
    missing = F.lit("" if mode == "none" else "null")
    numbered = generate(requests, files, generated_at, mode).withColumns(
        {"text": F.coalesce("text", missing), "_row": F.monotonically_increasing_id()}
    )
    texts = stage(numbered)
    sizes = texts.select("bundle_id", "part", F.col("position").alias("at"), "_row", F.octet_length("text").cast("long").alias("n"))
    order = ["part", "at", "_row"]
    summed = running_sums(sizes, ["bundle_id"], order, {"rank": F.lit(1).cast("long"), "end": F.col("n") + 1}, rows_per_slice)
    # Every piece but the first of a plain bundle begins with one byte that sets it apart.
    lead = F.when(F.col("rank") > 1, "\n" if mode == "none" else ",").otherwise("" if mode == "none" else "[")
    start = F.col("end") - F.col("n") - 1
    if mode == "none":
        start = start - F.when(F.col("rank") > 1, 1).otherwise(0)
    places = summed.select("_row", lead.alias("lead"), start.alias("position"))
    pieces = texts.drop("position").join(places, "_row").select(
        "bundle_id", "position", F.encode(F.concat("lead", "text"), "UTF-8").alias("data")
    )
    if mode == "none":
        return pieces
    lengths = sizes.groupBy("bundle_id").agg(F.sum(F.col("n") + 1).alias("length"))
    last = requests.select("bundle_id").distinct().join(lengths, "bundle_id", "left").select(
        "bundle_id",
        F.coalesce("length", F.lit(0)).cast("long").alias("position"),
        F.encode(F.when(F.col("length").isNull(), "[]").otherwise("]"), "UTF-8").alias("data"),
    )
    return pieces.unionByName(last)


def write(requests: DataFrame, files: DataFrame, folder: str, generated_at: str, mode: str = "none", overwrite: bool = False) -> None:
    """Write each bundle as one file of ``folder``, named by its id: ``.md``, or ``.json`` for the reduced modes.

    Many tasks write a large bundle side by side; the folder appears when all bundles are whole.
    """
    suffix = ".md" if check_mode(mode) == "none" else ".json"
    rows = placed(requests, files, generated_at, mode).select(
        F.concat("bundle_id", F.lit(suffix)).alias("filename"), "position", "data"
    )
    requests.sparkSession.dataSource.register(bundle_files.PlacedFiles)
    sink = rows.sortWithinPartitions("filename", "position").write.format("placed_files").option("path", folder)
    sink.mode("overwrite" if overwrite else "append").save()


def read_json(spark: SparkSession, folder: str, record: str) -> DataFrame:
    """Elements ``(bundle_id, ...record)`` of the JSON bundles of a folder; ``record`` is their schema."""
    rows = spark.read.schema(record).option("multiLine", True).json(f"{folder}/*.json")
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("bundle_id"), "*")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown bundles ``(bundle_id, text)`` of a folder, a row each."""
    rows = spark.read.text(f"{folder}/*.md", wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("bundle_id"), F.col("value").alias("text"))


def write_markdown(bundle_parts: DataFrame, path: str) -> None:
    """Write plain bundles as text, one folder per bundle, files in document order.

    Rows are range-partitioned by position, so a large bundle is spread over many tasks.
    """
    bundle_parts.repartitionByRange("bundle_id", "part", "position").sortWithinPartitions(
        "bundle_id", "part", "position"
    ).select("bundle_id", "text").write.partitionBy("bundle_id").text(path)


def parse(bundles: DataFrame, column: str = "text") -> DataFrame:
    """Files of Markdown bundles received from outside: ``(.., position, file, language, code)``.

    A section runs to the next heading; its first fence is the file. Sections without a fence
    are left out.
    """
    # Possessive line-by-line loops: each line end is looked at once and nothing is tried again.
    pattern = r"\n## ([^\n]+)\n([^\n]*+(?:\n(?!## [^\n]+\n)[^\n]*+)*+)"
    found = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
    fence = r"(?U)```(\w+)\n([^\n]*+(?:\n(?!```)[^\n]*+)*+)\n```"
    body = F.regexp_extract("section", pattern, 2)
    others = [c for c in bundles.columns if c != column]
    return (
        bundles.select(*others, F.posexplode(found).alias("position", "section"))
        .select(*others, "position", F.regexp_extract("section", pattern, 1).alias("file"), body.alias("body"))
        .filter(F.col("body").rlike(fence))
        .select(
            *others,
            "position",
            text.strip(F.col("file")).alias("file"),
            F.lower(F.regexp_extract("body", fence, 1)).alias("language"),
            F.regexp_extract("body", fence, 2).alias("code"),
        )
    )


def invalid(bundles: DataFrame, column: str = "text") -> DataFrame:
    """Bundles without any section, as error rows."""
    others = [c for c in bundles.columns if c != column]
    return bundles.filter(~F.col(column).rlike(r"\n## [^\n]+\n")).select(
        *others, F.lit("Invalid markdown format").alias("error"), F.length(column).alias("original_size")
    )


def one_file(parsed: DataFrame, name: str | Column) -> DataFrame:
    """A single file of parsed bundles."""
    return parsed.filter(F.col("file") == name)
