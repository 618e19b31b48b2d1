"""Corpus checks: balance, syntax, required paths and elements."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions.text import count_of
from treeloom.operators.inventory import KEY

# Bracket kinds in the order they are checked.
BRACKETS = (("braces", "{", "}"), ("parentheses", "(", ")"), ("brackets", "[", "]"))


def _verdict(content: Column, kinds) -> tuple[Column, Column]:
    valid, message = F.lit(True), None
    for label, opening, closing in kinds:
        n_open, n_close = count_of(content, opening), count_of(content, closing)
        valid = valid & (n_open == n_close)
        shown = F.concat(
            F.lit(f"Mismatched {label}: "), n_open.cast("string"), F.lit(" vs "), n_close.cast("string")
        )
        message = F.when(n_open != n_close, shown) if message is None else message.when(n_open != n_close, shown)
    return valid, message.otherwise("Syntax appears valid")


def bracket_balance(df: DataFrame, column: str) -> DataFrame:
    """Script check: equal counts of each bracket kind; the first mismatch is reported."""
    valid, message = _verdict(F.col(column), BRACKETS)
    return df.withColumns({"valid": valid, "message": message})


def style_balance(df: DataFrame, column: str) -> DataFrame:
    """Style check: equal counts of braces outside comments."""
    # Behind the last closing mark no comment closes, so the pattern never looks for one in vain.
    content = F.col(column)
    head = F.regexp_extract(content, r"(?s)^(.*\*/)", 1)
    bare = F.concat(F.regexp_replace(head, r"(?s)/\*.*?\*/", ""), F.substring(content, F.length(head) + 1, F.length(content)))
    valid, message = _verdict(bare, BRACKETS[:1])
    return df.withColumns({"valid": valid, "message": message})


_RESULT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("message", T.StringType())])


def _python_verdict(source: str) -> tuple[bool, str]:
    try:
        ast.parse(source)
    except SyntaxError as error:
        return False, f"Syntax error: {error}"
    except (ValueError, RecursionError, MemoryError) as error:
        return False, f"Error: {error}"
    return True, "Syntax valid"


@F.pandas_udf(_RESULT)
def python_verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Whether each text parses, with the parser's message."""
    for batch in batches:
        yield pd.DataFrame([_python_verdict(s) for s in batch], columns=["valid", "message"])


def python_syntax(files: DataFrame) -> DataFrame:
    """Syntax check of Python files."""
    python = files.filter(F.col("relative_path").endswith(".py"))
    return python.select(*KEY, python_verdict("content").alias("v")).select(*KEY, "v.*")


ELEMENTS_PER_CHUNK = 1000


def required_paths(required: DataFrame, files: DataFrame) -> DataFrame:
    """Found flag for each required path ``(repo, relative_path, description)``."""
    present = files.select(*KEY).distinct().withColumn("found", F.lit(True))
    return required.join(present, KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def absent_elements(rules: DataFrame, files: DataFrame) -> DataFrame:
    """Rules ``(repo, relative_path, element)`` whose text is absent, one row each.

    A file's distinct elements come in chunks, so content moves once, is copied once per chunk, and only
    absent elements become rows. A file that does not exist lacks the file itself.
    """
    order = Window.partitionBy(*KEY).orderBy("element")
    chunks = (
        rules.select(*KEY, "element").distinct()
        .withColumn("chunk", F.floor((F.row_number().over(order) - 1) / ELEMENTS_PER_CHUNK))
        .groupBy(*KEY, "chunk").agg(F.collect_list("element").alias("elements"))
    )
    absent = F.filter("elements", lambda e: F.col("content").isNull() | ~F.contains(F.col("content"), e))
    return (
        chunks.join(files.select(*KEY, "content"), KEY, "left")
        .select(*KEY, F.col("content").isNull().alias("gone"), F.explode(absent).alias("element"))
        .select(*KEY, F.when(F.col("gone"), "File not found").otherwise(F.col("element")).alias("missing"))
    )


def element_status(rules: DataFrame, files: DataFrame) -> DataFrame:
    """Per file with rules: number of absent elements and whether all are there."""
    lacking = absent_elements(rules, files).groupBy(*KEY).agg(F.countDistinct("missing").alias("n_missing"))
    return (
        rules.select(*KEY)
        .distinct()
        .join(lacking, KEY, "left")
        .withColumn("n_missing", F.coalesce("n_missing", F.lit(0).cast("long")))
        .withColumn("valid", F.col("n_missing") == 0)
    )
