"""Encoding audit of binary content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Byte-order marks, longest first.
MARKS = (("utf-32", ("FFFE0000", "0000FEFF")), ("utf-8-sig", ("EFBBBF",)), ("utf-16", ("FFFE", "FEFF")))


def encoding(content: Column) -> Column:
    """Encoding by byte-order mark, else UTF-8 if all bytes are valid, else unknown."""
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for label, marks in MARKS:
        test = head.startswith(marks[0])
        for mark in marks[1:]:
            test = test | head.startswith(mark)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("unknown")


# Codecs that take the byte order from the mark.
WIDE = {"utf-16": "utf-16", "utf-32": "utf-32"}


@F.pandas_udf(T.StringType())
def _wide(content: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else c.decode(WIDE[k], "replace") for c, k in zip(content, kind)], dtype=object)


def decode(content: Column) -> Column:
    """Text by the audited encoding, bad bytes replaced; bytes of unknown encoding are read as UTF-8.

    Only files with a UTF-16 or UTF-32 mark go through Python; the others give it nulls.
    """
    kind = encoding(content)
    is_wide = kind.isin(*WIDE)
    as_utf8 = F.make_valid_utf8(content.cast("string"))
    return (
        F.when(is_wide, _wide(F.when(is_wide, content), kind))
        .when(kind == "utf-8-sig", F.substring(as_utf8, 2, 2**31 - 1))
        .otherwise(as_utf8)
    )


def audit(files: DataFrame, column: str = "content") -> DataFrame:
    """Files and bytes per encoding."""
    return files.groupBy(encoding(F.col(column)).alias("encoding")).agg(
        F.count("*").alias("n_files"), F.sum(F.octet_length(column)).alias("n_bytes")
    )
