"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from treeloom.session import Stages

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle_counted(df: DataFrame, measure: Column | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder and read it back; Spark removes the shuffles of that job as it ends."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        stages = Stages(df.sparkSession)
        size = stages.write(df, measure)
    finally:
        conf.set(CLEANUP, before)
    out = stages.last()
    out._folder = stages.paths[0]
    return out, size


def settle(df: DataFrame) -> DataFrame:
    """``settle_counted`` without the count."""
    return settle_counted(df)[0]


def release(*tables: DataFrame) -> None:
    """Remove tables that ``settle`` wrote, once all that is read from them has been written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit value for each word (a run without ASCII white space) of ``data``, in order.

    Values come from one running polynomial over all bytes, so the work per word does not depend
    on Python objects; a final mix spreads them over all bits.
    """
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    inside = np.ones(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    powers, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


_BASE = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``size`` of each."""
    if not _tables or len(_tables[0]) < size:
        full = max(1 << 16, 1 << (size - 1).bit_length())
        _tables[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(full, base, np.uint64)
            steps[0] = 1
            _tables.append(np.cumprod(steps, dtype=np.uint64))
    return _tables[0][:size], _tables[1][:size]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))
