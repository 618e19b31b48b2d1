"""Archives by content: packing, storing each text once, restoring."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import lookups, text
from treeloom.sources.tables import Generations

# Archive kinds and packing level.
LOSSLESS = "gzip_lossless"
HYBRID = "hybrid"
GZIP_LEVEL = 9


PART = 1 << 21  # bytes of results that a task's Python holds before it hands them on


def _by_parts(batches: Iterator[pa.Array], change: Callable[[memoryview], bytes | str], kind: pa.DataType) -> Iterator[pa.Array]:
    """``change`` of each value's bytes, handed on in parts of about ``PART`` bytes, so that a batch is not held again as results."""
    for batch in batches:
        part, size = [], 0
        for value in batch:
            part.append(change(memoryview(value.as_buffer())) if value.is_valid else None)
            size += len(part[-1] or "")
            if size >= PART:
                yield pa.array(part, kind)
                part, size = [], 0
        if part or not len(batch):
            yield pa.array(part, kind)


@F.arrow_udf(T.BinaryType())
def gzip_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Packed UTF-8 bytes; without a time stamp, so equal texts give equal bytes."""
    yield from _by_parts(batches, lambda data: gzip.compress(data, GZIP_LEVEL, mtime=0), pa.binary())


@F.arrow_udf(T.StringType())
def gunzip_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text of packed bytes."""
    yield from _by_parts(batches, lambda data: gzip.decompress(data).decode(), pa.string())


def _sha(content: Column) -> dict[str, Column]:
    """Full digest for joins, its first 16 digits as the displayed hash."""
    return {"sha256": F.sha2(content, 256), "hash": text.content_hash(content)}


def lossless(texts: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """Archive record of each text: sizes in characters, ratio, hash and base64 data."""
    content = F.col(column)
    packed = texts.select(
        *key, F.length(content).alias("original_size"), F.base64(gzip_text(content)).alias("data"),
        *[c.alias(n) for n, c in _sha(content).items()],
    )
    return packed.withColumns(
        {
            "compressed_size": F.length("data"),
            "compression_ratio": text.percent(F.length("data"), F.col("original_size")),
            "compression_type": F.lit(LOSSLESS),
            "encoding": F.lit("gzip+base64"),
        }
    )


def originals(texts: DataFrame, column: str = "text", store: DataFrame | None = None) -> DataFrame:
    """Each distinct text once, by digest; with ``store`` only those it does not hold yet.

    Copies are dropped on the map side first, so a text with very many copies sends one row per
    task. The short hash names the file; the full digest decides equality.
    """
    content = F.col(column)
    unique = texts.select(*[c.alias(n) for n, c in _sha(content).items()], content.alias("content")).dropDuplicates(
        ["sha256"]
    )
    if store is not None:
        unique = unique.join(store.select("sha256"), "sha256", "left_anti")
    return unique.withColumns(
        {
            "filename": F.concat(F.lit("original_"), "hash", F.lit(".md")),
            "prefix": F.substring("sha256", 1, 2),
        }
    )


def hybrid(texts: DataFrame, key: list[str], column: str = "text", structure: str = "structure") -> DataFrame:
    """Record with the structure JSON, a reference to the stored text and the text itself."""
    content = F.col(column)
    size = F.length(content)
    structure_size = F.length(structure)
    return texts.select(
        *key,
        F.col(structure).alias("structure"),
        *[c.alias(n) for n, c in _sha(content).items()],
        F.concat(F.lit("original_"), text.content_hash(content), F.lit(".md")).alias("filename"),
        size.alias("original_size"),
        structure_size.alias("compressed_size"),
        text.percent(structure_size, size).alias("compression_ratio"),
        F.lit(HYBRID).alias("compression_type"),
        content.alias("original_content"),
    )


def restore_lossless(records: DataFrame, key: list[str]) -> DataFrame:
    """Text of lossless records."""
    return records.select(*key, gunzip_text(F.unbase64("data")).alias("content"))


def restore_hybrid(records: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """Text of hybrid records: from the store, else the inline copy, else null."""
    kept = store.select("sha256", F.col("content").alias("stored"))
    return records.join(kept, "sha256", "left").select(
        *key, F.coalesce("stored", "original_content").alias("content")
    )


def restore(records: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """Text or error for records of any kind; summaries cannot be turned back."""
    plain = restore_lossless(records.filter(F.col("compression_type") == LOSSLESS), key).withColumn(
        "error", F.lit(None).cast("string")
    )
    hybrids = restore_hybrid(records.filter(F.col("compression_type") == HYBRID), store, key).withColumn(
        "error", F.when(F.coalesce("content", F.lit("")) == "", "Original file not found")
    )
    other = records.filter(~F.col("compression_type").isin(LOSSLESS, HYBRID)).select(
        *key, F.lit(None).cast("string").alias("content"), F.lit("Cannot decompress semantic compression").alias("error")
    )
    return plain.unionByName(hybrids).unionByName(other)


def reduction(records: DataFrame, by: list[str]) -> DataFrame:
    """Sizes, ratio and characters saved, per group."""
    return (
        records.groupBy(*by)
        .agg(F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size"))
        .withColumns(
            {
                "compression_ratio": text.percent(F.col("compressed_size"), F.col("original_size")),
                "saved": F.col("original_size") - F.col("compressed_size"),
                "saved_shown": text.browser_size(F.col("original_size") - F.col("compressed_size")),
            }
        )
    )


def retention(manifest: DataFrame, now: Column) -> DataFrame:
    """Mark artefacts older than the retention time."""
    age = now - F.make_dt_interval(hours=F.lit(lookups.RETENTION_HOURS))
    return manifest.withColumn("expired", F.col("last_modified") < age)


def kept(manifest: DataFrame, now: Column) -> DataFrame:
    """What a sweep leaves of a manifest, to be written in its place; an unknown time is kept."""
    return retention(manifest, now).filter("NOT coalesce(expired, false)").drop("expired")


def kept_originals(store: DataFrame, records: DataFrame) -> DataFrame:
    """Stored texts that some kept record still names."""
    return store.join(records.select("sha256").distinct(), "sha256", "left_semi")


def sweep_store(store: Generations, records: DataFrame, keep: int = 2) -> list[str]:
    """Rewrite a store without the texts that no kept record names; return the generations dropped.

    The kept part becomes a new generation, readers are switched to it, and only then older ones go.
    """
    store.replace(kept_originals(store.read(), records))
    return store.sweep(keep)
