"""Token counts through a digest cache.

A cache is a Parquet table of content digest, tokenizer-version digest and count. Counting joins the
digests of the documents to it, encodes each distinct missing text once, and appends the new counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import settle
from treeloom.session import stage_root

CACHE = "content binary, version string, n_tokens long"


def normalised(text: Column) -> Column:
    """Content as it is counted. Null counts as empty; nothing else may change, as counts would."""
    return F.coalesce(text, F.lit(""))


def _encoder(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def version_of(path: str) -> str:
    """Digest of a tokenizer file with the library that reads it."""
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(kind.encode() + b"\0" + f.read()).hexdigest()


def encode_counts(path: str, slice_rows: int = 64) -> Callable:
    """A task function from (content, text) to (content, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["content", "n_tokens"]
                )

    return run


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """The counts stored so far; an absent folder is an empty cache."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit; new counts are appended to ``cache``.

    ``tokenizer`` is a file that every executor can open (``.model`` or ``.json``). Equal texts are
    encoded once however many rows hold them. Only digests are joined and grouped; a missing text
    travels once, by the doc_id of one of its holders. Two runs that miss the same text may both append
    it: readers take one count per key. Null texts count as empty, repeated rows stay rows, other columns
    are not read. No rows in, no rows out.
    """
    spark = docs.sparkSession
    version = version_of(tokenizer)
    keyed = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    narrow = settle(keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")))
    known = cached(spark, cache).filter(F.col("version") == version).select("content", "n_tokens").dropDuplicates(["content"])
    missing = narrow.groupBy("content").agg(F.min("doc_id").alias("_id"), F.count("doc_id").alias("_ids")).join(known, "content", "left_anti")
    # The holder is found by its id and checked by its digest; rows of a null id are found by null-safe equality.
    wanted = settle(missing.select(F.col("_id"), F.col("content").alias("_content")))
    texts = (
        keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")), "left_semi")
        .select("content", "text")
    )
    counts = settle(texts.mapInArrow(encode_counts(tokenizer), "content binary, n_tokens long").dropDuplicates(["content"]))
    counts.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    known = cached(spark, cache).filter(F.col("version") == version).select("content", "n_tokens").dropDuplicates(["content"])
    return (
        narrow.join(known, "content")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def new_cache(spark: SparkSession) -> str:
    """A folder for a cache of its own, in the folder all executors share."""
    import uuid

    return f"{stage_root(spark)}/token_cache/{uuid.uuid4().hex}"
