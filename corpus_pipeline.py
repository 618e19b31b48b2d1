"""The training-corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Null texts count as
empty in every stage; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import bpe, jaccard, mixing, quality, suffixes
from treeloom.llm.common import read, settle
from treeloom.llm.queries import tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return jaccard.keep_one(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a smaller doc_id holds; documents stay, and ``n_chars`` follows."""
    done = suffixes.dedup(docs, docs.columns)
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    new = {"text": text, "n_chars": F.char_length(F.coalesce(text, F.lit(""))).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and of the decoded texts."""
    return bpe.digests(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_by_weight),
    ("BPE", encode),
]

# The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
