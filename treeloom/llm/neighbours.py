"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table projects a vector on Gaussian directions, which keeps Euclidean distance in distribution, and cuts
each projection into intervals; a bucket is one interval per direction. For a query, the squared distance of
its projections to a bucket tells how likely the bucket holds a neighbour, so buckets are visited by that
score, nearest first, up to the score under which a set share of true neighbours lie. Width and score are
fitted on a bounded sample; every vector is indexed. Candidates of all tables are merged and ranked by exact
distance.

On the cluster: a bucket's first intervals are its cell. An index row goes to its cell of each table, a query
to the cells whose part of the score is small enough. Large cells are split over several tasks, on both
sides, so a task's share is bounded. Queries that find too few neighbours see all cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import settle

TABLES = 6
DIRECTIONS = 10
CELL = 2  # directions that make a cell
SAMPLE = 4096  # vectors to fit on
SUCCESS = 0.55  # share of neighbours that one table finds
INDEX_ROWS = 4096
QUERY_ROWS = 1024


class Hashes:
    """Fitted hash tables for vectors of one length."""

    def __init__(self, sample: np.ndarray, tables: int, directions: int, success: float, k: int, seed: int):
        size = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((tables, size, directions))
        self.shift = rng.random((tables, directions))
        spread = np.median([(sample @ a).std(axis=0) for a in self.lines]) if len(sample) > 1 else 0.0
        self.width = 1.5 * float(spread) or 1.0
        self.score = self._fit(sample, success, k)

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Projections in units of the interval width; the whole part is the interval."""
        return vectors @ self.lines[table] / self.width + self.shift[table]

    def _fit(self, sample: np.ndarray, success: float, k: int) -> float:
        """The score that the buckets of a ``success`` share of sample neighbours do not exceed.

        Neighbours in a sample lie farther away than in the whole, so the share is met or exceeded there.
        """
        if len(sample) < 2:
            return np.inf
        some = sample[: min(256, len(sample))]
        far = ((some[:, None, :] - sample[None, :, :]) ** 2).sum(axis=2) if len(sample) * some.size < 1 << 22 else _squares(some, sample)
        far[np.arange(len(some)), np.arange(len(some))] = np.inf
        near = np.argsort(far, axis=1)[:, : min(k, len(sample) - 1)]
        scores = []
        for table in range(len(self.lines)):
            at = self.places(sample, table)
            scores.append(_gaps(at[: len(some), None, :], np.floor(at)[near]).sum(axis=2).ravel())
        return float(np.quantile(np.concatenate(scores), success)) + 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T)


def _gaps(places: np.ndarray, intervals: np.ndarray) -> np.ndarray:
    """Squared distances from places to intervals of width one."""
    return np.maximum(0, np.maximum(intervals - places, places - intervals - 1)) ** 2


def valid(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cells(hashes: Hashes, queries: bool, whole: bool):
    """Rows (vec_id, v) to rows (t, cell, vec_id, v), a row per cell that the row belongs to or visits."""

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            vectors = np.stack(frame["v"].to_numpy()).astype(np.float64)
            for table in range(len(hashes.lines)):
                at = hashes.places(vectors, table)[:, :CELL]
                cells = np.floor(at)
                rows = np.arange(len(frame))
                if queries and not whole:
                    rows, cells = _visited(at, hashes.score)
                yield pd.DataFrame(
                    {"t": table, "cell": [",".join(map(str, c)) for c in cells.astype(np.int64).tolist()], "vec_id": frame["vec_id"].to_numpy()[rows], "v": frame["v"].to_numpy()[rows]}
                )

    return run


def _visited(at: np.ndarray, score: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells whose score is small enough, direction by direction."""
    reach = int(np.ceil(np.sqrt(min(score, 1e4))))
    rows, cells, sums = np.arange(len(at)), np.zeros((len(at), 0)), np.zeros(len(at))
    for d in range(at.shape[1]):
        here = at[rows, d]
        steps = np.floor(here)[:, None] + np.arange(-reach, reach + 1)[None]
        total = sums[:, None] + _gaps(here[:, None], steps)
        keep, step = np.nonzero(total <= score)
        cells = np.concatenate([cells[keep], steps[keep, step][:, None]], axis=1)
        rows, sums = rows[keep], total[keep, step]
    return rows, cells


def _search(hashes: Hashes, keep: int, whole: bool):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(index) and len(queries):
            ids = index["vec_id"].to_numpy()
            vectors = np.stack(index["v"].to_numpy()).astype(np.float64)
            asked = np.stack(queries["v"].to_numpy()).astype(np.float64)
            table = int(key[0])
            buckets, of = np.unique(np.floor(hashes.places(vectors, table)), axis=0, return_inverse=True)
            by_bucket = np.argsort(of.ravel(), kind="stable")
            begins = np.searchsorted(of.ravel()[by_bucket], np.arange(len(buckets) + 1))
            for query, q, at in zip(queries["vec_id"].tolist(), asked, hashes.places(asked, table)):
                scores = _gaps(at, buckets).sum(axis=1)
                visit = np.arange(len(buckets)) if whole else np.flatnonzero(scores <= hashes.score)
                if not len(visit):
                    continue
                visit = visit[np.argsort(scores[visit])]
                found = np.concatenate([by_bucket[begins[b] : begins[b + 1]] for b in visit])
                far = np.sqrt(((vectors[found] - q) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], far))[:keep]
                out["query_id"] += [query] * len(best)
                out["vec_id"] += ids[found[best]].tolist()
                out["score"] += far[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _pairs(hashes: Hashes, index: DataFrame, queries: DataFrame, keep: int, whole: bool) -> DataFrame:
    """(query_id, vec_id, score): the best ``keep`` of each task's share for each query."""
    shape = "t int, cell string, vec_id long, v array<double>"
    rows = index.mapInPandas(_cells(hashes, False, whole), shape)
    asks = queries.mapInPandas(_cells(hashes, True, whole), shape)
    if whole:  # every query meets every row once: one table, one cell
        rows, asks = (x.filter("t = 0").withColumn("cell", F.lit("")) for x in (rows, asks))
    sizes = (
        rows.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("i"))
        .join(asks.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("q")), ["t", "cell"])
        .select("t", "cell", F.ceil(F.col("i") / INDEX_ROWS).alias("i"), F.ceil(F.col("q") / QUERY_ROWS).alias("q"))
    )
    sizes = settle(sizes)
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = rows.join(sizes, ["t", "cell"]).select("t", "cell", "vec_id", "v", spot("i").alias("a"), every("q").alias("b"))
    asks = asks.join(sizes, ["t", "cell"]).select("t", "cell", "vec_id", "v", spot("q").alias("b"), every("i").alias("a"))
    keys = ["t", "cell", "a", "b"]
    return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(
        _search(hashes, keep, whole), "query_id long, vec_id long, score double"
    ).distinct()


def nearest(
    rows: DataFrame, k: int = 10, every: int = 100, tables: int = TABLES, directions: int = DIRECTIONS, success: float = SUCCESS, seed: int = 11
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id is divisible by ``every``.

    Needs ``vec_id`` and ``embedding``. Score is the Euclidean distance in double precision; ties go to the
    smaller vec_id; the query's own id is no candidate. Rows without an id, and vectors that are null, empty,
    zero, not finite, or of another length than most of the sample, take no part; repeated rows count once.
    Of equal vectors only the ``k + 1`` smallest ids can be asked for, so only these are searched, and equal
    queries are searched once. Other columns are not read. No rows in, no rows out.
    """
    spark = rows.sparkSession
    clean = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    clean = settle(clean.distinct())
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    shape = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], shape)
    lengths = pd.Series([len(r.v) for r in sample])
    length = int(lengths.mode().min())
    hashes = Hashes(np.array([r.v for r in sample if len(r.v) == length]), tables, directions, success, k, seed)
    clean = clean.filter(F.size("v") == length)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = clean.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")
    asked = settle(clean.filter(F.col("vec_id") % every == 0).withColumn("lead", F.min("vec_id").over(Window.partitionBy("v"))))
    leads = asked.filter("vec_id = lead").select("vec_id", "v")
    found = _pairs(hashes, index, leads, k + 1, False)
    found = settle(_top(found.withColumnRenamed("query_id", "lead"), ["lead"], k + 1))
    few = leads.join(found.groupBy(F.col("lead").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k), "vec_id", "left_anti")
    few = settle(few)
    if not few.isEmpty():
        rest = _pairs(hashes, index, few, k + 1, True).withColumnRenamed("query_id", "lead")
        found = _top(found.drop("rank").unionByName(rest), ["lead"], k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), "lead").join(found.drop("rank"), "lead").filter("vec_id <> query_id")
    return _top(answers.drop("lead"), ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _top(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = pairs.groupBy(*keys, "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)
