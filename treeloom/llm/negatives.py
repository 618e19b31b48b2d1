"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster every row has one bound that holds for all its members: if
the row lies ``t`` from the centre and no member lies farther than ``b``, then no member comes closer to the row
than ``t - b``, so no score exceeds the member's length times ``|row| * cos(max(0, t - b))``. The rows are sorted
by that bound once per cluster, and every member walks the shared list from the top until its worst kept score
exceeds the bound of all that follows, which certifies its answer.

An anchor first walks for its positives (its label, best first), then, for each positive, for the best rows of
other labels whose score lies in a band below the positive's. Scores are inner products of whole numbers and
exact.

On the cluster: a list is never held in one task. It is cut into slices by bound, the top slice first; a slice
is dealt into parts, each of them a sorted list of its own, and members into blocks. A part ends a walk as soon
as its own bound certifies it, and after each slice only the walks that the next slice's bound leaves open go
on. The driver holds a bounded sample, and one row per cluster and slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import settle

CLUSTERS = 16
SAMPLE = 4096  # rows, and anchors, to fit centres and slices on
SLICES = (0.02, 0.2)  # shares of a list at which slices are cut; the rest is the last slice
LIST_ROWS = 8192  # rows of a list in a task
MEMBERS = 1024  # anchors in a task
BLOCK = 512  # rows scored at once
FAR = 1 << 62


class Lists:
    """Centres of anchor directions, the widest member of each, and where lists are cut."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray, clusters: int, scale: float, seed: int = 5):
        self.scale = scale
        self.centres = _centres(_unit(self.whole(anchors)), clusters, seed)
        self.width = np.zeros(len(self.centres))
        self.sample = self.whole(rows)
        self.cuts = np.zeros((0, len(self.centres)))

    def whole(self, vectors: np.ndarray) -> np.ndarray:
        """The whole numbers that are scored."""
        return np.floor(vectors * self.scale)

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        """Angle of each vector to each centre; zero vectors are at none."""
        return np.arccos(np.clip(_unit(vectors) @ self.centres.T, -1, 1)) * (np.abs(vectors).max(axis=1, initial=0) > 0)[:, None]

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and cluster, an upper bound of the score of a member of length one."""
        size = np.linalg.norm(vectors, axis=1)[:, None]
        return size * np.cos(np.maximum(0, self.angles(vectors) - self.width)) + 1e-6 * size

    def cut(self, width: dict[int, float], shares: tuple[float, ...]) -> None:
        """Take over the widest members and cut each list at some shares of the sample."""
        self.width = np.array([width.get(c, 0.0) for c in range(len(self.centres))])
        bounds = self.bounds(self.sample)
        self.cuts = np.vstack([np.full(len(self.centres), np.inf), *(np.quantile(bounds, 1 - s, axis=0) for s in shares), np.full(len(self.centres), -np.inf)])


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def _centres(units: np.ndarray, clusters: int, seed: int) -> np.ndarray:
    """Spherical k-means from centres far from each other."""
    rng = np.random.default_rng(seed)
    centres = units[rng.integers(len(units))][None]
    while len(centres) < min(clusters, len(units)):
        centres = np.vstack([centres, units[(units @ centres.T).max(axis=1).argmin()]])
    for _ in range(10):
        near = (units @ centres.T).argmax(axis=1)
        centres = _unit(np.array([units[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; beyond 64 bits they end at the largest long."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


# ---- tasks


def _place(lists: Lists):
    """Anchors with cluster, angle to its centre and length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors = lists.whole(_stack(frame["v"]))
                angles = lists.angles(vectors)
                near = angles.argmin(axis=1)
                yield frame.assign(cluster=near.astype("int32"), angle=angles[np.arange(len(near)), near], size=np.linalg.norm(vectors, axis=1))

    return run


def _census(lists: Lists):
    """How many rows of a batch lie in each slice of each cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                bounds = lists.bounds(lists.whole(_stack(frame["v"])))
                for s in range(len(lists.cuts) - 1):
                    inside = ((bounds < lists.cuts[s]) & (bounds >= lists.cuts[s + 1])).sum(axis=0)
                    yield pd.DataFrame({"cluster": np.arange(len(inside), dtype="int32"), "slice": np.int32(s), "n": inside})

    return run


def _slice(lists: Lists, number: int, clusters: list[int]):
    """Rows with their bound, once for each of some clusters in whose slice they lie."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                bounds = lists.bounds(lists.whole(_stack(frame["v"])))
                for c in clusters:
                    inside = (bounds[:, c] < lists.cuts[number, c]) & (bounds[:, c] >= lists.cuts[number + 1, c])
                    if inside.any():
                        yield frame[inside].assign(cluster=np.int32(c), bound=bounds[inside, c])

    return run


FOUND = "uid long, slot int, found long, found_id long, score long"


def _walk(lists: Lists, same: bool, keep: int):
    """Members' walks along one part of a list; each leaves the best ``keep`` rows of this part."""

    def run(key, part: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"uid": [], "slot": [], "found": [], "found_id": [], "score": []}
        if len(part) and len(asks):
            part = part.sort_values(["bound", "vec_id", "uid"], ascending=[False, True, True])
            vectors, bound = lists.whole(_stack(part["v"])), part["bound"].to_numpy()
            ids, uids, labels = (part[c].to_numpy() for c in ("vec_id", "uid", "label"))
            _, first, row = np.unique(asks["uid"].to_numpy(), return_index=True, return_inverse=True)
            anchors = lists.whole(_stack(asks["v"].iloc[first]))
            size, own, label, lo, hi = (asks[c].to_numpy() for c in ("size", "vec_id", "label", "lo", "hi"))
            worst = asks["worst"].to_numpy().copy()
            kept: list[list[tuple[int, int, int]]] = [[] for _ in range(len(asks))]
            for at in range(0, len(part), BLOCK):
                # A score is a whole number; one equal to the worst kept may still belong to a smaller id.
                going = np.flatnonzero(size * bound[at] >= np.maximum(worst, lo))
                if not len(going):
                    break
                used, of = np.unique(row[going], return_inverse=True)
                some = slice(at, at + BLOCK)
                scores = products(anchors[used], vectors[some])[of]
                fits = (labels[some][None] == label[going][:, None]) == same
                fits &= (scores >= np.maximum(worst, lo)[going][:, None]) & (scores <= hi[going][:, None]) & (ids[some][None] != own[going][:, None])
                for i in np.flatnonzero(fits.any(axis=1)).tolist():
                    hit, ask = np.flatnonzero(fits[i]), going[i]
                    kept[ask] += zip((-scores[i, hit]).tolist(), ids[some][hit].tolist(), uids[some][hit].tolist())
                    kept[ask] = sorted(kept[ask])[:keep]
                    if len(kept[ask]) == keep:
                        worst[ask] = max(worst[ask], -kept[ask][-1][0])
            for uid, slot, best in zip(asks["uid"].tolist(), asks["slot"].tolist(), kept):
                for score, vec_id, other in best:
                    for name, value in zip(out, (uid, slot, other, vec_id, -score)):
                        out[name].append(value)
        return pd.DataFrame(out).astype({"uid": "int64", "slot": "int32", "found": "int64", "found_id": "int64", "score": "int64"})

    return run


# ---- the job


def _usable(vector: Column, scale: float) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 1e150)), F.lit(False))


def _best(found: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "found_id", "found"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= keep)


def search(rows: DataFrame, asks: DataFrame, lists: Lists, sizes: dict[tuple[int, int], int], same: bool, keep: int) -> DataFrame:
    """The best ``keep`` rows for each ask, exactly: (uid, slot, found, found_id, score, rank).

    ``rows``: uid, vec_id, label, v. ``asks``: uid, vec_id, label, v, cluster, size, slot, lo, hi: rows of the
    anchor's label, or of others, whose score lies between ``lo`` and ``hi``.
    """
    spark = rows.sparkSession
    found = spark.createDataFrame([], FOUND + ", rank int")
    open_ = asks.withColumn("worst", F.lit(-FAR))
    slices = len(lists.cuts) - 1
    for number in range(slices):
        crowd = {r.cluster: r.n for r in open_.groupBy("cluster").agg(F.count_distinct("uid").alias("n")).collect()}
        if not crowd:
            break
        shape = [(c, -(-max(1, sizes.get((c, number), 0)) // LIST_ROWS), -(-n // MEMBERS)) for c, n in sorted(crowd.items())]
        spots = lambda: F.broadcast(spark.createDataFrame(shape, "cluster int, parts long, blocks long"))  # noqa: E731  a row per cluster
        listed = rows.mapInPandas(_slice(lists, number, sorted(crowd)), _schema(rows) + ", cluster int, bound double")
        spot = lambda n: F.pmod(F.xxhash64("uid"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        listed = listed.join(spots(), "cluster").withColumn("part", spot("parts")).withColumn("block", every("blocks"))
        members = open_.join(spots(), "cluster").withColumn("block", spot("blocks")).withColumn("part", every("parts"))
        keys = ["cluster", "part", "block"]
        new = listed.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(_walk(lists, same, keep), FOUND)
        found = settle(_best(found.drop("rank").unionByName(new), keep))
        if number + 1 == slices:
            break
        # What follows in a list is below the cut; a full answer worse than that, or a band that reaches below, goes on.
        below = F.element_at(F.array(*map(F.lit, lists.cuts[number + 1].tolist())), F.col("cluster") + 1) * F.col("size")
        full = found.filter(F.col("rank") == keep).select("uid", "slot", F.col("score").alias("_worst"))
        open_ = settle(
            open_.join(full, ["uid", "slot"], "left").withColumn("worst", F.coalesce("_worst", F.lit(-FAR))).drop("_worst")
            .filter(F.greatest("worst", "lo") <= below)
        )
    return found


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    clusters: int = CLUSTERS, slices: tuple[float, ...] = SLICES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the anchors.

    Needs ``vec_id``, ``label`` and ``embedding``. A component counts as the floor of ``scale`` times itself, a
    score is the inner product, ties go to the smaller vec_id. Anchors are the rows whose vec_id is divisible by
    ``every``; an anchor's positives are its best other rows of its label; for each, its negatives are the best
    rows of other labels whose score is ``low`` to ``high`` percent of the positive's. Anchors without a negative
    give no rows.

    Rows without vec_id, label or vector, with a component that is null or not finite, or of another length
    than most rows take no part. Zero vectors do. Repeated rows count once; rows that share a vec_id otherwise
    are rows of their own, but never each other's positives or negatives. Components beyond 1e150 when scaled
    count as not finite. Other columns are not read. No rows in, no rows out.
    """
    spark = rows.sparkSession
    clean = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding"), scale)).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v")
    )
    clean = settle(clean.distinct().withColumn("uid", F.xxhash64("vec_id", "label", "v")))
    common = clean.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if common is None or not common.length:
        return spark.createDataFrame([], OUT)
    clean = clean.filter(F.size("v") == common.length)
    anchors = clean.filter(F.col("vec_id") % every == 0)
    some = lambda df: np.array([r.v for r in df.orderBy(F.xxhash64("vec_id"), "uid").limit(SAMPLE).select("v").collect()], np.float64)
    fitted = some(anchors)
    if not len(fitted):
        return spark.createDataFrame([], OUT)
    lists = Lists(fitted, some(clean), clusters, scale)
    placed = settle(anchors.mapInPandas(_place(lists), _schema(anchors) + ", cluster int, angle double, size double"))
    lists.cut({r.cluster: r.angle for r in placed.groupBy("cluster").agg(F.max("angle").alias("angle")).collect()}, slices)
    census = clean.select("v").mapInPandas(_census(lists), "cluster int, slice int, n long").groupBy("cluster", "slice").agg(F.sum("n").alias("n"))
    sizes = {(r.cluster, r.slice): r.n for r in census.collect()}
    asks = placed.drop("angle").withColumn("slot", F.lit(0)).withColumn("lo", F.lit(-FAR)).withColumn("hi", F.lit(FAR))
    near = search(clean, asks, lists, sizes, True, positives).select(
        "uid", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    # The band in whole numbers; a product of 64 bits times a percentage may need more.
    wide = F.col("positive_score").cast("decimal(38,0)")
    lo, hi = F.ceil(wide * low / 100).cast("long"), F.floor(wide * high / 100).cast("long")
    bands = settle(near.withColumn("lo", lo).withColumn("hi", hi).filter("lo <= hi"))
    asks = placed.drop("angle").join(bands.select("uid", "slot", "lo", "hi"), "uid")
    far = search(clean, asks, lists, sizes, False, negatives)
    names = placed.select("uid", F.col("vec_id").alias("anchor_id"))
    return (
        far.select("uid", "slot", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(bands, ["uid", "slot"]).join(names, "uid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
