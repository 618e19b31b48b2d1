"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import release, settle_counted


FEW = 20_000  # edges that one task may join, whatever the corpus; more take rounds of joins


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) for all nodes of a few edges (a, b) of whole numbers, all in one task."""
    tables = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not tables:
        return
    nodes, ends = np.unique(np.concatenate(tables, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    least = np.arange(len(nodes))
    while True:
        new = least.copy()
        low = np.minimum(least[a], least[b])
        for end in (a, b, least[a], least[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges(a, b)``; the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones likewise,
    until the edges are stars. A round is two joins on the node, staged; a hub's edges are split by the
    adaptive skew join, and nothing is gathered on the driver but a count and a checksum. At most ``FEW`` edges
    go through one task instead: rounds of joins over so little cost the driver more threads, plans and generated
    classes than the edges are worth.
    """
    measure = F.concat_ws(":", F.count(F.lit(1)), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)"))
    now, seen = settle_counted(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), measure
    )
    if int(seen.split(":")[0]) <= FEW:
        return now.coalesce(1).mapInArrow(_joined, "node long, component long")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        last = now
        now, sign = settle_counted(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), measure)
        release(last)
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
