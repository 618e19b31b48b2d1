"""Iterative graph jobs: reachability, closure, cycles, hierarchy.

Each round is one join whose result is staged, so plans stay short and a lost executor costs one
round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators.inventory import KEY
from treeloom.session import Stages, stage, stage_counted

COMPACT_EVERY = 16
BUCKET_ROWS = 250_000  # edges per bucket of visited nodes
MOST_BUCKETS = 512
SENT_ROWS = 10_000  # a larger side of a round's join is shuffled, not sent through the driver


def _side(rows: DataFrame, size: int) -> DataFrame:
    """One side of a join that rounds repeat, with a bound on its rows.

    The planner's threshold bounds one broadcast, but dozens of rounds each send theirs through the driver, in all as
    much as the graph times the rounds. So beyond ``SENT_ROWS`` both sides are shuffled.
    """
    return rows.hint("merge") if size > SENT_ROWS else rows


class Visited:
    """Visited nodes, written round by round in buckets by node.

    A round asks only for the buckets in which the nodes it has found lie, so what it reads follows the
    frontier and not everything visited. There is one bucket per ``BUCKET_ROWS`` edges.
    """

    def __init__(self, keys: list[str], edges: int, spark: SparkSession):
        self.keys = keys
        self.buckets = max(1, min(MOST_BUCKETS, -(-edges // BUCKET_ROWS)))
        self.rounds = Stages(spark, ["bucket"] if self.buckets > 1 else [])

    def add(self, found: DataFrame) -> int:
        """Write the nodes of a round; return how many."""
        if self.buckets > 1:
            found = found.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).repartition("bucket")
        if len(self.rounds.paths) >= COMPACT_EVERY:
            self.rounds.compact()
        return self.rounds.write(found)

    def frontier(self) -> DataFrame:
        return self.rounds.last().select(*self.keys)

    def near(self, found: DataFrame) -> DataFrame:
        """Visited nodes of the buckets that ``found`` lies in."""
        if self.buckets == 1:
            return self.all()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        asked = [r.bucket for r in found.select(bucket.alias("bucket")).distinct().collect()]  # at most one row per bucket
        return self.rounds.all().filter(F.col("bucket").isin(asked)).select(*self.keys)

    def all(self) -> DataFrame:
        return self.rounds.all().select(*self.keys)


def _spread(step: DataFrame, seeds: DataFrame, keys: list[str], edges: int = 0) -> DataFrame:
    """Follow ``step(keys, node, next)`` of some number of edges from ``seeds(keys, node)`` until nothing new is found."""
    here = [*keys, "node"]
    seen = Visited(here, edges, step.sparkSession)
    size = seen.add(seeds.select(*here).distinct())
    while size:
        found = seen.frontier().join(step, here).select(*keys, F.col("next").alias("node")).distinct()
        if seen.buckets > 1:
            found = stage(found)
        size = seen.add(found.join(seen.near(found), here, "left_anti"))
    return seen.all()


def reach(edge_rows: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """Nodes ``(repo, node)`` reachable from the seeds, these included."""
    ends = ("dst", "src") if backward else ("src", "dst")
    step, size = stage_counted(edge_rows.select("repo", F.col(ends[0]).alias("node"), F.col(ends[1]).alias("next")).distinct())
    return _spread(step, seeds, ["repo"], size)


def reach_both(edge_rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes ``(repo, direction, node)`` reachable ``forward`` or ``backward``, in one loop."""
    hop = F.explode(
        F.array(
            F.struct(F.lit("forward").alias("direction"), F.col("src").alias("node"), F.col("dst").alias("next")),
            F.struct(F.lit("backward").alias("direction"), F.col("dst").alias("node"), F.col("src").alias("next")),
        )
    )
    step, size = stage_counted(edge_rows.select("repo", "src", "dst").distinct().select("repo", hop.alias("h")).select("repo", "h.*"))
    both = F.explode(F.array(F.lit("forward"), F.lit("backward"))).alias("direction")
    return _spread(step, seeds.select("repo", both, "node"), ["repo", "direction"], size)


def connected(edge_rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything a node needs and everything that needs it."""
    return reach_both(edge_rows, seeds).select("repo", "node").distinct()


def dependency_closure(edge_rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Selection grown by missing files until none is missing; edges must cover all files."""
    grown = reach(edge_rows, selection.select("repo", F.col("relative_path").alias("node")))
    return grown.select("repo", F.col("node").alias("relative_path"))


def _trim(edge_rows: DataFrame) -> tuple[DataFrame, int]:
    """Drop edges that cannot lie on a cycle, round by round, until none can be dropped."""
    current, size = stage_counted(edge_rows)
    while size:
        heads = current.select("repo", F.col("dst").alias("src")).distinct()
        inner = current.join(_side(heads, size), ["repo", "src"], "left_semi")
        tails = inner.select("repo", F.col("src").alias("dst")).distinct()
        current, left = stage_counted(inner.join(_side(tails, size), ["repo", "dst"], "left_semi").select("repo", "src", "dst"))
        if left == size:
            break
        size = left
    return current, size


def _strongest(current: DataFrame, edges: int) -> DataFrame:
    """Largest node that reaches each node, ``(repo, node, color)``, by passing labels along edges.

    Only labels that grew in a round are passed on in the next one. A node also takes the label of the node
    that its own label names, which reaches it as well; so labels run ahead in strides that double, and a long
    ring or chain takes few rounds.
    """
    ends = current.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct()
    colors, size = stage_counted(ends.select("repo", "node", F.col("node").alias("color"), F.lit(True).alias("grew")))
    while size:
        offers = (
            colors.filter("grew").select("repo", F.col("node").alias("src"), "color")
            .join(_side(current, edges), ["repo", "src"])
            .groupBy("repo", F.col("dst").alias("node"))
            .agg(F.max("color").alias("offer"))
        )
        ahead = colors.filter("node <> color").select("repo", F.col("node").alias("color"), F.col("color").alias("ahead"))
        new = F.greatest("color", "offer", "ahead")
        colors, size = stage_counted(
            colors.join(_side(offers, edges), ["repo", "node"], "left").join(_side(ahead, edges), ["repo", "color"], "left")
            .select("repo", "node", new.alias("color"), (new > F.col("color")).alias("grew")),
            F.count_if("grew"),
        )
    return colors.select("repo", "node", "color")


def cyclic_core(edge_rows: DataFrame) -> DataFrame:
    """Edges inside strongly connected components: those that lie on some cycle.

    Each pass trims, labels every node with the largest node that reaches it, and splits off the component of
    each label's own node. That node is the largest of its label, so what reaches it inside the label is what
    has it as its label on the reversed edges. Edges between labels lie on no cycle and are dropped; the rest
    goes to the next pass.
    """
    rest, size = _trim(edge_rows.select("repo", "src", "dst").filter("src <> dst").distinct())
    core = []
    while size:
        colors = _strongest(rest, size)
        of_src = colors.select("repo", F.col("node").alias("src"), F.col("color").alias("src_color"))
        of_dst = colors.select("repo", F.col("node").alias("dst"), F.col("color").alias("dst_color"))
        same, left = stage_counted(
            rest.join(_side(of_src, size), ["repo", "src"]).join(_side(of_dst, size), ["repo", "dst"]).filter("src_color = dst_color")
            .select("repo", "src", "dst")
        )
        back = _strongest(same.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")), left)
        member, nodes = stage_counted(back.join(_side(colors, left), ["repo", "node", "color"], "left_semi").select("repo", "node"))
        at_src, at_dst = (_side(member.withColumnRenamed("node", end), nodes) for end in ("src", "dst"))
        inside = same.join(at_src, ["repo", "src"], "left_semi").join(at_dst, ["repo", "dst"], "left_semi")
        core.append(stage(inside.select("repo", "src", "dst")))
        outside = same.join(at_src, ["repo", "src"], "left_anti").join(at_dst, ["repo", "dst"], "left_anti")
        rest, size = _trim(outside.select("repo", "src", "dst"))
    return reduce(DataFrame.union, core) if core else rest


def _rooted(core: DataFrame, edges: int) -> tuple[DataFrame, int]:
    """Edges ``(repo, root, last, next)`` on which a path from ``root`` through larger nodes may run and return,
    and their number.

    A node stays only if it still reaches the root among larger nodes, so a path that cannot close is never
    grown into such a node. Found by one backward search from all roots at once.
    """
    hop = core.select("repo", F.col("src").alias("last"), F.col("dst").alias("next"))
    homes = Stages(core.sparkSession)
    size = homes.write(hop.filter("last > next").select("repo", F.col("next").alias("root"), F.col("last").alias("node")).distinct())
    total = size
    while size:
        if len(homes.paths) >= COMPACT_EVERY:
            homes.compact()
        found = (
            homes.last().join(_side(hop.withColumnRenamed("next", "node"), edges), ["repo", "node"]).filter("last > root")
            .select("repo", "root", F.col("last").alias("node")).distinct()
        )
        size = homes.write(found.join(_side(homes.all(), total), ["repo", "root", "node"], "left_anti"))
        total += size
    home = _side(homes.all(), max(total, edges))
    onward = hop.join(home.withColumnRenamed("node", "next"), ["repo", "next"])
    first = onward.filter("last = root")
    inner = onward.join(home.withColumnRenamed("node", "last"), ["repo", "root", "last"], "left_semi")
    closing = home.withColumnRenamed("node", "last").join(hop.withColumnRenamed("next", "root"), ["repo", "last", "root"], "left_semi").withColumn("next", F.col("root"))
    return stage_counted(first.unionByName(inner).unionByName(closing))


def cycles(edge_rows: DataFrame, max_len: int | None = None) -> tuple[DataFrame, bool]:
    """Every elementary cycle once, as ``(repo, cycle)`` starting at its smallest node.

    Inside each strongly connected component, paths grow from each node through larger nodes from which there
    is a way back to it, and close when they return. Without ``max_len`` the search is exhaustive: there may be
    exponentially many cycles on dense graphs; with it the second result tells whether longer paths were left.
    """
    hop, edges = _rooted(*stage_counted(cyclic_core(edge_rows)))
    start = hop.filter("last = root").select("repo", "root", F.array("root", "next").alias("path"), F.lit(False).alias("closed"))
    paths = Stages(edge_rows.sparkSession)
    size = paths.write(start)
    length = 2
    truncated = False
    while size:
        grown = (
            paths.last().filter("NOT closed")
            .withColumn("last", F.element_at("path", -1))
            .join(_side(hop, edges), ["repo", "root", "last"])
            .withColumn("closed", F.col("next") == F.col("root"))
        )
        longer = ~F.col("closed") & ~F.array_contains("path", F.col("next"))
        kept = F.col("closed") | longer
        if max_len is not None and length >= max_len:
            truncated = truncated or not grown.filter(longer).isEmpty()
            kept = F.col("closed")
        size = paths.write(
            grown.filter(kept).select(
                "repo", "root",
                F.when(F.col("closed"), F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"),
                "closed",
            )
        )
        length += 1
    return paths.all().filter("closed").select("repo", F.col("path").alias("cycle")), truncated


def cycle_positions(cycle_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Cycle members as rows with their label; an unknown member keeps its own name."""
    known = node_rows.select("repo", F.col("relative_path").alias("member"), "label")
    return (
        cycle_rows.select("repo", F.get("cycle", F.lit(0)).alias("first"), F.posexplode("cycle").alias("position", "member"),
                          F.xxhash64("cycle").alias("cycle_id"))
        .join(known, ["repo", "member"], "left")
        .withColumn("label", F.coalesce("label", "member"))
    )


def hierarchy(node_rows: DataFrame, edge_rows: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, bool]:
    """All paths down from the entry points: ``(repo, path, node, depth, repeated)``.

    A node that is already on its path ends it. A repository without entry points lists its
    nodes flat. With ``max_depth`` deeper levels are left out; the second result tells whether
    there were any.
    """
    entries = node_rows.filter("is_entry_point").select("repo", "relative_path")
    with_entry = entries.select("repo").distinct()
    flat = node_rows.select(*KEY).join(with_entry, "repo", "left_anti")

    def roots(rows: DataFrame, ends: bool) -> DataFrame:
        return rows.select(
            "repo", F.array("relative_path").alias("path"), F.col("relative_path").alias("node"),
            F.lit(0).alias("depth"), F.lit(False).alias("repeated"), F.lit(ends).alias("ends"),
        )

    step = stage(edge_rows.select("repo", F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    levels = Stages(edge_rows.sparkSession)
    size = levels.write(roots(entries, False).union(roots(flat, True)))
    depth = 0
    truncated = False
    while size:
        grown = levels.last().filter("NOT repeated AND NOT ends").join(step, ["repo", "node"])
        if max_depth is not None and depth >= max_depth:
            truncated = not grown.isEmpty()
            break
        depth += 1
        size = levels.write(
            grown.select(
                "repo",
                F.array_append("path", F.col("next")).alias("path"),
                F.col("next").alias("node"),
                F.lit(depth).alias("depth"),
                F.array_contains("path", F.col("next")).alias("repeated"),
                F.lit(False).alias("ends"),
            )
        )
    return levels.all().drop("ends"), truncated
