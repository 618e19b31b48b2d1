"""Mixing sources to target weights.

Targets: sources share all words of the corpus by weight; a target stops at a multiple of its
source's own words and the excess is shared again by weight among the others, which ends in the
level at which the open sources meet their weights.

Blocks: the mix is a number of blocks of equally many words. Sainte-Laguë hands them out, to sources
by their targets, then inside a source to a first and a second level of shards by their words: the
k-th block of a party with v votes has the quotient v / (2k - 1), and the highest quotients win. A
party's seats differ little from its exact share, so only the quotients around the share are listed
and ranked; the lists grow with the parties and never with the blocks.

Selection: a shard's documents lie in seeded order, which makes one run of words, cut into blocks. A
shard whose quota is q of its b blocks takes every block q // b times and q % b of them once more:
a seeded circular run of blocks. So documents are taken whole numbers of times, but for the two at the
ends of a run, and nobody's blocks are ever listed.

The main path is DataFrame operations only. Windows run over sources, over the shards of a source
(two levels, so a source of n shards meets in groups of about sqrt(n)), and over the documents of one
shard; none of them gathers a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import WORD, settle

WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of each party when ``seats`` of its group go to the highest quotients.

    ``group`` may be empty; ``party`` names a row in its group and breaks ties, smaller first; ``seats``
    is equal within a group. Parties without votes, and groups without seats, get none.
    """
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    v = F.col(votes).cast("double")
    lines = (
        parties.withColumn("_all", F.sum(v).over(over))
        .withColumn("_n", F.count(F.lit(1)).over(over))
        .withColumn("_share", F.when(F.col("_all") > 0, v * F.col(seats) / F.col("_all")).otherwise(0.0))
        # The final divisor moves a party's seats from its share by at most share * n / (2 * seats) + 1/2.
        .withColumn(
            "_span",
            F.ceil(F.when(F.col(seats) > 0, F.col("_share") * F.col("_n") / (2 * F.col(seats))).otherwise(0.0)) + 1,
        )
        .withColumn("_sure", F.greatest(F.lit(0), F.floor("_share") - F.col("_span")).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(over))
        .withColumn("_top", (F.floor("_share") + F.col("_span") + 1).cast("long"))
    )
    ranked = (
        lines.filter(v > 0)
        .select(*group, *party, votes, "_open", F.explode(F.sequence(F.col("_sure") + 1, F.col("_top"))).alias("_seat"))
        .withColumn("_quotient", v / (2 * F.col("_seat") - 1))
        .withColumn(
            "_rank",
            F.row_number().over(
                Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.desc("_quotient"), *party)
            ),
        )
        .filter("_rank <= _open")
        .groupBy(*group, *party)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    keys = [*group, *party]
    return (
        lines.join(ranked, keys, "left")
        .withColumn("quota", F.when(v > 0, F.col("_sure") + F.coalesce("_won", F.lit(0))).otherwise(0).cast("long"))
        .select(*parties.columns, "quota")
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3) -> DataFrame:
    """Add ``src`` (position by code point, null last, from 0) and ``target`` to one row per source.

    Needs ``source`` and ``source_size``. Sources are sorted by how early they reach the ceiling; the
    closed ones are a prefix of that order, and the others share the rest by weight.
    """
    one = Window.partitionBy(F.lit(1))
    places = sources.withColumn("src", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    early = one.orderBy(F.col("_most") / F.col("_w"), "src")
    before = early.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        places.withColumn("_w", weight.cast("long"))
        .withColumn("_most", F.col("source_size") * ceiling)
        .withColumn("_left", F.sum("source_size").over(one) - F.coalesce(F.sum("_most").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_fits", F.col("_left") * F.col("_w") <= F.col("_most") * F.col("_weights"))
    )
    first = F.min(F.when(F.col("_fits"), F.struct(F.col("_most") / F.col("_w"), F.col("src"), F.col("_left"), F.col("_weights")))).over(one)
    return (
        level.withColumn("_at", first)
        .withColumn(
            "target",
            F.when(
                F.col("_at").isNotNull() & (F.struct(F.col("_most") / F.col("_w"), F.col("src")) >= F.struct(F.col("_at.col1"), F.col("_at.src"))),
                F.col("_w").cast("double") * F.col("_at._left").cast("double") / F.col("_at._weights").cast("double"),
            ).otherwise(F.col("_most").cast("double")),
        )
        .select(*sources.columns, "src", "target")
    )


def _as_text(docs: DataFrame) -> Column:
    kind = dict(docs.dtypes)["doc_id"]
    # A drawn document's key holds its id, so it gets the same places as by its id alone.
    return F.when(~F.col("doc_id.bare"), F.col("doc_id.did").cast("string")) if kind.startswith("struct") else F.col("doc_id").cast("string")


def draw(docs: DataFrame, seed: int = 7, **settings) -> DataFrame:
    """The documents, all columns, as the mix takes them: each as many times as its words are taken, rounded.

    A document with over half of its shard's words that is longer than the shard's run, or than the rest of
    its ring, may lie on the same side of its half at every seed. Its fraction is the probability of one more
    copy instead, by MD5 of seed, doc_id and text, so it meets its share on average over seeds and over
    shards. All others get the nearest number of copies, also those that are longer than a short run.

    ``settings`` go to ``mix_sources``. Rows that repeat doc_id, text and source draw together, as copies of one of them.
    """
    keys = lambda d: d.select(
        F.struct(*d.columns).alias("row"), "doc_id", "source", F.col("doc_id").isNull().alias("bare"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("did"),
        F.xxhash64("text", "source").alias("tid"), "text",
    )
    named = keys(docs)
    # The mix sees the key instead of the id, so that its rows find back.
    taken = _mixed(named.select(F.struct("bare", "did", "tid").alias("doc_id"), "source", "text"), seed=seed, **settings)
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"copy {seed}"), "doc_id.bare", "doc_id.did", "doc_id.tid")), 1, 12), 16, 10).cast("double") / (1 << 48)
    fair = (2 * F.col("size") <= F.col("_words")) | (F.col("size") <= F.least("_run", F.col("_ring") - F.col("_run")))
    copies = (
        taken.filter("size > 0").groupBy("doc_id").agg(F.sum(F.floor(F.col("taken") / F.col("size") + F.when(fair, 0.5).otherwise(chance))).alias("copies"))
        .filter("copies > 0").select("doc_id.*", "copies")
    )
    place = F.row_number().over(Window.partitionBy("bare", "did", "tid").orderBy("tid"))
    rows = named.drop("doc_id", "source", "text").join(settle(copies), ["bare", "did", "tid"]).withColumn("place", place).filter("place = 1")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3, block_words: int = 16, shard_docs: int = 256, seed: int = 7
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` is the number of words the mix takes from the document, repeats counted: at most
    ``ceiling`` times its size. Null and empty texts have no words and are never taken. The null source
    is a source. Rows that repeat a doc_id are documents of their own, side by side in one shard; those
    without a doc_id are dealt by their text. All choices come from MD5 of seed and doc_id or text, so
    reruns agree. Other columns are not read. No rows in,
    no rows out.
    """
    return _mixed(docs, weights, ceiling, block_words, shard_docs, seed).drop("_run", "_ring", "_words")


def _mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3, block_words: int = 16, shard_docs: int = 256, seed: int = 7
) -> DataFrame:
    """The rows of ``mix_sources`` with the words of their shard, of its run and of its ring."""
    # Without an id the text decides, so that rows without one are not all in one shard.
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(_as_text(docs), F.concat(F.lit("-"), "_salt"), F.lit(""))))
    digits = lambda first: F.conv(F.substring("_key", first, 7), 16, 10).cast("long")
    salt = F.when(_as_text(docs).isNull(), F.md5(F.coalesce("text", F.lit(""))))
    sized = settle(docs.select("doc_id", "source", words(F.col("text")).alias("size"), salt.alias("_salt")))
    sources = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")), weights, ceiling
    )
    sources = sources.withColumn("_seats", F.ceil(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / block_words))
    sources = settle(
        sainte_lague(sources, [], ["src"], "target", "_seats")
        .withColumn("_side", F.ceil(F.sqrt(F.ceil(F.col("_docs") / shard_docs))).cast("long"))
        .withColumnRenamed("quota", "_blocks")
    )
    placed = (
        sized.join(
            sources.select(F.col("source").alias("_source"), "source_size", "src", "target", "_side"),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        .withColumn("_key", key)
        .withColumn("_a", digits(1) % F.col("_side"))
        .withColumn("_b", digits(8) % F.col("_side"))
    )
    shards = placed.groupBy("src", "_a", "_b").agg(F.sum("size").alias("_words"))
    halls = shards.groupBy("src", "_a").agg(F.sum("_words").alias("_words")).join(sources.select("src", "_blocks"), "src")
    halls = sainte_lague(halls, ["src"], ["_a"], "_words", "_blocks").select("src", "_a", F.col("quota").alias("_hall"))
    quotas = sainte_lague(shards.join(halls, ["src", "_a"]), ["src", "_a"], ["_b"], "_words", "_hall")
    shard = Window.partitionBy("src", "_a", "_b")
    rows = (
        placed.withColumn("_end", F.sum("size").over(shard.orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
        .join(quotas.select("src", "_a", "_b", "_words", "quota"), ["src", "_a", "_b"])
        .withColumn("_n", F.ceil(F.col("_words") / block_words))
        .withColumn("_quota", F.least(F.col("quota"), F.col("_n") * ceiling))
        .withColumn("_full", F.when(F.col("_n") > 0, F.floor(F.col("_quota") / F.col("_n"))).otherwise(0))
        .withColumn("_from", F.when(F.col("_n") > 0, F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "_a", "_b")), 1, 7), 16, 10).cast("long") % F.col("_n")).otherwise(0) * block_words)
        .withColumn("_run", (F.col("_quota") - F.col("_full") * F.col("_n")) * block_words)
        # The last block may be short: a run that passes it goes on at the start of the shard.
        .withColumn("_ring", F.col("_n") * block_words)
    )
    begin, end = F.col("_end") - F.col("size"), F.col("_end")
    inside = lambda lo, hi: F.greatest(F.lit(0), F.least(end, hi) - F.greatest(begin, lo))
    last = F.col("_from") + F.col("_run")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_full") * F.col("size") + inside(F.col("_from"), last) + inside(F.lit(0), last - F.col("_ring"))).cast("long").alias("taken"),
        "_run", "_ring", "_words",
    )
