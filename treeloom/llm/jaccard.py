"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles, as 64-bit hashes. Two sets that are alike enough share an
element of their prefixes: the first ``n - ceil(t n) + 1`` elements by one order for all documents. Here
the order is by hash, but elements that many unlike documents share come last. How many is counted over
all documents from the first elements of each; to keep groups of near copies from looking common, an
element counts by the different smallest elements of the sets that hold it.

Equal sets are one set. Sets of equal prefix and size are one group, and only groups are indexed. Members
are linked with their group's first; verified links give components. Then, round by round, groups that share
an element are expanded to their members, and members of different components that fit in size and by a parity
sketch, whose differing bits bound the symmetric difference from below, are candidates. A round lets a row
bring few candidates per list, verifies them on their whole texts and joins components, so that large groups
of near copies do not make all their pairs; lists that had more come again, the last round without a limit.
Every link that could still join two components is met, so components are exact. Long lists are compared in
blocks, pair of blocks by pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import mix, release, settle, word_hashes
from treeloom.llm.components import components

COMMON = 32
SHORT_LIST = 64
BLOCK = 2048  # rows of a list that a task compares with as many others
ROUNDS = (2, 8, None)  # candidates that a row brings per list and round
LAST = (1 << 63) - 1


def elements(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: ASCII lower case, words between ASCII white space.

    A text of fewer words than ``width`` is one shingle; without words the set is empty.
    """
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return np.zeros(0, np.int64)
    take = min(width, len(words))
    found = np.full(len(words) - take + 1, take, np.uint64)
    for i in range(take):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - take + 1 + i])
    return np.unique(found.view(np.int64))


def prefix_size(n, percent: int):
    """Length of the prefix of a set of ``n`` elements (a number or an array)."""
    return n - (percent * n + 99) // 100 + 1


def sketch(found: np.ndarray) -> list[int]:
    """Parities of the elements over as many bits as elements at least (a power of two from 512), as longs.

    Its halves combined give the sketch of half the bits.
    """
    size = max(512, 1 << (len(found) - 1).bit_length())
    bits = np.bincount((found.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


SETS = "did long, tid long, sid long, n long, first array<long>, parity array<long>"


def summarise(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """did (doc_id, null as the largest), tid (a hash of the text), sid (a hash of the set), size, first elements, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sids, sizes, firsts, parities = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = elements(text, width)
                    n = len(found)
                    mixed = mix(found.view(np.uint64))
                    sids.append(int(mix(np.array([mixed.sum(dtype=np.uint64) + np.uint64(n)]))[0].view(np.int64)))
                    sizes.append(n)
                    p = prefix_size(n, percent)
                    firsts.append(found[: p + p // 2 + 8])
                    parities.append(sketch(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, longs), pa.array(parities, longs)],
                    names=["did", "tid", "sid", "n", "first", "parity"],
                )

    return with_did(docs).withColumn("tid", F.xxhash64("text")).mapInArrow(run, SETS)


def with_did(docs: DataFrame) -> DataFrame:
    """(did, text); null doc_ids are larger than any other."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), "text")


def _need(percent: int) -> Column:
    """Smallest prefix for size ``n``."""
    return F.expr(f"n - (({percent} * n + 99) div 100) + 1")


def prefixes(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(sid, gid, n, prefix) for each distinct set, by the common order: its group, and the prefix of the group's first."""
    tokens = sets.select("sid", F.explode("first").alias("token"), F.element_at("first", 1).alias("least"))
    common = settle(
        tokens.groupBy("token")
        .agg(F.count(F.lit(1)).alias("c"), F.approx_count_distinct("least", 0.26).alias("d"))
        .filter((F.col("c") >= COMMON) & (F.col("d") * 2 >= COMMON) & (F.col("d") * 4 >= F.col("c")))
        .select("token")
    )
    marked = tokens.join(common, "token", "left_semi").groupBy("sid").agg(F.collect_set("token").alias("common"))
    none = F.array().cast("array<long>")
    split = settle(
        sets.select("sid", "did", "tid", "n", "first").join(marked, "sid", "left")
        .withColumn("common", F.sort_array(F.coalesce("common", none)))
        .withColumn("rare", F.array_except("first", "common"))
        .withColumn("p", _need(percent))
        .select(
            "sid", "did", "tid", "n", "p",
            # Whole sets can be ordered here; a longer set needs as many rare elements as its prefix has.
            F.when(F.size("first") >= F.col("n"), F.slice(F.concat("rare", "common"), F.lit(1), F.col("p").cast("int")))
            .when(F.size("rare") >= F.col("p"), F.slice("rare", F.lit(1), F.col("p").cast("int"))).alias("prefix"),
        )
    )
    whole = (
        texts_of(docs, split.filter("prefix IS NULL"))
        .mapInArrow(_spread(width), "sid long, token long")
        .join(common.withColumn("shared", F.lit(True)), "token", "left")
        .groupBy("sid")
        .agg(F.sort_array(F.collect_set(F.struct(F.coalesce("shared", F.lit(False)).alias("shared"), "token"))).alias("all"))
    )
    reordered = split.filter("prefix IS NULL").drop("prefix").join(whole, "sid").select("sid", "n", F.slice("all.token", F.lit(1), F.col("p").cast("int")).alias("prefix"))
    # A group is named by its least member; prefixes are told apart by 96 bits.
    key = [F.xxhash64("n", "prefix").alias("k"), F.hash("n", "prefix").alias("h")]
    made = settle(split.filter("prefix IS NOT NULL").select("sid", "n", "prefix").unionByName(reordered).select("*", *key))
    release(common, split)
    groups = made.groupBy("k", "h").agg(F.min("sid").alias("gid"))
    members = settle(
        made.join(groups, ["k", "h"]).select("sid", "gid", "n", F.when(F.col("sid") == F.col("gid"), F.col("prefix")).alias("prefix"))
    )
    release(made)
    return members


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text) of the wanted sets (did, tid, sid); rows that repeat did and text repeat here.

    A did alone names no text: rows may repeat it, and all null ids are one.
    """
    return with_did(docs).withColumn("tid", F.xxhash64("text")).join(wanted.select("did", "tid", "sid"), ["did", "tid"]).select("sid", "text")


def _spread(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = elements(text, width)
                for at in range(0, len(found), 100_000):
                    some = found[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), sid)), pa.array(some)], names=["sid", "token"])

    return run


def _fits(percent: int) -> Column:
    """Can two sets of these sizes and sketches be alike enough?"""
    # Sets that fit in size have sketches of equal or of double length; the longer one is folded.
    fold = "CASE WHEN size({0}) > size({1}) THEN transform(sequence(0, size({1}) - 1), i -> {0}[i] ^ {0}[i + size({1})]) ELSE {0} END"
    differ = f"aggregate(zip_with({fold.format('pa', 'pb')}, {fold.format('pb', 'pa')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    # |intersection| >= t / (1 + t) * (|a| + |b|), so the symmetric difference is at most (1 - t) / (1 + t) of the sum.
    return F.expr(
        f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND (100 + {percent}) * ({differ}) <= (100 - {percent}) * (na + nb)"
    )


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are alike enough, written."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    pairs = settle(pairs.distinct().join(left, "a").join(right, "b").filter(_fits(percent)).select("a", "b"))
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "did", "tid"), "sid")
    texts = settle(texts_of(docs, wanted).groupBy("sid").agg(F.min("text").alias("text")))
    rows = (
        pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(32)(lambda text: elements(text, width))
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                x, y = known(ta.as_py()), known(tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = settle(rows.mapInArrow(run, "a long, b long"))
    release(pairs, texts)
    return links


def _crossing(percent: int, most: int | None = None):
    """Sorted (token, i, j, side, sid, component, n, sketch) to pairs (a, b) of sets of different components.

    A list comes as blocks ``i`` and ``j`` of it: each is compared with itself, or the rows of side 0 with those
    of side 1. Only pairs that fit in size and sketch leave, at most ``most`` for a row and its block; lists
    that had more are named by a row (token, null).
    """

    def batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        if b is None:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64())], names=["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)

    def close(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Does the sketch, cut to 512 bits, allow the pair?"""
        differ = np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)  # signed values lose bits
        return (100 + percent) * differ <= (100 - percent) * (n + m)

    def long(token: int, apart: bool, side: np.ndarray, sid: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One pair of blocks, row by row; members of the largest component are compared with the others only."""
        value, count = np.unique(comp, return_counts=True)
        rest = np.flatnonzero(comp != value[count.argmax()])
        place = np.full(len(sid), -1)
        place[rest] = np.arange(len(rest))
        over = False
        for i in rest.tolist():
            j = np.flatnonzero((comp != comp[i]) & fits(n, n[i]) & (place < place[i]) & ((side != side[i]) | (not apart)))
            j = j[close(n[j], n[i], bits[j], bits[i])]
            if most is not None and len(j) > most:
                over = True
                j = j[:: len(j) // most][:most]  # from all over the list
            if len(j):
                yield batch(np.full(len(j), sid[i]), sid[j])
        if over:
            yield batch(np.array([token]), None)

    def short(token: np.ndarray, sid: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All short lists side by side: rows are compared with those one, two, three ... places on."""
        brought, over = np.zeros(len(token), np.int64), []
        for step in range(1, SHORT_LIST):
            same = token[step:] == token[:-step]
            if not same.any():
                break
            i = np.flatnonzero(same & (comp[step:] != comp[:-step]) & fits(n[step:], n[:-step]))
            i = i[close(n[i], n[i + step], bits[i], bits[i + step])]
            if most is not None:
                over.append(token[i[brought[i] >= most]])
                i = i[brought[i] < most]
                brought[i] += 1
            if len(i):
                yield batch(sid[i], sid[i + step])
        if over and len(named := np.unique(np.concatenate(over))):
            yield batch(named, None)

    def whole(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, side, rest = columns[:3], columns[3], columns[4:]
        begin = np.append(0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1)
        size = np.diff(np.append(begin, len(side)))
        is_short = np.repeat((size <= SHORT_LIST) & (key[1][begin] == key[2][begin]), size)
        short_size = size[is_short[begin]]
        # Blocks of one list stay apart: a list of several blocks may have a short one.
        yield from _named(short(np.repeat(np.arange(len(short_size)), short_size), *(c[is_short] for c in rest)), key[0][begin[is_short[begin]]])
        for a, count in zip(begin[~is_short[begin]].tolist(), size[~is_short[begin]].tolist()):
            yield from long(int(key[0][a]), bool(key[1][a] != key[2][a]), *(c[a : a + count] for c in (side, *rest)))

    def _named(found: Iterator[pa.RecordBatch], tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        for rows in found:
            yield batch(tokens[rows.column(0).to_numpy()], None) if rows.column(1).null_count else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for rows in batches:
            if not rows.num_rows:
                continue
            bits = np.array(rows.column(7).flatten()).reshape(rows.num_rows, 8)
            columns = [*(rows.column(i).to_numpy() for i in range(7)), bits]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield from whole([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None and len(held[0]):
            yield from whole(held)

    return run


def candidates(lists: DataFrame, of_set: DataFrame, sketches: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (a, b) of sets of different components from ``lists`` (token, gid, n), and (token, null) for lists
    that had more than ``most`` for a row; ``of_set`` has sid, gid and comp, ``sketches`` sid and bits. Written."""
    inside = of_set.select("gid", "comp").distinct()
    spread = (
        lists.join(inside, "gid").groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    )
    rows = settle(
        lists.join(spread, "token", "left_semi").join(of_set, "gid").join(sketches, "sid").select("token", "sid", "comp", "n", "bits")
    )
    blocks = rows.groupBy("token").count().filter(F.col("count") > BLOCK).select("token", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (
        rows.join(blocks, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        .withColumn("own", own).withColumn("other", every)
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sid", "comp", "n", "bits")
    )
    keys = ["token", "i", "j"]
    found = settle(
        dealt.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("sid")).mapInArrow(_crossing(percent, most), "a long, b long").distinct()
    )
    release(rows)
    return found


def merged(of_set: DataFrame, links: DataFrame) -> DataFrame:
    """``of_set`` with the components that ``links`` (a, b) between sets join. Written."""
    own = of_set.select("sid", "comp")
    bridges = links.join(own.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), "a").join(
        own.select(F.col("sid").alias("b"), F.col("comp").alias("cb")), "b"
    ).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(bridges).select(F.col("node").alias("comp"), "component")
    return settle(of_set.join(joined, "comp", "left").select("sid", "gid", F.coalesce("component", "comp").alias("comp")))


def join_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id per document: the smallest doc_id that links lead to.

    Documents link when ``100 * |intersection| >= percent * |union|`` of their sets. Documents without
    words are linked with nothing. Rows that repeat a doc_id stay rows, each with its own text's set; null
    doc_ids count as the largest, so a component of theirs alone has a null id. Sets are told apart by
    64-bit hashes of their elements. Other columns are not read. No rows in, no rows out.
    """
    found = grouped(docs, width, percent)
    return found.select(_public("did").alias("doc_id"), F.col("n").alias("n_shingles"), _public("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, without near duplicates: of each component the smallest doc_id stays.

    Documents without words all stay. Of rows that repeat doc_id and text one stays, if it has words.
    """
    kept = settle(grouped(docs, width, percent).filter("chosen").select("did", "tid", "n").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64("text").alias("tid"))
    place = F.row_number().over(Window.partitionBy("did", "tid").orderBy("tid"))
    return rows.join(kept, ["did", "tid"]).withColumn("place", place).filter("place = 1 OR n = 0").select("row.*")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(did, tid, n, component, chosen) per document; ``chosen`` marks the smallest (did, tid) of a component."""
    found = settle(summarise(docs, width, percent))
    sets = settle(
        found.filter("n > 0").groupBy("sid")
        .agg(F.min(F.struct("did", "tid")).alias("least"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("parity").alias("parity"))
        .select("sid", "least", "least.did", "least.tid", "n", "first", "parity")
    )
    rows = settle(found.select("did", "tid", "sid", "n"))
    release(found)
    members = prefixes(docs, sets, width, percent)
    narrow = settle(sets.drop("first"))
    release(sets)
    sets = narrow
    # No two different sets of n elements, or of n and n + 1, can be alike enough where n is this small.
    entries = members.filter((F.col("sid") == F.col("gid")) & (100 * F.col("n") >= percent * (F.col("n") + 1))).select(F.explode("prefix").alias("token"), "gid", "n")
    several = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    alike = members.filter((F.col("sid") != F.col("gid")) & (100 * (F.col("n") - 1) >= percent * (F.col("n") + 1)))
    # A group is a list, too: its members may lie in different components.
    lists = settle(
        entries.join(several, "token", "left_semi").unionByName(
            alike.select(F.xxhash64(F.lit("group"), "gid").alias("token"), "gid", "n").distinct()
        )
    )
    of_set = settle(members.select("sid", "gid", F.col("sid").alias("comp")))
    links = verified(docs, sets, alike.select(F.col("sid").alias("a"), F.col("gid").alias("b")), width, percent)
    of_set = merged(of_set, links)
    release(members)
    # Sketches for lists are folded to 512 bits.
    folded = F.expr("transform(sequence(0, 7), i -> aggregate(transform(sequence(0, cast(size(parity) / 8 AS int) - 1), j -> parity[i + 8 * j]), 0L, (s, x) -> s ^ x))")
    sketches = settle(sets.select("sid", folded.alias("bits")))
    open_ = lists
    for most in ROUNDS:
        pairs = candidates(open_, of_set, sketches, percent, most)
        links = verified(docs, sets, pairs.filter("b IS NOT NULL"), width, percent)
        if not links.isEmpty():
            before, of_set = of_set, merged(of_set, links)
            release(before)
        more = settle(open_.join(pairs.filter("b IS NULL").select(F.col("a").alias("token")), "token", "left_semi"))
        release(pairs, open_)
        open_ = more
        if more.isEmpty():
            break
    release(open_, sketches)
    least = of_set.join(sets.select("sid", "least"), "sid").groupBy("comp").agg(F.min("least").alias("least"))
    ids = settle(of_set.join(least, "comp").select("sid", "least"))
    release(of_set, sets)
    own = F.struct("did", "tid")
    return rows.join(ids, "sid", "left").select(
        "did", "tid", "n", F.coalesce("least.did", "did").alias("component"), (F.col("least").isNull() | (F.col("least") == own)).alias("chosen")
    )


def _public(name: str) -> Column:
    """Back from the largest number to null."""
    return F.when(F.col(name) != LAST, F.col(name))
