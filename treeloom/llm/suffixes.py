"""Suffix-array dedup: remove passages that an earlier document holds already.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document of smaller doc_id.

Which texts meet: a string of ``SPAN`` bytes holds 33 strings of 18 bytes, and the smallest of their
hashes is its anchor; equal strings have equal anchors. Starts that follow each other mostly share an
anchor, so a text has few. Anchors that only one text has are dropped, which leaves the stretches that may
repeat. They are dealt to shards by anchor, so equal strings meet; an anchor with more stretches than a
shard holds is split over several.

Per shard: the stretches form one text, whose suffix array is built by prefix doubling that refines only
unsorted groups (Larsson and Sadakane). Common prefixes of neighbours follow Kasai's rule: when a
suffix and its neighbour both move on by one byte, the common prefix shrinks by one, so only the heads of
such chains are compared. Runs of neighbours that share ``SPAN`` bytes are the classes of equal strings.

Across shards of a split anchor: each shard gives one string per class, of its smallest document; the
sorted strings of all shards are merged and searched by bisection for a still smaller document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from treeloom.llm.common import mix, release, settle

SPAN = 50
GRAM = 18
SHARD_ROWS = 32768
CHUNK_BYTES = 1 << 18
SEPARATOR = 0xFF  # no byte of UTF-8
LAST = (1 << 63) - 1


def anchors(data: bytes) -> np.ndarray:
    """The anchor of each start of a string of ``SPAN`` bytes."""
    starts = len(data) - SPAN + 1
    if starts < 1:
        return np.zeros(0, np.int64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4, 8):
        left = h[:-step] * np.uint64(0x9E3779B97F4A7C15)
        left ^= left >> np.uint64(29)
        left += h[step:]
        h = left
    h = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    for step in (1, 2, 4, 8, 16, 1):  # in all 33 grams
        h = np.minimum(h[:-step], h[step:])
    return h[:starts]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, end) of the runs of equal values."""
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return values[first], first, np.append(first[1:], len(values))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a byte text, sorted by what follows them, at least to ``depth`` bytes."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # past the end ranks first
    rank[order] = head + 1
    done = 8
    while done < depth:
        alone = fresh & np.append(fresh[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        some = order[places]
        group = rank[some]
        both = group * (n + 2) + rank[np.minimum(some + done, n)]
        by = np.argsort(both)
        some, both = some[by], both[by]
        order[places] = some
        split = np.ones(len(places), bool)
        split[1:] = both[1:] != both[:-1]
        fresh[places] = split
        rank[some] = np.maximum.accumulate(np.where(split, places, 0)) + 1
        done *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix of ``order`` with the one before it (0 for the first)."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    every = np.arange(n)
    # A chain goes on while the neighbour moves along; its heads are compared, the rest counts down.
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    length = np.zeros(n, np.int64)

    def compare(at: np.ndarray) -> None:
        a, b = at, before[at]
        keep = b >= 0
        at, a, b = at[keep], a[keep], b[keep]
        while len(at):
            ok = (a < n) & (b < n)
            ok[ok] = text[a[ok]] == text[b[ok]]
            at, a, b = at[ok], a[ok] + 1, b[ok] + 1
            length[at] += 1

    heads = every[head]
    while len(heads):
        compare(heads)
        start = np.maximum.accumulate(np.where(head, every, 0))
        left = length[start] - (every - start)
        # Where a chain has run out, its neighbours differ in the byte before: a new chain starts.
        heads = every[left == -1]
        head[heads] = True
    length = np.where(head, length, left)
    out = length[order]
    out[:1] = 0
    return out


def smallest_holders(stretches: list[bytes], holders: np.ndarray) -> list[np.ndarray]:
    """For each start of a string of ``SPAN`` bytes in each stretch: the smallest holder of that string."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    text = np.frombuffer((bytes([SEPARATOR])).join(stretches) + bytes([SEPARATOR]), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(stretches)), sizes + 1)
    inside = np.arange(len(text)) - begins[owner]
    is_start = inside <= (sizes - SPAN)[owner]
    order = suffix_array(text, SPAN)
    new_class = common_prefixes(text, order) < SPAN
    picked = is_start[order]
    class_of = np.cumsum(new_class)[picked]
    at = order[picked]
    first = np.flatnonzero(np.append(True, class_of[1:] != class_of[:-1]))
    least = np.minimum.reduceat(holders[owner[at]], first)
    answer = np.zeros(len(text), np.int64)
    answer[at] = np.repeat(least, np.diff(np.append(first, len(at))))
    return [answer[b : b + n - SPAN + 1] for b, n in zip(begins.tolist(), sizes.tolist())]


FOUND = "did long, tid long, lo long, hi long, mark binary"
_FOUND = pa.schema([("did", pa.int64()), ("tid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("mark", pa.binary())])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, salts, did, tid, lo, stretch), sorted by anchor and shard, to repeated spans."""
    kept: list[tuple] = []
    size = 0
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        kept += rows
        size += sum(len(r[6]) for r in rows)
        if size < CHUNK_BYTES or not kept:
            continue
        last = kept[-1][:2]
        cut = len(kept)
        while cut and kept[cut - 1][:2] == last:
            cut -= 1
        if cut:
            yield from _settle_rows(kept[:cut])
            kept = kept[cut:]
            size = sum(len(r[6]) for r in kept)
    if kept:
        yield from _settle_rows(kept)


def _settle_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    # Equal stretches count once, with their smallest holder.
    place: dict[tuple, int] = {}
    which = [place.setdefault((r[0], r[1], r[6]), len(place)) for r in rows]
    least = np.full(len(place), LAST, np.int64)
    np.minimum.at(least, which, np.array([r[3] for r in rows], np.int64))
    groups: dict[tuple, int] = {}
    for anchor, shard, _ in place:
        groups[anchor, shard] = groups.get((anchor, shard), 0) + 1
    keys = list(place)
    # A stretch that is alone with its anchor has nothing to be sorted against.
    several = [i for i, k in enumerate(keys) if groups[k[0], k[1]] > 1]
    per_start: dict[int, np.ndarray] = {}
    if several:
        # Keep shards of a split anchor apart: their stretches meet only in the merge.
        parts: dict[int, list[int]] = {}
        for i in several:
            parts.setdefault(keys[i][1], []).append(i)
        for some in parts.values():
            per_start |= zip(some, smallest_holders([keys[i][2] for i in some], least[some]))
    ends = {i: (int(v.min()), int(v.max())) for i, v in per_start.items()}
    out: list[tuple] = []
    for (anchor, shard, salts, did, tid, lo, stretch), i in zip(rows, which):
        low, high = ends.get(i) or (int(least[i]),) * 2
        if did > high:
            out.append((did, tid, lo, lo + len(stretch), None))
        elif did > low or salts > 1:
            values = per_start[i] if i in per_start else np.full(len(stretch) - SPAN + 1, least[i])
            for covered, a, b in zip(*runs(values < did)):
                if covered:
                    out.append((did, tid, lo + int(a), lo + int(b) + SPAN - 1, None))
                elif salts > 1:
                    for s in range(int(a), int(b)):
                        out.append((did, tid, lo + s, lo + s + SPAN, hashlib.blake2b(stretch[s : s + SPAN], digest_size=16).digest()))
        if len(out) >= 20_000:
            yield _found(out)
            out = []
    if out:
        yield _found(out)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives of all shards, sorted by string and holder, to those with a smaller holder elsewhere."""
    last, holder = b"", LAST
    for batch in batches:
        marks = np.array(batch.column(4).to_pylist(), dtype="S16")
        dids = batch.column(0).to_numpy()
        strings, first = np.unique(marks, return_index=True)
        least = dids[first].copy()
        if len(strings) and strings[0] == last:
            least[0] = min(least[0], holder)
        smaller = least[np.searchsorted(strings, marks)]
        yield batch.filter(pa.array(smaller < dids))
        if len(strings):
            last, holder = strings[-1], int(least[-1])


def with_keys(docs: DataFrame, *more: Column) -> DataFrame:
    """body, the text (null as empty), with did, the doc_id with null as the largest, and tid, a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), text.alias("body")).withColumn("tid", F.xxhash64("body"))


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            found = [np.unique(anchors(t.encode("utf-8", "surrogatepass"))) for t in part.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), pa.array(np.repeat(part.column(0).to_numpy(), sizes))], names=["anchor", "tid"]
                )


STRETCH = "anchor long, shard int, salts int, did long, tid long, lo long, stretch binary"


def _emit_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (did, tid, body, shared anchors, their salts) to the stretches of these anchors."""
    schema = pa.schema([("anchor", pa.int64()), ("shard", pa.int32()), ("salts", pa.int32()), ("did", pa.int64()), ("tid", pa.int64()), ("lo", pa.int64()), ("stretch", pa.binary())])
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows: list[tuple] = []
            for did, tid, body, shared, salts in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                data = body.encode("utf-8", "surrogatepass")
                value, first, end = runs(anchors(data))
                known = dict(zip(shared, salts))
                for a, s, e in zip(value.tolist(), first.tolist(), end.tolist()):
                    n = known.get(a)
                    if n:
                        rows.append((a, tid % n, n, did, tid, s, data[s : e + SPAN - 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repeated_spans(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(did, tid, lo, hi): spans of bytes to remove, per document whose text no smaller doc_id has. Written.

    Spans may overlap. ``first`` and whole copies are in ``plan``.
    """
    keyed = with_keys(docs)
    firsts = _firsts(keyed)
    found = keyed.select("tid", "body").mapInArrow(_emit_anchors, "anchor long, tid long")
    by_anchor = Window.partitionBy("anchor")
    shared = (
        found.withColumn("lo", F.min("tid").over(by_anchor))
        .withColumn("hi", F.max("tid").over(by_anchor))
        .withColumn("n", F.count("tid").over(by_anchor))
        .filter("lo <> hi")
        .select("tid", "anchor", F.ceil(F.col("n") / shard_rows).cast("int").alias("salts"))
    )
    lists = shared.groupBy("tid").agg(F.collect_set(F.struct("anchor", "salts")).alias("shared"))
    lists = settle(lists.join(firsts.select("tid", "did").distinct(), "tid").select("did", "tid", F.col("shared.anchor").alias("shared"), F.col("shared.salts").alias("salts")))
    stretches = keyed.join(lists, ["did", "tid"]).select("did", "tid", "body", "shared", "salts").mapInArrow(_emit_stretches, STRETCH)
    spans = settle(stretches.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard").mapInArrow(_shard, FOUND))
    merged = spans.filter("mark IS NOT NULL").repartition("mark").sortWithinPartitions("mark", "did").mapInArrow(_merge, FOUND)
    done = settle(spans.filter("mark IS NULL").unionByName(merged).select("did", "tid", "lo", "hi"))
    release(lists, spans)
    return done


def _firsts(keyed: DataFrame) -> DataFrame:
    """(digest, tid, did): the smallest holder of each distinct text."""
    return keyed.groupBy(F.sha2("body", 256).alias("digest"), "tid").agg(F.min("did").alias("did"))


def dedup(docs: DataFrame, columns: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """row (a struct of ``columns``), n_bytes, n_removed, n_spans, kept (the bytes that stay), text (kept, decoded).

    A null text counts as empty; texts under ``SPAN`` bytes keep all. Rows that repeat a doc_id do not
    count as smaller than each other; a null doc_id is larger than any other. A text that a smaller doc_id
    holds as a whole goes as a whole. A cut may fall into a character; decoding drops its rest. No rows in,
    no rows out.
    """
    keyed = with_keys(docs, F.struct(*columns).alias("row"))
    narrow = with_keys(docs)
    firsts = _firsts(narrow).select("tid", F.col("did").alias("first"))
    found = repeated_spans(docs, shard_rows)
    spans = found.groupBy("did", "tid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    plan = settle(
        narrow.select("did", "tid").distinct().join(firsts, "tid").join(spans, ["did", "tid"], "left")
        .select("did", "tid", (F.col("did") > F.col("first")).alias("copy"), F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    )
    release(found)
    joined = keyed.join(plan, ["did", "tid"], "left").select("row", "body", "copy", "lo", "hi")
    counts = [StructField(name, LongType()) for name in ("n_bytes", "n_removed", "n_spans")]
    out = StructType([joined.schema["row"], *counts, StructField("kept", BinaryType()), StructField("text", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for body, copy, lo, hi in zip(*(c.to_pylist() for c in part.columns[1:])):
                    data = body.encode("utf-8", "surrogatepass")
                    spans = [(0, len(data))] if copy and len(data) >= SPAN else list(zip(lo or [], hi or []))
                    kept, gone, n = remaining(data, spans)
                    rows.append((len(data), gone, n, kept, kept.decode("utf-8", "ignore")))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=out.names)

    return joined.mapInArrow(cut, out)


def remaining(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays of ``data`` without the spans, how many bytes go, and in how many maximal runs."""
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    at, out = 0, []
    for lo, hi in merged:
        out.append(data[at:lo])
        at = hi
    out.append(data[at:])
    return b"".join(out), sum(hi - lo for lo, hi in merged), len(merged)
