"""Best-fit packing of documents into sequences of equal capacity, by linear grouping.

Lengths are whole numbers up to the capacity, so the histogram of lengths says all that a packing needs, and
it has at most as many rows as the capacity, whatever the corpus. The plan is made from it:

1. Linear grouping: long pieces, longest first, are dealt into groups of equally many; within a group every
   length counts as the longest one. So there are few sizes.
2. Configurations: a linear program over the ways to fill a sequence with these sizes, its columns found by
   a knapsack as they pay, is solved and rounded down.
3. Substitution: the slots of a configuration take the group's actual pieces in order, which leaves gaps.
4. Best fit: pieces left over by the rounding and the short ones go, longest first, each into the smallest gap
   that holds it, or into new sequences.

Where long begins is tried at more than one length, and the plan of fewest sequences is taken. All four steps
work on runs: so many pieces of one length, taken from their n-th on, lie side by side at one place
in so many sequences in a row. The number of runs depends on capacity and groups, not on the corpus.

On the cluster: a document is encoded and cut where it lies; a piece is numbered among those of its length by
its partition and its place in it, so no group is gathered to number it; then each piece looks up its run.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.bpe import CACHE_WORDS, WordBpe
from treeloom.llm.common import settle

CAPACITY = 4096
TRIES = ((2, 64), (3, 64), (6, 64))  # (pieces are long if fewer than this many fill a sequence, groups of them)
ROUNDS = 2000  # columns that the linear program may try; it is feasible at any time
TINY = 1e-9
SLICE = 1 << 22  # bytes of text encoded at once: many new words go side by side, and long texts do not add up


# ---- configurations


def best_filling(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, and how often it takes each."""
    use = np.flatnonzero(values > TINY)
    best = np.zeros(capacity + 1)
    steps = []
    for _ in range(capacity // int(sizes[use].min()) if len(use) else 0):
        new, took = best.copy(), np.full(capacity + 1, -1)
        for k in use:
            with_k = best[: capacity + 1 - sizes[k]] + values[k]
            better = with_k > new[sizes[k] :] + TINY
            new[sizes[k] :][better] = with_k[better]
            took[sizes[k] :][better] = k
        if (took < 0).all():
            break
        steps.append(took)
        best = new
    counts, at = np.zeros(len(sizes), np.int64), capacity
    for took in reversed(steps):
        if took[at] >= 0:
            counts[took[at]] += 1
            at -= int(sizes[took[at]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, counts per size): a near-optimal fractional packing of the sizes, rounded down.

    Revised simplex; the column to enter is the best filling at the current prices, or one that leaves a slot
    empty where a price is negative.
    """
    if not len(sizes):
        return []
    basis = np.diag(capacity // sizes).astype(float)
    cost = np.ones(len(sizes))
    for _ in range(ROUNDS):
        prices = np.linalg.solve(basis.T, cost)
        if prices.min() < -TINY:
            column, price = np.zeros(len(sizes)), 0.0
            column[prices.argmin()] = -1
        else:
            value, counts = best_filling(sizes, prices, capacity)
            if value <= 1 + 1e-7:
                break
            column, price = counts.astype(float), 1.0
        have, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        rising = step > TINY
        if not rising.any():
            break
        ratio = np.where(rising, have / np.where(rising, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, price
    have = np.floor(np.linalg.solve(basis, demand) + 1e-6).astype(np.int64)
    return [(int(n), basis[:, i].astype(np.int64)) for i, n in enumerate(have) if n > 0 and cost[i]]


# ---- the plan


class Plan:
    """Runs (length, first, count, sequence, offset): pieces of a length from the ``first`` on lie at ``offset``
    in the sequences from ``sequence`` on, one in each."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int, fill: int, groups: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (sequence, how many from there on)
        self.open: list[int] = []  # gaps in order
        order = np.argsort(-lengths)
        lengths, counts = lengths[order], counts[order]
        is_long = lengths * fill > capacity
        left = [(int(n), 0, int(c)) for n, c in zip(lengths[~is_long], counts[~is_long])]
        left += self._configured(lengths[is_long], counts[is_long], groups)
        for length, first, count in sorted(left, reverse=True):
            self._best_fit(length, first, count)
        self.table = np.array(sorted(self.runs), np.int64).reshape(-1, 5)

    def _configured(self, lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
        """Pack the long pieces; return (length, first, count) of those left over."""
        ends = np.cumsum(counts)
        if not len(ends):
            return []
        total = int(ends[-1])
        size = -(-total // groups)
        begins = np.arange(0, total, size)
        sizes, firsts = np.unique(-lengths[np.searchsorted(ends, begins, side="right")], return_index=True)
        sizes, stops = -sizes, np.append(begins[firsts][1:], total)
        used = begins[firsts].copy()
        for times, pattern in configurations(sizes, (stops - used).astype(float), self.capacity):
            slots = []  # the places of the pieces that each slot takes
            for k in np.flatnonzero(pattern):
                for _ in range(pattern[k]):
                    take = min(times, int(stops[k] - used[k]))
                    if take:
                        slots.append((int(used[k]), take))
                        used[k] += take
            self._substitute(slots, lengths, ends)
        rest = []
        for a, b in zip(used, stops):
            rest += [(n, first, count) for n, first, count, _ in _spans(int(a), int(b - a), lengths, ends)]
        return rest

    def _substitute(self, slots: list[tuple[int, int]], lengths: np.ndarray, ends: np.ndarray) -> None:
        """Fill sequences side by side with the pieces of each slot, wherever lengths change anew."""
        filled = [_spans(a, n, lengths, ends) for a, n in slots]
        cuts = sorted({0, *(at + count for spans in filled for _, _, count, at in spans)})
        at_span = [0] * len(filled)
        for lo, hi in zip(cuts, cuts[1:]):
            offset = 0
            for i, spans in enumerate(filled):
                while at_span[i] < len(spans) and spans[at_span[i]][3] + spans[at_span[i]][2] <= lo:
                    at_span[i] += 1
                if at_span[i] < len(spans):
                    length, first, _, at = spans[at_span[i]]
                    self.runs.append((length, first + lo - at, hi - lo, self.sequences + lo, offset))
                    offset += length
            self._add_gap(self.capacity - offset, self.sequences + lo, hi - lo)
        self.sequences += cuts[-1]

    def _add_gap(self, gap: int, sequence: int, count: int) -> None:
        if gap > 0 and count > 0:
            if not self.gaps[gap]:
                insort(self.open, gap)
            self.gaps[gap].append((sequence, count))

    def _best_fit(self, length: int, first: int, count: int) -> None:
        """Place pieces of one length one after the other, as runs: a sequence is filled before the next one."""
        while count:
            at = bisect_left(self.open, length)
            if at < len(self.open):
                gap = self.open[at]
                sequence, many = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    self.open.pop(at)
            else:
                gap, sequence, many = self.capacity, self.sequences, -(-count // (self.capacity // length))
                self.sequences += many
            each = gap // length
            whole = min(many, count // each)
            for sequences, start, pieces in ((whole, sequence, each), (min(1, many - whole), sequence + whole, min(each, count - whole * each))):
                if not sequences or not pieces:
                    continue
                for i in range(pieces):
                    self.runs.append((length, first, sequences, start, self.capacity - gap + i * length))
                    first += sequences
                self._add_gap(gap - pieces * length, start, sequences)
                count -= sequences * pieces
                many -= sequences
                sequence = start + sequences
            self._add_gap(gap, sequence, many)

    def find(self, lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers among their length."""
        rows, keys = self.table, self.table[:, 0] << 44 | self.table[:, 1]
        at = np.searchsorted(keys, lengths << 44 | places, side="right") - 1
        return rows[at, 3] + places - rows[at, 1], rows[at, 4]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, tries: tuple[tuple[int, int], ...] = TRIES) -> Plan:
    """The plan of fewest sequences for a histogram of lengths."""
    return min((Plan(lengths, counts, capacity, *t) for t in tries), key=lambda p: p.sequences)


def _spans(first: int, count: int, lengths: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The pieces at some places, by length: (length, number of the first of that length, count, how many before)."""
    out, done = [], 0
    i = int(np.searchsorted(ends, first, side="right"))
    while done < count:
        begin = int(ends[i - 1]) if i else 0
        take = min(count - done, int(ends[i]) - (first + done))
        out.append((int(lengths[i]), first + done - begin, take, done))
        done += take
        i += 1
    return out


# ---- the job


class Ids:
    """The ids of texts as little-endian 32-bit numbers, words met before looked up."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.known: dict[str, bytes] = {}
        self.special = {w: i.to_bytes(4, "little") for w, i in self.bpe.special.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """As the vocabulary's library gives them, special strings as their tokens; null counts as empty."""
        bpe, split, odd = self.bpe, [], {}
        for i, t in enumerate(texts):
            t = t or ""
            if any(w in t for w in self.special):
                odd[i] = list(bpe.words(t))
                split.append([w for special, w in odd[i] if not special])
            else:
                split.append(bpe.pieces(bpe.normalise(t)))
        every = set().union(*split)
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(every)
        ids = bpe.encode_words(new)
        data, ends = np.array([x for part in ids for x in part], "<u4").tobytes(), np.cumsum([0, *(4 * len(part) for part in ids)]).tolist()
        self.known.update(zip(new, (data[a:b] for a, b in zip(ends, ends[1:]))))
        find = self.known.__getitem__
        out = [b"".join(map(find, words)) for words in split]
        for i, words in odd.items():
            out[i] = b"".join(self.special[w] if special else find(w) for special, w in words)
        return out


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts, in its second column, have at most ``most`` bytes together; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 1, ids: bool = False) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32, with their partition and number there
    among those of their length, and their ids (little-endian, four bytes each) if asked for."""
    named = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int64(), "place": pa.int64()}
    if ids:
        named["ids"] = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = Ids(path), Counter(), TaskContext.get().partitionId()
        last = end.to_bytes(4, "little")
        for batch in batches:
            for some in slices(batch):
                rows, of = [], []
                for i, data in enumerate(encoder.encode(some.column(1).to_pylist())):
                    data += last
                    for n, start in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[start : start + 4 * capacity]
                        length = len(cut) // 4
                        rows.append((n, start // 4, length, zlib.crc32(cut), part, seen[length], cut)[: len(named)])
                        seen[length] += 1
                        of.append(i)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), named.values())]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), *columns], names=["doc_id", *named])

    kind = dict(docs.dtypes)["doc_id"]
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, place long" + (", ids binary" if ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 1, tries=TRIES, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row per piece of a document.

    A document's ids end with ``end``; only longer ones are cut, every ``capacity`` ids. Pieces of a sequence
    lie gapless from 0. A null or empty text is one piece of one id. Repeated rows, and rows that share a
    doc_id or have none, are documents of their own. Other columns are not read. No rows in, no rows out.

    The driver sees the histogram of lengths, at most ``capacity`` rows; the plan goes to the tasks.
    """
    cut = settle(pieces(docs, path, capacity, end, ids))
    each = settle(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = each.groupBy("length").agg(F.sum("n").alias("n")).collect()
    made = plan(np.array([r.length for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), capacity, tries)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = settle(each.select("length", "part", F.coalesce(before, F.lit(0)).alias("base")))
    named = cut.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), (F.col("base") + F.col("place")).alias("number")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = made.find(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return named.mapInArrow(run, shape + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences whole (``pack`` with ``ids=True``); each is at most one capacity long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.expr("aggregate(parts, X'', (all, p) -> concat(all, p.ids))").alias("ids")
    )
