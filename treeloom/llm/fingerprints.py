"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line of the text) maps to a wide vector: four 64-bit lanes of its BLAKE2b digest, and 64
64-bit lanes into which its word triples are counted with a sign, each triple into one lane. A document's
fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2**64, so that no count of a text
wraps. As text, counts take the fewest bytes of 1, 2, 4 or 8 that hold all of them. So the order of
paragraphs does not matter, a paragraph can be added or taken away by adding or subtracting its vector
(``plus``, ``minus``), equal multisets have equal fingerprints, and unequal ones differ in the digest
lanes unless 256 bits collide. The counted lanes are a sketch that keeps inner products, so two
fingerprints tell how alike their documents are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import mix, settle, word_hashes

LANES = 64
WIDE = 4
EMPTY = (np.zeros(WIDE, np.uint64), np.zeros(LANES, np.int64))

Vector = tuple[np.ndarray, np.ndarray]


def paragraph(line: str) -> Vector:
    """The wide vector of one paragraph."""
    return total([line])


def total(lines: Iterable[str]) -> Vector:
    """The sum of the vectors of some paragraphs; triples never span two of them."""
    wide = np.zeros(WIDE, np.uint64)
    hashes, starts = [], []
    for line in lines:
        data = line.encode("utf-8", "surrogatepass")
        wide += np.frombuffer(hashlib.blake2b(data, digest_size=8 * WIDE).digest(), "<u8")
        found = word_hashes(data)
        if len(found) > 2:
            found = mix(found[:-2] * np.uint64(3) + found[1:-1] * np.uint64(5) + found[2:] * np.uint64(7))
        hashes.append(found)
        starts.append(len(found))
    triples = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if not len(triples):
        return wide, np.zeros(LANES, np.int64)
    triples = mix(triples)
    signs = np.where(triples >> np.uint64(63), 1, -1)
    lanes = np.bincount((triples % np.uint64(LANES)).astype(np.int64), weights=signs, minlength=LANES)
    return wide, lanes.astype(np.int64)


def plus(a: Vector, b: Vector) -> Vector:
    """Insert paragraphs."""
    return a[0] + b[0], a[1] + b[1]


def minus(a: Vector, b: Vector) -> Vector:
    """Delete paragraphs."""
    return a[0] - b[0], a[1] - b[1]


def pack(vector: Vector) -> str:
    """A fingerprint as text."""
    low, high = int(vector[1].min()), int(vector[1].max())
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return base64.b64encode(vector[0].astype("<u8").tobytes() + vector[1].astype(f"<i{width}").tobytes()).decode()


def unpack(text: str) -> Vector:
    """The fingerprint written as text."""
    data = base64.b64decode(text)
    return np.frombuffer(data[: 8 * WIDE], "<u8").astype(np.uint64), np.frombuffer(data[8 * WIDE :], f"<i{(len(data) - 8 * WIDE) // LANES}").astype(np.int64)


def likeness(a: Vector, b: Vector) -> float:
    """Estimated cosine of the word triples of two documents, 0 to 1; 1 for equal fingerprints."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = np.sqrt(x.dot(x) * y.dot(y))
    return float(min(1.0, max(0.0, x.dot(y) / size))) if size else 0.0


def of_text(text: str | None) -> Vector:
    """The fingerprint of a text; null counts as empty, which is one empty paragraph."""
    return total((text or "").split("\n"))


OUT = "part long, role string, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair(doc_id, text: str, own: Vector, after: str, next_own: Vector) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = of_text(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(own), pack(changed),
        likeness(own, changed), likeness(own, next_own),
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each document of a sorted partition with the following one; mark both ends."""
    part = TaskContext.get().partitionId()
    schema = _arrow_schema()
    before = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            own = of_text(text)
            if before is None:
                rows.append((part, "first", doc_id, text) + (None,) * 6)
            else:
                rows.append((part, None, before[0], None) + _pair(*before, text, own)[1:])
            before = (doc_id, text, own)
        yield _batch(rows, schema)
    if before is not None:
        yield _batch([(part, "last", before[0], before[1]) + (None,) * 6], schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in OUT.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            rows.append((r["part"], None, r["doc_id"], None) + _pair(r["doc_id"], r["text"], of_text(r["text"]), r["after"], of_text(r["after"]))[1:])
        yield _batch(rows, _arrow_schema())


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The edited text replaces the last half (rounded down) of a text by as many code points from the
    start of the next document by descending doc_id, or by all of that document if it is shorter; the
    last document goes on with the first. Documents are sorted by range, so a partition knows all
    neighbours but that of its last row; the two ends of each partition (two rows of each, whatever the
    size of the input) are joined afterwards. Rows with equal doc_id follow each other by a hash of
    their text, null doc_id come last, a null text counts as empty, a single document is its own next.
    Other columns are not read. No rows in, no rows out.
    """
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text", tie.alias("_tie"))
    order = [F.desc_nulls_last("doc_id"), F.desc("_tie")]
    walked = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_walk, OUT))
    done = walked.filter("role IS NULL")
    first = walked.filter("role = 'first'").select("part", F.col("text").alias("after"))
    last = walked.filter("role = 'last'").select("part", "doc_id", "text")
    # Partitions that hold rows, in order: each is followed by the next of them, and the last by the first.
    numbers = [r.part for r in first.select("part").sort("part").collect()]
    if not numbers:
        return _result(done)
    ring = docs.sparkSession.createDataFrame(
        [(a, b) for a, b in zip(numbers, numbers[1:] + numbers[:1])], "part long, follower long"
    )
    ends = (
        last.join(F.broadcast(ring), "part")
        .join(first.withColumnRenamed("part", "follower"), "follower")
        .select("part", "doc_id", "text", "after")
        .mapInArrow(_ends, OUT)
    )
    return _result(done.unionByName(ends))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
