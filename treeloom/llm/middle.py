"""Fill-in-middle transformation.

A text is cut into units (a run of ASCII letters, or one other code point) in its UTF-8 bytes, and its parts
are exchanged there. Places are bytes; the places that people count are code points. Between the two stands
a sparse index of exceptions: only the multibyte characters, each with its position and the bytes it has
beyond one. A cut is converted by a binary search in it; the ASCII spans in between are arithmetic, and a
text of ASCII letters alone has an empty index.

Everything happens on the document's own row: no shuffle, and memory for one Arrow batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class Exceptions:
    """Where a UTF-8 text departs from one byte a code point."""

    def __init__(self, raw: np.ndarray):
        self.size = len(raw)
        self.at_byte = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at_byte]
        self.excess = np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))
        before = np.append(0, self.excess[:-1]) if len(lead) else self.excess
        self.at_char = self.at_byte - before

    def _before(self, places: np.ndarray, cuts) -> np.ndarray:
        """Excess bytes of the characters that begin before each cut."""
        found = np.searchsorted(places, cuts)
        return np.where(found > 0, self.excess[np.maximum(found, 1) - 1], 0) if len(self.excess) else np.zeros_like(found)

    def chars(self, cuts) -> np.ndarray:
        """Code points before cuts given in bytes (at the start of a character, or the end)."""
        return np.asarray(cuts) - self._before(self.at_byte, cuts)

    def bytes(self, cuts) -> np.ndarray:
        """Bytes before cuts given in code points."""
        return np.asarray(cuts) + self._before(self.at_char, cuts)


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Bytes at which a unit begins: every character but a letter that follows a letter."""
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


class Cut(NamedTuple):
    """What became of a text: its units, the form, the output and where its parts lie in code points."""

    n: int
    form: str
    output: bytes
    prefix_chars: int | None
    middle_chars: int | None


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers below 2**32 by seed and doc_id; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(doc_id: int | None, data: bytes, rate: int = 90, spm: int = 20, seed: int = 1) -> Cut:
    """Cut one text, given as UTF-8, as its doc_id says.

    ``rate`` percent of the texts are changed, ``spm`` percent of these with the suffix first. Empty texts,
    and texts that hold a mark, stay plain.
    """
    raw = np.frombuffer(data, np.uint8)
    starts = unit_starts(raw)
    n = len(starts)
    a, b, changed, order = draws(doc_id, seed)
    if not n or changed % 100 >= rate or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return Cut(n, "plain", data, None, None)
    first, second = sorted((a % (n + 1), b % (n + 1)))
    ends = np.append(starts, len(raw))
    lo, hi = int(ends[first]), int(ends[second])
    to_lo, to_hi = Exceptions(raw).chars(np.array([lo, hi])).tolist()
    prefix, middle, suffix = data[:lo], data[lo:hi], data[hi:]
    if order % 100 < spm:
        return Cut(n, "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), to_lo, to_hi - to_lo)
    return Cut(n, "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), to_lo, to_hi - to_lo)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` was given, from output and form alone.

    No mark can arise where parts meet: each begins with the only ``<`` and ends with the only ``>`` in it.
    """
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"no {form} output")
    at, end = output.find(second), output.find(MIDDLE)
    if not 0 < at < end:
        raise ValueError(f"no {form} output")
    one, other, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return other + middle + one if form == "spm" else one + middle + other


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


ROWS = 64


def _per_row(names: list[str], kinds: list[pa.DataType], values, step: int = ROWS):
    """An Arrow task from (doc_id, text) rows to doc_id and ``values(doc_id, bytes)``, a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows = [values(i, t) for i, t in zip(part.column(0).to_pylist(), _texts(part.column(1)))]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    return run


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars: each document with its parts exchanged.

    One row per row; a null text counts as empty and stays plain, a null doc_id draws as no digits. Rows that
    repeat a doc_id draw alike. Other columns are not read. No rows in, no rows out.
    """

    def values(doc_id, data: bytes) -> tuple:
        cut = transform(doc_id, data, rate, spm, seed)
        return cut.n, cut.form, cut.output.decode(), cut.prefix_chars, cut.middle_chars

    run = _per_row(
        ["n", "form", "output", "prefix_chars", "middle_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()], values
    )
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {_kind(docs)}, n long, form string, output string, prefix_chars long, middle_chars long"
    )


def restored(cuts: DataFrame) -> DataFrame:
    """doc_id, text: the texts behind rows of ``fill_in_middle`` (doc_id, form, output)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o, f.as_py()).decode() for f, o in zip(batch.column(1), _texts(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return cuts.select("doc_id", "form", "output").mapInArrow(run, f"doc_id {_kind(cuts)}, text string")


def digests(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """``fill_in_middle`` with SHA-256 of the output and of the text restored from it, made where the text lies."""

    def values(doc_id, data: bytes) -> tuple:
        cut = transform(doc_id, data, rate, spm, seed)
        back = restore(cut.output, cut.form)
        return cut.n, cut.form, cut.prefix_chars, cut.middle_chars, hashlib.sha256(cut.output).hexdigest(), hashlib.sha256(back).hexdigest()

    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    run = _per_row(names, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], values, 512)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {_kind(docs)}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    )


def _kind(df: DataFrame) -> str:
    return dict(df.dtypes)["doc_id"]
