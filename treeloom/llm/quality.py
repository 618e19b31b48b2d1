"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated output.

Random indexing: each term has a sparse ternary index vector drawn from its hash; a term's word vector is
the sum of the index vectors of the terms around it. A text gives terms for its words and for their forms
(upper case, digits, runs of signs, repeats), so unknown words still count by their form. A document is the
mean of its terms' vectors; the network maps it to a logit, and a temperature, fitted on rows the network
did not see, makes a probability of it.

Vocabulary, word vectors and network are fitted on a bounded sample of labelled rows; every document is
scored on its whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import settle

DIM = 48
NONZERO = 6
AROUND = 2
PIECE = 1 << 15
SAMPLE = 8192  # labelled documents to fit on
VOCABULARY = 8192  # most frequent terms of the sample
HIDDEN = 24
TOKEN = re.compile(r"\w+|[^\w\s]+")
REPEAT = "<repeat>"


def form(token: str) -> str:
    """The form of a token: kind, case and length class."""
    if not (token[0].isalnum() or token[0] == "_"):
        return f"<sign {token[0]} {min(len(token), 4)}>"
    if token.isdigit():
        return "<digits>"
    case = "upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower"
    return f"<{case} {'long' if len(token) > 12 else 'some' if len(token) > 3 else 'short'}>"


def index_vector(term: str, dim: int = DIM) -> np.ndarray:
    """Sparse ternary vector of a term."""
    data = hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=4 * NONZERO).digest()
    out = np.zeros(dim, np.int64)
    for i in range(NONZERO):
        number = int.from_bytes(data[4 * i : 4 * i + 4], "big")
        out[number % dim] += 1 if number >> 31 else -1
    return out


def terms(text: str) -> list[str]:
    """All terms of a text in order: each token's form, then its word; a repeat after an equal token."""
    out, last = [], None
    for token in TOKEN.findall(text):
        out.append(form(token))
        out.append(token.lower())
        if token == last:
            out.append(REPEAT)
        last = token
    return out


@dataclass
class Model:
    """Everything a score needs."""

    rows: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    offset: float
    temperature: float

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """Mean vectors of the terms of each text, words and forms apart, with the share of repeats."""
        codes = self._codes
        out = np.zeros((len(texts), 2 * self.vectors.shape[1] + 1))
        for i, text in enumerate(texts):
            tokens = TOKEN.findall(text or "")
            if not tokens:
                continue
            counts = Counter(tokens)
            pairs = np.array([codes[t] for t in counts], np.int64)
            weight = np.fromiter(counts.values(), np.float64, len(counts)) / len(tokens)
            out[i, : -1] = np.concatenate([weight @ self.vectors[pairs[:, 0]], weight @ self.vectors[pairs[:, 1]]])
            out[i, -1] = sum(map(str.__eq__, tokens, tokens[1:])) / len(tokens)
        return out

    @property
    def _codes(self) -> dict:
        if not hasattr(self, "_known"):
            self._known = _Codes(self.rows)
        if len(self._known) > 400_000:
            self._known.clear()
        return self._known

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.tanh((pooled - self.mean) / self.scale @ self.first + self.bias)
        return hidden @ self.second + self.offset

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probability of label 1."""
        return _sigmoid(self.logits(self.pooled(texts)) / self.temperature)


class _Codes(dict):
    """Token to the rows of its word and its form; row 0 is the zero vector."""

    def __init__(self, rows: dict[str, int]):
        super().__init__()
        self.rows = rows

    def __missing__(self, token: str) -> tuple[int, int]:
        got = self[token] = (self.rows.get(token.lower(), 0), self.rows.get(form(token), 0))
        return got


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total.update(terms(text or ""))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])


def word_vectors(texts: DataFrame, vocabulary: int = VOCABULARY, dim: int = DIM) -> tuple[dict[str, int], np.ndarray]:
    """Rows of terms, and their vectors, from a bounded table of texts: sums over the neighbours of each term.

    Sums are of whole numbers, so they do not depend on how the rows are dealt to tasks.
    """
    counts = texts.select("text").mapInArrow(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    chosen = [r.term for r in counts.orderBy(F.desc("n"), "term").limit(vocabulary).collect()]
    rows = {t: i + 1 for i, t in enumerate(chosen)}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.stack([np.zeros(dim, np.int64), *(index_vector(t, dim) for t in chosen)])
        sums = np.zeros_like(index)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.array([rows.get(t, 0) for t in terms(text or "")], np.int64)
                # In pieces with the neighbours of their ends, so a long text needs no more than a piece.
                for begin in range(0, len(ids), PIECE):
                    low = max(0, begin - AROUND)
                    vectors = index[ids[low : begin + PIECE + AROUND]]
                    near = np.zeros_like(vectors)
                    for step in range(1, AROUND + 1):
                        near[step:] += vectors[:-step]
                        near[:-step] += vectors[step:]
                    own = ids[begin : begin + PIECE]
                    np.add.at(sums, own, near[begin - low : begin - low + len(own)])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((len(rows) + 1, dim), np.int64)
    # Each task returns one table of the vocabulary; the sample is in a fixed number of tasks.
    for r in texts.select("text").coalesce(4).mapInArrow(around, "sums binary").toLocalIterator():
        total += np.frombuffer(r.sums, np.int64).reshape(total.shape)
    vectors = total.astype(np.float64)
    vectors[0] = 0
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return rows, np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = 250, seed: int = 5) -> tuple:
    """Mean, scale and weights of a two-layer network: tanh, then one logit; full batches, Adam, weight decay."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    weights = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        h = np.tanh(x @ weights[0] + weights[1])
        error = (_sigmoid(h @ weights[2] + weights[3]) - y) / len(y)
        back = np.outer(error, weights[2]) * (1 - h**2)
        slopes = [x.T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ error + 1e-4 * weights[2], error.sum(keepdims=True)]
        for w, g, m, v in zip(weights, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return mean, scale, weights[0], weights[1], weights[2], float(weights[3][0])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that makes unseen labels likeliest; 1 without such labels."""
    if not len(y) or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(16), 121))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fold(doc_id) -> object:
    """The remainder that holds rows out: CRC-32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """Fit on at most ``sample`` labelled documents with a remainder other than 0, chosen by hash.

    Labels that are null are not used; of several labels of one document the mean decides, 0.5 as 1. Without
    labels, or with labels of one kind, the model gives the share of ones (0.5 without any).
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    one = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = one.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: the documents need not move.
    texts = settle(docs.select("doc_id", "text").join(F.broadcast(settle(chosen)), "doc_id").select("doc_id", "text", "y"))
    rows, vectors = word_vectors(texts, vocabulary)
    empty = Model(rows, vectors, np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = empty.pooled(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in found], pa.binary())], names=["doc_id", "y", "x"])

    seen = sorted((r.doc_id, r.x, r.y) for r in texts.mapInArrow(pooled, "doc_id long, y int, x binary").toLocalIterator())
    y = np.array([r[2] for r in seen], np.float64)
    width = 2 * vectors.shape[1] + 1
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Model(rows, vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    x = np.stack([np.frombuffer(r[1]) for r in seen])
    later = np.array([hashlib.md5(str(r[0]).encode()).digest()[15] % 5 == 0 for r in seen])
    if not later.any() or y[~later].min(initial=1) == y[~later].max(initial=0):
        later[:] = False
    network = fit_network(x[~later], y[~later])
    model = Model(rows, vectors, *network, 1.0)
    model.temperature = fit_temperature(model.logits(x[later]), y[later]) if later.any() else 1.0
    return model


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of the documents with ``score``; null and empty texts are scored as texts without terms."""
    schema = docs.select(*columns).schema.add("score", "double")
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(model.scores(part.column(width).to_pylist()), pa.float64())], names=[*columns, "score"]
                )

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, with a score of at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep = model.scores(part.column(1).to_pylist()) >= threshold
                yield part.select([0]).filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted per document. Only the text is scored.

    A null doc_id has no remainder and is not held out. Repeated rows stay rows; other columns are not
    read. No rows in, no rows out.
    """
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
