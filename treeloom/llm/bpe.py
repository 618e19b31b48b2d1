"""BPE encoding and decoding with a public vocabulary of whole words (lower case, word ends).

A word's parts lie in one contiguous array of boundaries beside one of the ranks of adjacent pairs. Each
round scans for the smallest rank (the leftmost of equals), deletes the boundary between its two parts
and looks up the ranks of the two new neighbours. That is quadratic in the length of a word, so it serves
words up to ``SHORT`` symbols; longer ones use linked parts and a heap, which gives the same merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SHORT = 64
NONE = 1 << 30
CACHE_WORDS = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the other bytes for the letters from U+0100 on, in order."""
    plain = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        # A pair of ids merges into an id; the earlier pair of the list goes first.
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if self.merges.setdefault((self.vocab[left], self.vocab[right]), len(self.made)) == len(self.made):
                self.made.append(self.vocab[left + right])
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.made_ids = np.array([*self.made, -1], np.int32)
        self.inner = [self.vocab[x] for x in self.letters]
        self.final = [self.vocab[x + self.end] for x in self.letters]
        self.inner_ids, self.final_ids = np.array(self.inner, np.int32), np.array(self.final, np.int32)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self.latin = re.compile(_latin(self.pattern))
        self.any = None
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.known: dict[str, str] = {}

    def normalise(self, text: str) -> str:
        """The vocabulary's normal form: NFC and lower case, letter by letter. White space only divides."""
        try:
            text.encode("latin-1")  # such texts are in NFC already
        except UnicodeEncodeError:
            from tokenizers import normalizers

            return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normal text."""
        try:
            text.encode("latin-1")  # the engines agree on these letters
        except UnicodeEncodeError:
            self.any = self.any or regex.compile(_as_library(self.pattern))
            return self.any.findall(text)
        return self.latin.findall(text)

    def words(self, text: str) -> Iterator[tuple[bool, str]]:
        """Parts of a text in order: (is it a special token, piece). Other special strings are ordinary text."""
        at = 0
        for m in self.specials.finditer(text):
            for w in self.pieces(self.normalise(text[at : m.start()])):
                yield False, w
            yield True, m.group()
            at = m.end()
        for w in self.pieces(self.normalise(text[at:])):
            yield False, w

    def symbols(self, data: bytes) -> list[int]:
        """Ids of the bytes of a word, the last one with the word's end."""
        return [*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each piece. Short pieces of one length are merged side by side, a row of arrays each."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        parts: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, d in enumerate(data):
            by_size.setdefault(len(d), []).append(i)
        for size, rows in by_size.items():
            if size > SHORT:
                for i in rows:
                    parts[i] = self._linked(self.symbols(data[i]))
                continue
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                raw = np.frombuffer(b"".join([data[i] for i in some]), np.uint8).reshape(len(some), size)
                ids = self.inner_ids[raw]
                ids[:, -1] = self.final_ids[raw[:, -1]]
                self._scan(ids, np.array(some), parts)
        return parts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def _scan(self, ids: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Merge words of one length; ``ids`` has a row per word and ``out`` gets the results."""
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                live = np.zeros(len(rows), bool)
            else:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                live = best < NONE
            if not live.all():
                for i, done in zip(rows[~live].tolist(), ids[~live].tolist()):
                    out[i] = done
                if not live.any():
                    return
                ids, ranks, rows, at, best = ids[live], ranks[live], rows[live], at[live], best[live]
            n, size = ids.shape
            every = np.arange(n)
            ids[every, at] = self.made_ids[best]
            stay = np.ones((n, size), bool)
            stay[every, at + 1] = False
            ids = ids[stay].reshape(n, size - 1)
            stay = np.ones((n, size - 1), bool)
            stay[every, at] = False
            ranks = ranks[stay].reshape(n, size - 2)
            has = at < size - 2
            ranks[every[has], at[has]] = self._ranks(ids[every[has], at[has]], ids[every[has], at[has] + 1])
            has = at > 0
            ranks[every[has], at[has] - 1] = self._ranks(ids[every[has], at[has] - 1], ids[every[has], at[has]])

    def _linked(self, parts: list[int]) -> list[int]:
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(size - 1) if (m := self.merges.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * size
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= size or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[j] < size:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < size and (m := self.merges.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (m, a, parts[a], parts[b]))
        return [p for p, live in zip(parts, alive) if live]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null counts as empty. Special strings in it become their tokens."""
        return [int(x) for x in self.digits([text])[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids, special tokens included: the vocabulary has no decoder, so tokens are joined by spaces."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def digits(self, texts: list[str | None]) -> list[str]:
        """``encode`` of each text as decimal ids joined by spaces; pieces met before are looked up."""
        split = [self._pieces_of(t or "") for t in texts]
        new = list({w for words in split for w in words}.difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list({w for words in split for w in words})
        for word, ids in zip(new, self.encode_words(new)):
            self.known[word] = " ".join(map(str, ids))
        find = self.known.__getitem__
        out = [" ".join(map(find, words)) for words in split]
        for i, t in enumerate(texts):
            if t and self.specials.search(t):
                out[i] = " ".join(str(self.special[w]) if special else find(w) for special, w in self.words(t))
        return out

    def _pieces_of(self, text: str) -> list[str]:
        if self.specials.search(text):
            return [w for special, w in self.words(text) if not special]
        return self.pieces(self.normalise(text))


def _latin(pattern: str) -> str:
    """The pattern for texts of Latin-1 letters, with its classes spelled out."""
    letters = list(map(chr, range(256)))
    classes = {name: "".join(map(re.escape, regex.findall(name, "".join(letters)))) for name in (r"\p{L}", r"\p{N}", r"\s")}
    for name, listed in classes.items():
        pattern = pattern.replace(name, listed)
    return pattern.replace("[[", "[").replace("]]", "]")


def _as_library(pattern: str) -> str:
    """The pattern with the letters and numbers of the vocabulary's library, which follows an older Unicode
    than the pattern's engine here: code points that only the engine takes for either count as neither."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    points = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", points) if unicodedata.category(c) == "Cn"]
    odd = [
        c for c in new
        if len(split.pre_tokenize_str(f"a{c}b")) > 1 and len(split.pre_tokenize_str(f"{c}!")) == 1
    ]
    if not odd:
        return pattern
    listed = "".join(f"{regex.escape(a)}-{regex.escape(b)}" for a, b in _ranges(odd))
    for name in ("[\\p{L}]", "[\\p{N}]"):
        pattern = pattern.replace(name, f"(?:(?![{listed}]){name})")
    return pattern.replace("[^\\s\\p{L}\\p{N}]", f"(?:[{listed}]|[^\\s\\p{{L}}\\p{{N}}])")


def _ranges(letters: list[str]) -> Iterator[tuple[str, str]]:
    first = last = None
    for c in letters:
        if last is None or ord(c) != ord(last) + 1:
            if last is not None:
                yield first, last
            first = c
        last = c
    if last is not None:
        yield first, last


OUT = "doc_id long, n_tokens long, ids string, decoded string"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Each document's ids (decimal, joined by spaces) and the text decoded from them.

    One row per row; a null text counts as empty and gives no tokens. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = bpe.digits(part.column(1).to_pylist())
                split = [x.split(" ") if x else [] for x in ids]
                decoded = [bpe.decode(list(map(int, x))) for x in split]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in split], pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, made where the document lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        names = {str(i): t for i, t in bpe.names.items()}
        for batch in batches:
            counts, first, second = [], [], []
            for start in range(0, batch.num_rows, 256):
                for ids in bpe.digits(batch.column(1).slice(start, 256).to_pylist()):
                    split = ids.split(" ") if ids else []
                    counts.append(len(split))
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(" ".join(map(names.__getitem__, split)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
