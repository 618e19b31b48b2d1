"""Packing: whole pieces, gapless sequences, and few of them."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_llm import documents, odd, rows_of, small
from treeloom.llm import packing
from treeloom.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def laid_out(plan, lengths, counts):
    """Every piece of a histogram at its place; sequences must be gapless and within the capacity."""
    at = defaultdict(list)
    for length, count in zip(lengths, counts):
        sequence, offset = plan.find(np.full(count, length), np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            at[s].append((o, int(length)))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= plan.capacity
    assert set(at) == set(range(plan.sequences))
    return len(at)


def first_fit_decreasing(lengths, counts, capacity):
    room = []
    for length in sorted(np.repeat(lengths, counts).tolist(), reverse=True):
        for i, gap in enumerate(room):
            if gap >= length:
                room[i] -= length
                break
        else:
            room.append(capacity - length)
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=80), st.integers(1, 8))
def test_plans_hold_every_piece(capacity, sizes, groups):
    lengths, counts = np.unique([min(s, capacity) for s in sizes] or np.zeros(0, int), return_counts=True)
    plan = packing.plan(lengths.astype(np.int64), counts, capacity, ((3, groups), (6, groups)))
    made = laid_out(plan, lengths, counts)
    assert made <= 1.5 * first_fit_decreasing(lengths, counts, capacity) + 1


@pytest.mark.parametrize("kind", ["mixed", "uniform", "middling", "halves", "few"])
def test_plans_need_few_sequences(kind):
    rng = np.random.default_rng(1)
    sizes = {
        "mixed": np.minimum(4096, rng.lognormal(6.3, 1.0, 8000).astype(int) + 1), "uniform": rng.integers(1, 4097, 4000),
        "middling": rng.integers(600, 2500, 4000), "halves": np.full(500, 2049), "few": np.array([4096, 1, 4095, 2048, 2048]),
    }[kind]
    lengths, counts = np.unique(sizes, return_counts=True)
    made = laid_out(packing.plan(lengths, counts), lengths, counts)
    least = max(math.ceil(sizes.sum() / 4096), int((sizes > 2048).sum()))
    assert made <= least * {"middling": 1.03}.get(kind, 1.015) + 1


def test_configurations_reach_the_fractional_optimum():
    """Sizes that fill sequences without waste; rounding down may leave one sequence of each configuration."""
    demand = np.array([100, 200, 100, 100, 100])
    found = packing.configurations(np.array([6, 4, 3, 2, 1]), demand.astype(float), 10)
    used = sum(times * counts for times, counts in found)
    assert (used <= demand).all() and all(counts @ [6, 4, 3, 2, 1] <= 10 for _, counts in found)
    assert 200 - len(demand) <= sum(times for times, _ in found) <= 200 and used @ [6, 4, 3, 2, 1] >= 10 * (200 - len(demand))


def pieces_by_hand(rows, capacity=4096):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            out.append((doc_id, n, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("which, capacity", [("odd", 4096), ("odd", 50), ("small", 4096)])
def test_pack_equals_the_library(spark, sf_dir, which, capacity):
    docs = odd(spark) if which == "odd" else small(spark, sf_dir)
    got = rows_of(packing.pack(docs.repartition(3), PATH, capacity))
    want = pieces_by_hand([(r.doc_id, r.text) for r in docs.collect()], capacity)
    assert sorted(map(repr, (tuple(r.values())[:5] for r in got))) == sorted(map(repr, want))
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        ends = np.cumsum([0] + [length for _, length in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= capacity
    assert len(at) <= math.ceil(sum(r["length"] for r in got) / capacity) * 1.1 + 1


def test_sequences_hold_the_ids(spark):
    docs = odd(spark)
    packed = packing.pack(docs, PATH, 64, ids=True)
    rows = rows_of(packed)
    whole = {r["sequence_id"]: r for r in rows_of(packing.sequences(packed))}
    for r in rows:
        ids = whole[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert bytes(ids) == bytes(r["ids"]) and zlib.crc32(bytes(ids)) == r["ids_crc32"]
    assert all(len(r["ids"]) == 4 * r["length"] <= 256 for r in whole.values())


def test_empty_table(spark):
    assert rows_of(packing.pack(documents(spark, []), PATH)) == []


def test_new_words_of_many_texts_go_side_by_side(monkeypatch):
    """Texts are encoded in parts of so many bytes, not of so many rows; a part's words of one length are merged together."""
    texts = [f"wort{i} {'x' * (i % 5)} <|endoftext|> É{i}" if i % 7 else None for i in range(900)]
    batch = pa.record_batch([pa.array(range(900)), pa.array(texts)], names=["doc_id", "text"])
    encoder, scans = packing.Ids(PATH), []
    monkeypatch.setattr(encoder.bpe, "_scan", lambda ids, rows, out, f=encoder.bpe._scan: (scans.append(ids.shape[1]), f(ids, rows, out))[1])
    parts = list(packing.slices(batch))
    got = [data for part in parts for data in encoder.encode(part.column(1).to_pylist())]
    library = tokenizers.Tokenizer.from_file(PATH)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(parts) == 1 and len(scans) == len(set(scans))
    assert [p.column(0).to_pylist() for p in packing.slices(pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["a" * 9, "b", None, "c" * 4])], names=["doc_id", "text"]), 5)] == [[1], [2, 3, 4]]
    assert list(packing.slices(batch.slice(0, 0))) == []
