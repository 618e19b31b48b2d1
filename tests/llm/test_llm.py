"""The pipeline operators against brute force, exact round trips, and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeloom.llm import components as components_module
from treeloom.llm import bpe, extract, fingerprints, jaccard, mixing, neighbours, quality, queries, suffixes, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, did string, row string, score string, kept string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))


def documents(spark, rows):
    """Documents (id, text, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def odd(spark):
    base = "The quick brown fox jumps over the lazy dog and runs far away into the deep green forest tonight. "
    return documents(spark, [
        (1, base * 3 + "one two three", "a"), (2, base * 3 + "one two three", "a"), (3, (base * 3).upper(), "b"), (4, None, "b"), (5, "", None),
        (6, "short", None), (7, LONG, "c"), (7, LONG, "c"), (8, "é" * 60 + " " + base, "c"), (9, "x é" * 40, "d"), (None, base + "null id", "d"),
        (None, None, None), (10, "\n\t ", "a"), (11, "<|endoftext|> İΣ 각 don't", "b"),
    ])


def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# ---- mixing


def seats_by_hand(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if votes[i] > 0), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_sainte_lague_is_highest_quotients(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(12):
        votes = [float(v) for v in rng.integers(0, 50 if g % 2 else 5000, rng.integers(1, 30))]
        seats = int(rng.integers(0, 400))
        if not any(votes):
            seats = 0
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
        want |= {(g, i): n for i, n in enumerate(seats_by_hand(votes, seats))}
    df = spark.createDataFrame(rows, "g int, i int, v double, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.sainte_lague(df, ["g"], ["i"], "v", "seats").collect()}
    assert got == want


def targets_by_hand(sizes, weights):
    total, goal, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in open_:
                goal[i] = left * weights[i] / w
            return goal
        for i in over:
            goal[i] = 3.0 * sizes[i]
            left -= 3 * sizes[i]
            open_.discard(i)
    return goal


@pytest.mark.parametrize("which", ["odd", "small"])
def test_mix_meets_targets(spark, sf_dir, which):
    docs = odd(spark) if which == "odd" else small(spark, sf_dir)
    got = rows_of(mixing.mix_sources(docs))
    assert len(got) == docs.count()
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix_sources(docs.repartition(5)))))
    names = sorted({r["source"] for r in got}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in names]
    goal = targets_by_hand(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for name, size, want in zip(names, sizes, goal):
        mine = [r for r in got if r["source"] == name]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(want) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want) <= 64
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    words = sorted((str(i), len(WORD.findall(t or ""))) for i, t in texts_of(docs))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == words


def test_rows_without_an_id_are_dealt_over_shards(spark):
    """Runs begin at a place per shard, so rows in many shards are taken all over the source."""
    docs = documents(spark, [(None, f"{'word ' * 20}{i}", "a") for i in range(600)] + [(1, "w " * 30000, "b")])
    got = rows_of(mixing.mix_sources(docs, shard_docs=4))
    mine = [r["taken"] for r in got if r["source"] == "a"]
    # Shards of four short rows: the last block of a shard is short, which takes some words off each.
    assert sum(mine) == pytest.approx(next(r["target"] for r in got if r["source"] == "a"), rel=0.1)
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix_sources(docs.repartition(5), shard_docs=4))))
    shards = mixing._mixed(docs, shard_docs=4).filter("source = 'a'")
    assert shards.agg(F.max("_words")).first()[0] < 600  # of 12,600 words


def test_drawn_words_meet_targets_with_one_very_long_document(spark):
    """Sources whose words lie mostly in one text: below and above half of its words, and at several times."""
    rows = []
    for s in range(60):
        rows.append((1000 * s, "long " * 9000, f"s{s:02}"))
        rows += [(1000 * s + i, "short " * 20, f"s{s:02}") for i in range(1, 51)]
    docs = documents(spark, rows)
    taken = rows_of(mixing.mix_sources(docs, weights=(7, 3, 13)))
    drawn = rows_of(mixing.draw(docs, weights=(7, 3, 13)).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")))
    n = {r["source"]: r["n"] for r in drawn}
    goals = {r["source"]: r["target"] for r in taken}
    for k in range(3):  # targets of 0.91, 0.39 and 1.7 times the source
        some = [s for s in goals if int(s[1:]) % 3 == k]
        assert sum(n.get(s, 0) for s in some) == pytest.approx(sum(goals[s] for s in some), rel=0.3)
    assert all(abs(n.get(s, 0) - goal) <= 9000 + 200 for s, goal in goals.items())


# ---- quality


def test_quality_learns_held_out_labels(spark, sf_dir):
    def text(i):
        words = [f"w{(i * 7 + j * j) % 50}" for j in range(40)]
        return " ".join(words) if i % 3 else " | ".join(w.upper() + "!!" for w in words)

    docs = documents(spark, [(i, text(i), "a") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.classify(docs, labels))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [r["predicted"] == int(i % 3 > 0) for i, r in got.items() if r["held_out"]]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    again = by_id(quality.classify(docs.repartition(3), labels))
    assert all(again[i]["score"] == pytest.approx(r["score"], abs=1e-6) for i, r in got.items())


def test_word_vectors_equal_brute_force(spark, monkeypatch):
    """Sums of the neighbours' index vectors, by plain loops; a text longer than a piece included."""
    monkeypatch.setattr(quality, "PIECE", 7)
    texts = ["a b a c", "", None, "B b, b! x-1 x-1", "one two three " * 40, LONG[:3000]]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)])
    rows, got = quality.word_vectors(docs, vocabulary=20, dim=32)
    sequences = [quality.terms(t or "") for t in texts]
    counts = collections.Counter(t for s in sequences for t in s)
    assert list(rows) == sorted(counts, key=lambda t: (-counts[t], t))[:20]
    want = {t: np.zeros(32) for t in rows}
    for s in sequences:
        for i, term in enumerate(s):
            for j in range(max(0, i - quality.AROUND), min(len(s), i + quality.AROUND + 1)):
                if term in rows and j != i and s[j] in rows:
                    want[term] += quality.index_vector(s[j], 32)
    for term, row in rows.items():
        size = np.linalg.norm(want[term])
        assert np.allclose(got[row], want[term] / size if size else 0)


def test_score_equals_brute_force(spark):
    """Scores from the network's formula on mean vectors made term by term."""
    docs = documents(spark, [(i, f"good words {i} here" if i % 3 else "BAD !! BAD !!" * (i + 1), "a") for i in range(90)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    text_of = dict(texts_of(docs))
    for r in rows_of(quality.score(docs, model, ["doc_id"])):
        tokens = quality.TOKEN.findall(text_of[r["doc_id"]])
        row = lambda t: model.vectors[model.rows.get(t, 0)]
        x = np.concatenate([
            np.mean([row(t.lower()) for t in tokens], axis=0), np.mean([row(quality.form(t)) for t in tokens], axis=0),
            [sum(a == b for a, b in zip(tokens, tokens[1:])) / len(tokens)],
        ])
        logit = np.tanh((x - model.mean) / model.scale @ model.first + model.bias) @ model.second + model.offset
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit / model.temperature)), abs=1e-9)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("quality = 1"), labels.limit(0)):
        got = rows_of(quality.classify(odd(spark), some))
        assert len(got) == 14 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)


# ---- fingerprints


def test_fingerprint_is_a_multiset_hash():
    a, b, c = "one two three four", "five six seven", ""
    both = fingerprints.of_text(f"{a}\n{b}\n{c}")
    assert fingerprints.pack(both) == fingerprints.pack(fingerprints.of_text(f"{b}\n{c}\n{a}"))
    grown = fingerprints.plus(fingerprints.of_text(f"{a}\n{b}"), fingerprints.paragraph(c))
    assert fingerprints.pack(grown) == fingerprints.pack(both)
    assert fingerprints.pack(fingerprints.minus(both, fingerprints.paragraph(b))) == fingerprints.pack(fingerprints.of_text(f"{a}\n{c}"))
    assert fingerprints.pack(fingerprints.of_text(a)) != fingerprints.pack(fingerprints.of_text(f"{a}\n{a}"))
    assert fingerprints.unpack(fingerprints.pack(both))[0].tolist() == both[0].tolist()
    assert fingerprints.of_text(None)[0].tolist() == fingerprints.of_text("")[0].tolist()


@pytest.mark.parametrize("which", ["odd", "small"])
def test_edited_texts(spark, sf_dir, which):
    docs = (odd(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]) if which == "odd" else small(spark, sf_dir)).repartition(5)
    got = by_id(fingerprints.edits(docs))
    order = sorted(((i, t or "") for i, t in texts_of(docs)), reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprints.pack(fingerprints.of_text(t))
        assert got[i]["edited_fingerprint"] == fingerprints.pack(fingerprints.of_text(edited))
    assert len(got) == len(order)
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.2
    assert len(rows_of(fingerprints.edits(odd(spark)))) == 14


def test_counts_of_very_long_texts_do_not_wrap():
    texts = ["same " * 100_000, "same " * 50_000 + "other words come here " * 12_000, "same " * 50_000, "same " * 25_000]
    own = [fingerprints.of_text(t) for t in texts]
    assert np.abs(own[0][1]).max() == 99_998
    assert all(fingerprints.likeness(own[0], x) > 0.8 for x in own[1:])
    again = fingerprints.unpack(fingerprints.pack(own[0]))
    assert all(np.array_equal(x, y) for x, y in zip(own[0], again))
    assert fingerprints.pack(fingerprints.minus(fingerprints.plus(own[0], own[1]), own[1])) == fingerprints.pack(own[0])


# ---- WARC


def test_warc_round_trip_and_revisits(spark):
    rows = [(1, "u1", "same"), (2, "u2", "other é"), (3, None, "same"), (4, "u\r\n4", None), (5, "u5", ""), (None, "u", "same"), (6, "u6", "y" * 300_000), (6, "u6", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = rows_of(warc.round_trip(pages))
    assert not [r for r in got if r["problem"]] and len(got) == len(rows)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == sorted([
        ("urn:page:1", "revisit", "urn:page:3", 4), ("urn:page:2", "response", None, 8), ("urn:page:3", "response", None, 4), ("urn:page:4", "revisit", "urn:page:5", 0),
        ("urn:page:5", "response", None, 0), ("urn:page:", "revisit", "urn:page:3", 4), ("urn:page:6", "response", None, 300_000), ("urn:page:6", "response", None, 300_000),
    ])
    assert {r["payload_digest"] for r in got if r["payload_bytes"] == 4} == {warc.digest(b"same")}
    assert [bytes(r["payload"]) for r in got if r["record_id"] == "urn:page:2"] == ["other é".encode()]
    large = rows_of(warc.round_trip(pages, least_bytes=5))
    assert {r["record_type"] for r in large} == {"response"}


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_logs_gaps_and_recovers(packed):
    wrap = warc.member if packed else bytes
    parts = [wrap(warc.record(f"urn:page:{i}", "response", "u", f"payload {i} ".encode() * 50)) for i in range(6)]
    assert all(not p for _, _, p, _, _ in warc.salvage(b"".join(parts)))
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"".join([b"junk", *parts[:2], bytes(broken), parts[3], parts[4][: len(parts[4]) // 2], parts[5]])
    found = list(warc.salvage(data))
    kept = [h["warc-record-id"] for _, _, p, h, _ in found if p is None]
    assert kept == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    gaps = [(at, n) for at, n, p, _, _ in found if p]
    start = 4 + len(parts[0]) + len(parts[1])
    assert gaps == [(0, 4), (start, len(parts[2])), (start + len(parts[2]) + len(parts[3]), len(parts[4]) // 2)]
    assert sum(n for _, n, _, _, _ in found) == len(data)


# ---- BPE


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), bpe.WordBpe(path)
    hard = ["", "  ", "<|startoftext|>a<|endoftext|>B", "ab" * 3000 + "the" * 500, "Σς İ ½ १ 각 ՘ \U0001f600 don'T I'LL 1234 !!a_b", "\x85\xa0\x1cx", "é"]
    texts = hard + [t for _, t in texts_of(small(spark, sf_dir))][:60]
    for text, digits in zip(texts, mine.digits(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert digits == " ".join(map(str, ids))
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = rows_of(bpe.digests(odd(spark), path))
    full = rows_of(bpe.tokenised(odd(spark), path))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(
        (str(r["doc_id"]), r["n_tokens"], hashlib.sha256(r["ids"].encode()).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in full
    )
    assert len(got) == 14


# ---- near duplicates


def sets_by_hand(rows, width):
    out = {}
    for i, t in rows:
        words = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    return out


def components_by_hand(sets, percent):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_crossing_keeps_pairs_whose_sketches_differ_in_sign_bits():
    """Every pair of one short and one long list that differs in few bits, sign bits among them, leaves."""
    rng = np.random.default_rng(3)
    for size in (8, jaccard.SHORT_LIST + 40):
        base = rng.integers(-(1 << 63), (1 << 63) - 1, 8, np.int64)
        bits = np.tile(base, (size, 1))
        for row in range(size):
            bits[row, row % 8] ^= np.int64(-(1 << 63))
        ids = np.arange(size)
        zero = pa.array(np.zeros(size, np.int64))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, 7)), zero, zero, zero, pa.array(ids), pa.array(ids), pa.array(np.full(size, 100)), pa.array(list(bits), pa.list_(pa.int64()))],
            names=["token", "i", "j", "side", "sid", "comp", "n", "bits"],
        )
        got = lambda most=None: [(a, b) for out in jaccard._crossing(80, most)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns))]
        every = {(b, a) for a, b in combinations(range(size), 2)}
        assert set(got()) == every
        some = got(2)
        assert (7, None) in some and set(some) - {(7, None)} < every and len(some) <= 2 * size + 1


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, sf_dir, width, percent, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words, 30))
    rows, base = [], list(rng.choice(words, 120))
    for i in range(60):  # a chain of edits, a group of near copies, and one passage in many
        base[rng.integers(len(base))] = f"new{i}"
        rows.append((i, " ".join(base)))
    core = list(rng.choice(words, 150))
    for i in range(60, 130):
        copy = list(core)
        for _ in range(rng.integers(0, 8)):
            copy[rng.integers(len(copy))] = f"e{i}"
        rows.append((i, " ".join(copy)))
    for i in range(130, 200):
        rows.append((i, line + " " + " ".join(rng.choice(words, rng.integers(1, 60)))))
    rows += [(200, None), (201, ""), (202, "One two"), (203, "one TWO"), (204, "solo")]
    monkeypatch.setattr(jaccard, "COMMON", 8)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 20)  # long lists in blocks
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join_components(docs, width, percent))}
    want = components_by_hand(sets_by_hand(rows, width), percent)
    assert got == want
    kept = sorted(r["doc_id"] for r in rows_of(jaccard.keep_one(docs, width, percent)))
    assert kept == sorted(i for i, (n, c) in want.items() if n == 0 or i == c)


def test_near_duplicates_odd_rows(spark):
    got = rows_of(jaccard.join_components(odd(spark)))
    assert len(got) == 14
    found = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]}
    assert found[2] == 1 and found[3] == 1 or found[3] == 3
    kept = jaccard.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert [r["doc_id"] for r in rows_of(kept)].count(7) == 1


@pytest.mark.parametrize("common", [32, 2])
def test_near_duplicates_of_repeated_and_null_ids(spark, common, monkeypatch):
    """Rows that share an id, or have none, count with their own texts."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    line = list(rng.choice(words, 40))
    rows = []
    for i in range(40):
        text = line * (i % 2) + list(rng.choice(words, 60))
        near = list(text)
        near[int(rng.integers(len(near)))] = f"e{i}"
        # The first of each pair has an id that others have too, the second one of its own or none.
        rows += [([None, 7, 8][i % 3], " ".join(text)), (100 + i if i % 4 else None, " ".join(near))]
    monkeypatch.setattr(jaccard, "COMMON", common)
    sets = sets_by_hand(enumerate(t for _, t in rows), 3)
    got = rows_of(jaccard.join_components(documents(spark, [(i, t, "a") for i, t in rows]), 3, 80))
    groups = {}
    for place, (n, top) in components_by_hand(sets, 80).items():
        groups.setdefault(top, []).append((rows[place][0], n))
    want = []
    for group in groups.values():
        least = min((i for i, _ in group if i is not None), default=None)
        want += [(i, n, least) for i, n in group]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    kept = [r["doc_id"] for r in rows_of(jaccard.keep_one(documents(spark, [(i, t, "a") for i, t in rows]), 3, 80))]
    assert sorted(map(str, kept)) == sorted(str(min((i for i, _ in g if i is not None), default=None)) for g in groups.values())


# ---- token counts


def test_token_counts_and_cache(spark, sf_dir):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = tokens.new_cache(spark)
    docs = odd(spark)
    got = rows_of(tokens.count_tokens(docs, path, cache, limit=100))
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in texts_of(docs)]
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got))) == sorted(map(str, want))
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    stored = tokens.cached(spark, cache).count()
    assert stored == len({t or "" for _, t in texts_of(docs)})
    more = docs.unionByName(documents(spark, [(50, "a new text", "a"), (51, "short", "a")]))
    assert len(rows_of(tokens.count_tokens(more, path, cache))) == 16
    assert tokens.cached(spark, cache).count() == stored + 1


# ---- HTML


def test_main_text_without_frame():
    body = " ".join(f"<p>Paragraph {i} has &amp; some <b>bold</b> words,\n and\tmore of them to read.</p>" for i in range(5))
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>"
        f"<div class='cookie-notice'>{'We use cookies on this site. ' * 9}</div><article><h1>Head</h1>{body}<p>End.</p></article>"
        f"<aside>{'aside text ' * 20}</aside><div id='comments'><p>{'I think so too. ' * 20}</p></div><form>{'field ' * 30}</form><script>var a='<p>x</p>'</script><footer>&copy; us</footer></body></html>"
    )
    want = "\n".join(["Head", *(f"Paragraph {i} has & some bold words, and more of them to read." for i in range(5)), "End."])
    assert extract.main_text(page) == want
    assert extract.main_text(page.replace("article>", "div>")) == want
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>a</nav>") == ""


def test_pages_equal_their_articles(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = by_id(extract.extract(pages), "page_id")
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id]["text"] == want and got[r.page_id]["n_chars"] == len(want)
    odd_pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in rows_of(extract.extract(odd_pages))) == ["", "", "deep"]


def test_region_that_holds_most_of_the_content():
    story = [f"Paragraph {i} of the story tells a good deal of what has happened in the town." for i in range(8)]
    body = "".join(f"<p>{x}</p>" for x in story)
    whole, teaser = "\n".join(story), "<article><p>A teaser of one line that passes the threshold, too.</p></article>"
    more = f"<section class='latest'>{teaser * 3}</section>"
    assert extract.main_text(f"<body><div>{body}</div>{more}</body>") == whole
    assert extract.main_text(f"<body>{more}<div>{body}</div></body>") == whole
    assert extract.main_text(f"<body><main><div>{body}</div>{more}</main></body>") == whole
    assert extract.main_text(f"<body><article>{body}</article>{more}</body>") == whole
    assert extract.main_text(f"<body><main><h1>Head</h1><article>{body}</article>{more}</main></body>") == "Head\n" + whole
    # Many teasers do not hide the story, an article in the midst of it stays, and articles of a kind all stay.
    assert whole in extract.main_text(f"<body><div>{body}</div>{more * 9}</body>")
    assert extract.main_text(f"<body><div>{body}{teaser}{body}</div></body>").count("teaser") == 1
    assert extract.main_text(f"<body>{more}</body>").count("teaser") == 3
    comments = f"<div>{'<article class=%s><p>I think that this is quite another matter than you say it is.</p></article>' * 9}</div>"
    for name in ("comment", "'post user-comment'", "sponsored"):
        assert extract.main_text(f"<body><article>{body}</article>{comments.replace('%s', name)}</body>") == whole
    assert extract.main_text(f"<body><article class='post tag-social has-comments'>{body}</article></body>") == whole
    assert extract.main_text("<main>" * 5000 + "<article>" * 5000 + "<p>deep") == "deep"


HEAD = "<h1>Head line</h1>"
STORY = "".join(f"<p>{'story words go on here ' * 12}{i}</p>" for i in range(6))
MENU, FOOT = "<nav><a>Home</a><a>About us</a></nav>", "<footer>Copyright all rights</footer>"


@pytest.mark.parametrize(
    "page",
    [
        "%m<div class='single has-comments'>%s</div>%f", "%m<div class='comments-open'>%s</div>%f",
        "%m<div class='layout with-sidebar'>%s</div>%f", "%m<div class='layout with-sidebar'><article>%s</article></div>%f",
        "%m<div id='sidebar-wrapper'>%s</div>%f", "<form>%m<div>%s</div>%f</form>", "<form>%m<article>%s</article>%f</form>",
        "<nav><a>Home</a><a>About</a><article>%s</article>%f", "%m<div class='article-header'>%h</div><div>%p</div>%f",
        "%m<div>%s</div><aside><article><p>teaser of another story</p></article></aside>%f",
        "%m<div>%s</div><div id='comments'><article><p>%r</p></article></div>%f",
        "%m<div>%p</div><div id='comments'><article><p>%r</p></article></div>%f",
        "%m<article>%s</article><div class='comments'><article><p>%r</p></article></div>%f",
    ],
)
@pytest.mark.parametrize("body", ["<body>", "<body aria-hidden='true'>"])
def test_wrappers_do_not_hide_the_story(page, body):
    """A name, a form or a menu around the whole text is no frame; comments, however long, stay out."""
    parts = {"%s": HEAD + STORY, "%p": STORY, "%h": HEAD, "%m": MENU, "%f": FOOT, "%r": "a reader says a lot " * 300}
    for mark, part in parts.items():
        page = page.replace(mark, part)
    story = "\n".join(f"{'story words go on here ' * 12}{i}" for i in range(6))
    assert extract.main_text(body + page + "</body>") == ("Head line\n" if HEAD in page else "") + story


def test_frames_in_frames_take_linear_time():
    assert extract.main_text("<form>" * 20000 + "<h1>" * 20000 + "deep") == "deep"


# ---- nearest neighbours


def nearest_by_hand(rows, k=10, every=100):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % every == 0:
            far = np.sqrt(((vectors - np.array(v)) ** 2).sum(axis=1))
            best = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(far[j])) for j in best]
    return out


def test_nearest_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = nearest_by_hand([(r.vec_id, r.embedding) for r in table.collect()])
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    recall = [len({v for v, _ in got[q].values()} & {v for v, _ in best}) / len(best) for q, best in want.items()]
    assert np.mean(recall) >= 0.9
    assert all(sorted(x) == list(range(1, 11)) for x in got.values())


def test_nearest_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 40)] + [(i, rng.standard_normal(3).tolist()) for i in range(40, 201)]
    bad = [(300, None), (400, []), (500, [0.0, 0.0, 0.0]), (600, [float("nan"), 1.0, 1.0]), (700, [float("inf"), 1.0, 1.0]), (800, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + bad + rows[:3]], "vec_id long, embedding array<double>, label int, v string")
    got = {}
    for r in neighbours.nearest(table, success=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = nearest_by_hand(rows)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [(v, pytest.approx(s)) for _, v, s in sorted(got[q])] == best
    assert rows_of(neighbours.nearest(table.filter("vec_id >= 300"))) == []
    assert rows_of(neighbours.nearest(table.limit(0))) == []


# ---- suffix arrays


def repeats_by_hand(rows):
    first, out = {}, []
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    key = lambda i: (i is None, i or 0)
    for i, t in ordered:
        data = (t or "").encode()
        for s in range(len(data) - 49):
            first.setdefault(data[s : s + 50], key(i))
    for i, t in ordered:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - 49):
            if first[data[s : s + 50]] < key(i):
                gone[s : s + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((str(i), len(data), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(data) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeats(docs, **more):
    done = suffixes.dedup(docs, ["doc_id"], **more).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.h) for r in done.collect())


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 300):
        text = rng.integers(97, 99, n).astype(np.uint8)
        data = text.tobytes()
        order = suffixes.suffix_array(text, 1 << 20)
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
        for depth in (8, 1 << 20):
            order = suffixes.suffix_array(text, depth)
            for k, length in enumerate(suffixes.common_prefixes(text, order)[1:], 1):
                a, b = data[order[k - 1] :], data[order[k] :]
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert length == same


@pytest.mark.parametrize("which", ["odd", "small"])
def test_repeats_equal_brute_force(spark, sf_dir, which):
    docs = odd(spark) if which == "odd" else small(spark, sf_dir)
    want = repeats_by_hand(texts_of(docs))
    assert repeats(docs) == want
    # The same with shards so small that all shared anchors are split over several.
    assert repeats(docs, shard_rows=2) == want


# ---- empty tables and the pipeline


def test_empty_tables(spark):
    docs = odd(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = queries.tokenizer("word_bpe_49k.json")
    assert rows_of(mixing.mix_sources(docs)) == []
    assert rows_of(quality.classify(docs, labels)) == []
    assert rows_of(fingerprints.edits(docs)) == []
    assert rows_of(bpe.digests(docs, path)) == []
    assert rows_of(jaccard.join_components(docs)) == []
    assert rows_of(tokens.count_tokens(docs, queries.tokenizer("piece_bpe_32k.model"), tokens.new_cache(spark))) == []
    assert rows_of(suffixes.dedup(docs, ["doc_id"])) == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows_of(warc.round_trip(pages)) == [] and rows_of(extract.extract(pages)) == []


def test_pipeline_stages_on_odd_rows(spark, sf_dir, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for some in (odd(spark), odd(spark).limit(0)):
        docs = some
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == some.columns, name
                out = spark.createDataFrame(out.collect(), some.schema)
            docs = out
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Each stage on what the stage before it kept, at the smallest scale."""
    docs = small(spark, sf_dir)
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = spark.createDataFrame(stages[0](spark, docs, sf_dir).collect(), docs.schema)
    scores = by_id(quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert sorted(i for i, _ in texts_of(good)) == sorted(i for i, r in scores.items() if r["predicted"])
    one = spark.createDataFrame(stages[1](spark, good, sf_dir).collect(), docs.schema)
    want = components_by_hand(sets_by_hand(texts_of(good), 5), 80)
    assert sorted(i for i, _ in texts_of(one)) == sorted(i for i, (n, c) in want.items() if n == 0 or i == c)
    cut = spark.createDataFrame(stages[2](spark, one, sf_dir).collect(), docs.schema)
    # A cut may fall into a character of up to four bytes, at either end of a span.
    left = {i: (n - gone - 6 * spans, n - gone) for i, n, gone, spans, _ in repeats_by_hand(texts_of(one))}
    assert all(left[str(i)][0] <= len(t.encode()) <= left[str(i)][1] for i, t in texts_of(cut))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = stages[3](spark, cut, sf_dir)
    taken = by_id(mixing.mix_sources(cut))
    got = [i for i, _ in texts_of(mixed)]
    assert all(abs(got.count(i) - r["taken"] / r["size"]) <= 0.5 for i, r in taken.items() if r["size"])
    assert mixed.count() == stages[4](spark, mixed, sf_dir).count()


@pytest.mark.parametrize("few", [0, 1000])
def test_components_by_either_way(spark, monkeypatch, few):
    """Few edges take one job and one task, more take rounds; both give each node's smallest reachable one."""
    rng = random.Random(few)
    edges = [(rng.randint(-9, 300), rng.randint(-9, 300)) for _ in range(170)] + [(2**62, -(2**62)), (5, 5)] + [(i, i + 1) for i in range(400, 500)]
    above = {}
    top = lambda x: x if above.setdefault(x, x) == x else top(above[x])
    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            above[high] = low
    written = []
    monkeypatch.setattr(components_module, "FEW", few)
    monkeypatch.setattr(components_module, "settle_counted", lambda *a, f=components_module.settle_counted: (written.append(1), f(*a))[1])
    got = components_module.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in above)
    assert len(written) == 1 if few else len(written) > 2
    assert components_module.components(spark.createDataFrame([], "a long, b long")).collect() == []
