"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tests.llm.test_llm import rows_of
from treeloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, uid string, v string, score string, cluster string"


def table(spark, rows):
    """(vec_id, label, vector) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def by_hand(rows, every=50, positives=5, count=3, low=50, high=95):
    usable = {
        (i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    lengths = [len(v) for *_, v in usable]
    common = min(set(lengths), key=lambda n: (-lengths.count(n), n), default=0)
    usable = [r for r in usable if len(r[2]) == common and common]
    out = []
    for i, c, v in usable:
        if i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, d, w in usable if j != i)
        for s, p, _ in [o for o in others if o[2] == c][:positives]:
            band = [(n, -t) for t, n, d in others if d != c and low * -s <= 100 * -t <= high * -s]
            out += [(i, p, rank, n, -s, t) for rank, (n, t) in enumerate(band[:count], 1)]
    return sorted(out)


def mixed(rng, n=400, size=6):
    """Clusters, ties, repeated rows, zero and null vectors, other lengths, values that are not finite."""
    centres = rng.standard_normal((7, size))
    rows = [(int(i), int(rng.integers(4)), (centres[i % 7] + 0.3 * rng.standard_normal(size)).round(1).tolist()) for i in range(n)]
    rows += rows[::20] + [(1000 + i, 1, rows[i][2]) for i in range(0, n, 40)]
    rows += [(2000, 1, [0.0] * size), (2050, 2, [0.0] * size), (2100, 1, None), (2150, None, [1.0] * size), (None, 1, [1.0] * size)]
    rows += [(2200, 1, [1.0, None] + [0.0] * (size - 2)), (2250, 1, [math.nan] * size), (2300, 1, [math.inf] * size), (2350, 1, [1.0] * (size + 1)), (2400, 1, [])]
    return rows


@pytest.mark.parametrize("settings", [{}, {"every": 3, "positives": 2, "negatives": 4, "low": 10, "high": 100, "clusters": 4}])
def test_equals_brute_force(spark, settings, monkeypatch):
    rows = mixed(np.random.default_rng(2))
    monkeypatch.setattr(negatives, "LIST_ROWS", 100)  # several parts a list, several blocks of members
    monkeypatch.setattr(negatives, "MEMBERS", 8)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    got = sorted(tuple(r.values()) for r in rows_of(negatives.mine(table(spark, rows).repartition(3), **settings)))
    want = by_hand(rows, **{{"negatives": "count"}.get(k, k): v for k, v in settings.items() if k != "clusters"})
    assert got == want and len(got) > 20


def test_scores_beyond_doubles_are_exact(spark):
    big = float(1 << 21)
    rows = [(0, 0, [big, 1 / 256]), (1, 0, [big, 3 / 256]), (2, 0, [big, 2 / 256]), (3, 1, [big * 0.75, 5 / 256]), (4, 1, [big * 0.75, 7 / 256])]
    assert sorted(tuple(r.values()) for r in rows_of(negatives.mine(table(spark, rows)))) == by_hand(rows)
    assert negatives.products(np.array([[2.0**40]]), np.array([[2.0**40]])).tolist() == [[(1 << 63) - 1]]


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(0, 1, [1.0, 2.0])], [(0, 1, [1.0]), (50, 1, [1.0])], [(0, 1, [0.0]), (1, 1, [0.0]), (2, 0, [0.0])]])
def test_small_tables(spark, rows):
    assert sorted(tuple(r.values()) for r in rows_of(negatives.mine(table(spark, rows)))) == by_hand(rows)


def test_bounds_hold_and_walks_end_early(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 16))
    rows = np.repeat(centres, 500, axis=0) + 0.05 * rng.standard_normal((4000, 16))
    lists = negatives.Lists(rows[::50], rows, 8, 256.0)
    whole = lists.whole(rows)
    angles = lists.angles(whole[::50])
    near = angles.argmin(axis=1)
    lists.cut({c: float(angles[near == c, c].max()) for c in set(near.tolist())}, (0.1,))
    bound, size = lists.bounds(whole), np.linalg.norm(whole[::50], axis=1)
    assert all((size[i] * bound[:, near[i]] >= whole @ whole[50 * i]).all() for i in range(len(near)))
    seen, real = [], negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: seen.append(len(b)) or real(a, b))
    part = pd.DataFrame({"uid": np.arange(4000), "vec_id": np.arange(4000), "label": 1, "v": list(rows), "bound": bound[:, near[0]]})
    ask = pd.DataFrame({"uid": [0], "slot": [0], "vec_id": [0], "label": [1], "v": [rows[0]], "size": [size[0]], "lo": [-negatives.FAR], "hi": [negatives.FAR], "worst": [-negatives.FAR]})
    got = negatives._walk(lists, True, 5)(None, part, ask)
    scores = whole @ whole[0]
    assert got["found"].tolist() == [i for i in np.lexsort((np.arange(4000), -scores)).tolist() if i][:5]
    assert sum(seen) < 2000
