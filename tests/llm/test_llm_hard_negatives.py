from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalflow.llm import hard_negatives
from fiscalflow.llm.hard_negatives import Block

SCHEMA = "vec_id long, embedding array<double>, label int, id string, place int, score string, unit string, vec string"


@pytest.fixture(scope="module")
def make_vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, x, "i", 1, "s", "u", "v") for i, v, x in rows], SCHEMA)


def plain_mine(rows, is_anchor, n_pos=5, n_neg=10):
    """rows: (id, vector, label)."""
    fine = [(i, v, x) for i, v, x in rows if i is not None and x is not None and v and None not in v and all(map(math.isfinite, v))]
    fine = [(i, [math.floor(256 * c) for c in v], x) for i, v, x in fine]
    sizes = [len(v) for _, v, _ in fine]
    fine = [r for r in fine if len(r[1]) == max(sorted(set(sizes), reverse=True), key=sizes.count)]
    out = []
    for a in sorted({i for i, _, _ in fine if is_anchor(i)}):
        _, x, va = min((i, x, np.array(v, "<i8").tobytes()) for i, v, x in fine if i == a)
        va = np.frombuffer(va, "<i8").tolist()
        scored = [(-sum(p * q for p, q in zip(va, v)), i, y) for i, v, y in fine if i != a]
        for less, p, _ in sorted(s for s in scored if s[2] == x)[:n_pos]:
            score = -less
            found = sorted((s, i) for s, i, y in scored if y != x and 30 * score <= -100 * s and -100 * s <= 90 * score)
            out += [(a, p, rank, i, score, -s) for rank, (s, i) in enumerate(found[:n_neg], 1)]
    return sorted(out)


def got(found):
    return sorted(tuple(r) for r in found.collect())


def random_rows(n, dims=16, labels=4, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    return [(i, (centres[rng.integers(labels)] + rng.normal(size=dims)).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 5, 16, 64])
def test_equals_brute_force(make_vectors, dims):
    rows = random_rows(400, dims, seed=dims)
    found = got(hard_negatives.mine(make_vectors(rows).repartition(3), F.col("vec_id") % 20 == 0, F.col("label")))
    assert found == plain_mine(rows, lambda i: i % 20 == 0) and found


def test_units_of_several_blocks(make_vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "PAIRS", 50)
    rows = random_rows(500)
    found = got(hard_negatives.mine(make_vectors(rows), F.col("vec_id") % 20 == 0, F.col("label"), 3, 4))
    assert found == plain_mine(rows, lambda i: i % 20 == 0, 3, 4) and found


def test_odd_rows_ties_and_repeats(make_vectors):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, [0.5, 0.25], 2), (4, [0.5, 0.25], 2), (5, [0.5, 0.25], 2)]
    rows += [(6, None, 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (9, [inf, 1.0], 2), (10, [0.4, 0.4], None), (None, [1.0, 1.0], 1)]
    rows += [(11, [1.0, 2.0, 3.0], 1), (12, [], 2), (0, [1.0, 0.5], 1), (0, [0.25, 0.25], 2), (13, [0.0, 0.0], 1), (3, [0.6, 0.25], 2)]
    rows += [(14, [-1.0, -2.0], 2), (20, [-1.0, 0.5], 3), (21, [1.0, -0.5], 3)]
    found = got(hard_negatives.mine(make_vectors(rows), F.col("vec_id") % 10 == 0, F.col("label")))
    assert found == plain_mine(rows, lambda i: i % 10 == 0)
    assert {r[0] for r in found} == {0} and [r[3] for r in found if r[1] == 1][:3] == [21, 3, 3]


def test_long_vectors_stay_exact(make_vectors):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(2**19), 2**19, 4) * 2.0**k + 0.001).tolist(), i % 3) for i in range(90) for k in [0 if i % 2 else 1]]
    found = got(hard_negatives.mine(make_vectors(rows), F.col("vec_id") % 10 == 0, F.col("label")))
    assert found == plain_mine(rows, lambda i: i % 10 == 0) and max(r[4] for r in found) > 2**53


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(1)
    a, r = (Block(np.arange(n), np.zeros(n), np.floor(256 * rng.normal(size=(n, 24)))) for n in (9, 40))
    scores = a.vectors @ r.vectors.T
    widths = []
    for segments in (1, 2, 5, 24, 99):
        low, high = hard_negatives.bounds(a, r, segments, np.arange(9), None)
        assert (low <= scores).all() and (scores <= high).all()
        x, y = np.nonzero(scores > 0)
        some = hard_negatives.bounds(a, r, segments, x, y)
        assert np.allclose(some[0], low[x, y]) and np.allclose(some[1], high[x, y])
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True) and widths[-1] < 1


def test_bounds_spare_exact_scores(monkeypatch):
    """On vectors with structure most pairs end before they are scored."""
    rng = np.random.default_rng(2)
    base = np.repeat(rng.normal(size=(600, 8)), 8, axis=1) + 0.05 * rng.normal(size=(600, 64))
    rows = Block(np.arange(600), rng.integers(0, 3, 600), np.floor(256 * base))
    asked = Block(rows.ids[:20], rows.labels[:20], rows.vectors[:20])
    scored = []
    plain = hard_negatives.exact
    monkeypatch.setattr(hard_negatives, "exact", lambda a, r, x, y: scored.append(len(x)) or plain(a, r, x, y))
    list(hard_negatives.positives_of(asked, rows, 5))
    assert 0 < sum(scored) < 0.2 * 20 * 600 / 3


def test_a_third_of_all_rows_equal(make_vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    rows = random_rows(300) + [(1000 + i, [0.5] * 16, 1 + i % 2) for i in range(150)] + [(1001, [0.5] * 16, 2)] * 40
    found = got(hard_negatives.mine(make_vectors(rows), F.col("vec_id") % 100 == 0, F.col("label")))
    assert found == plain_mine(rows, lambda i: i % 100 == 0)


def test_empty(make_vectors):
    vectors = make_vectors([(0, [1.0], 1), (1, [2.0], 1), (2, [0.5], 2)])
    mine = hard_negatives.mine
    assert mine(vectors.limit(0), F.lit(True), F.col("label")).count() == 0
    assert mine(vectors, F.col("vec_id") > 5, F.col("label")).count() == 0
    assert mine(vectors.filter("label = 1"), F.lit(True), F.col("label")).count() == 0
    assert got(mine(vectors, F.col("vec_id") == 0, F.col("label"))) == []
    assert got(mine(vectors, F.col("vec_id") == 1, F.col("label"))) == [(1, 0, 1, 2, 131072, 65536)]
