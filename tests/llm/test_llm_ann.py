from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalflow.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id string, leaf int, score string"


@pytest.fixture(scope="module")
def make_vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0, "i", 1, "s") for i, v in rows], SCHEMA)


def plain_search(rows, query_ids, k):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and len(v)]
    usable = [(i, v) for i, v in usable if np.isfinite(v).all() and v.any()]
    sizes = [len(v) for _, v in usable]
    size = max(sorted(set(sizes), reverse=True), key=sizes.count) if sizes else 0
    usable = [(i, v) for i, v in usable if len(v) == size]
    out = {}
    for q in query_ids:
        own = [v for i, v in usable if i == q]
        if own:
            near = sorted((float(np.sqrt(((v - own[0]) ** 2).sum())), i) for i, v in usable if i != q)
            out[q] = near[:k]
    return out


def got(found):
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def clustered(n, seed=0, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    return [(i, (centres[i % 12] + rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_and_scores(make_vectors):
    rows = clustered(3000)
    found = got(ann.search(make_vectors(rows).repartition(5), F.col("vec_id") % 50 == 0))
    want = plain_search(rows, range(0, 3000, 50), 10)
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    hits = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = {i: np.array(v) for i, v in rows}
    for q, near in found.items():
        assert near == sorted(near)
        assert all(s == pytest.approx(np.sqrt(((exact[i] - exact[q]) ** 2).sum()), abs=1e-12) for s, i in near)


def test_fewer_leaves_are_visited_than_there_are(make_vectors):
    rows = clustered(3000)
    tree = ann.fit_tree(np.array([v for _, v in rows], float))
    order = list(tree.visits(np.array(rows[0][1], float)))
    assert sorted(order) == list(range(tree.n_leaves)) and tree.n_leaves > 20
    assert order[0] == tree.assign(np.array([rows[0][1]], float))[0] or order.index(tree.assign(np.array([rows[0][1]], float))[0]) < 5


def test_recall_and_visits_on_other_queries_than_calibrated(spark, monkeypatch):
    """On a given table: half of the queries calibrate, recall and the share of leaves
    visited are measured on the other half."""
    rows = ann.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    sample = rows.orderBy("id").collect()
    ids, vectors = np.array([r["id"] for r in sample]), np.stack([np.frombuffer(r["vec"], "<f8") for r in sample])
    tree = ann.fit_tree(vectors)
    leaf = tree.assign(vectors)
    places = {}
    for at in range(0, len(ids), 10):
        gaps = ((vectors - vectors[at]) ** 2).sum(axis=1)
        gaps[at] = np.inf
        order = {x: n for n, x in enumerate(tree.visits(vectors[at]))}
        places[at] = [order[x] for x in leaf[np.argsort(gaps)[:10]].tolist()]
    calibrating = sorted(p for at, some in places.items() if at % 20 == 0 for p in some)
    visits = calibrating[int(np.ceil(ann.TARGET_RECALL * len(calibrating))) - 1] + 1
    others = np.array([p for at, some in places.items() if at % 20 for p in some])
    assert (others < visits).mean() >= 0.9
    assert visits < 0.75 * tree.n_leaves


def test_calibrated_visits_are_the_fewest(make_vectors):
    rows = ann.usable(make_vectors(clustered(2000, 3)))
    sample = rows.orderBy("id").collect()
    tree = ann.fit_tree(np.stack([np.frombuffer(r["vec"], "<f8") for r in sample]))
    leaf = tree.assign(np.stack([np.frombuffer(r["vec"], "<f8") for r in sample])).tolist()
    index = rows.sparkSession.createDataFrame([(x, r["id"], r["vec"]) for x, r in zip(leaf, sample)], "leaf long, id long, vec binary")
    queries = index.filter("id % 40 = 0").select("id", "vec")
    few, many = (ann.calibrated_visits(tree, index, queries, 10, t) for t in (0.5, 1.0))
    assert 1 <= few < many <= tree.n_leaves


def test_a_repeated_row_is_one_point_of_the_sample(make_vectors):
    rows = [(7, [1.0, 2.0])] * 3000 + [(i, [float(i % 13), float(i % 7)]) for i in range(100, 160)]
    found = got(ann.search(make_vectors(rows), F.col("vec_id") == 101, sample_rows=100))
    assert [i for _, i in found[101]] == [i for _, i in plain_search(rows, [101], 10)[101]]


def test_odd_vectors_and_ties(make_vectors):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    rows += [(8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [0.5, 0.5]), (11, [])]
    found = got(ann.search(make_vectors(rows), F.col("vec_id") % 2 == 0))
    assert found == plain_search(rows, [0, 2, 4, 6, 8, 10], 10)
    assert [i for _, i in found[0]] == [1, 2, 10, 8, 8]


def test_none_and_one(make_vectors):
    vectors = make_vectors([(0, [1.0]), (1, [2.0])])
    assert ann.search(vectors.limit(0), F.lit(True)).count() == 0
    assert ann.search(vectors, F.col("vec_id") > 5).count() == 0
    assert ann.search(vectors.filter("vec_id = 0"), F.lit(True)).count() == 0
    assert got(ann.search(vectors, F.lit(True))) == {0: [(1.0, 1)], 1: [(1.0, 0)]}


def test_a_third_of_all_rows_equal(make_vectors, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET", 64)  # the hot leaf is dealt over buckets
    rows = clustered(900) + [(1000 + i, [0.25] * 16) for i in range(450)]
    found = got(ann.search(make_vectors(rows), F.col("vec_id") % 100 == 0))
    want = plain_search(rows, [q for q, _ in rows if q % 100 == 0], 10)
    assert found[1000] == want[1000] == [(0.0, 1000 + i) for i in range(1, 11)]
    hits = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
    assert found.keys() == want.keys() and hits >= 0.9 * 10 * len(want)
