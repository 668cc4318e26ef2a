from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from fiscalflow.llm import simhash
from fiscalflow.llm.common import components
from llm_fixtures import make_docs, no_docs, odd_docs, odd_rows  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict, radius=2):
    """Smallest id reachable over links, by flooding."""
    ids, out = sorted(fps), {}
    for first in ids:
        if first in out:
            continue
        front = [first]
        out[first] = first
        while front:
            x = front.pop()
            for y in ids:
                if y not in out and (fps[x] ^ fps[y]).bit_count() <= radius:
                    out[y] = first
                    front.append(y)
    return out


def near_fingerprints(rng, groups, size, flips):
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.append(x)
    return out


def test_fingerprint_matches_the_definition(odd_rows):
    for _, text, *_ in odd_rows:
        if text is None or len(text) < 100_000:
            assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_fingerprint_hashes_as_spark_does(spark):
    text = "one two three"
    spark_hash = spark.sql(f"select xxhash64('{text}') h").first()["h"] & (1 << 64) - 1
    assert simhash.fingerprint(text.encode()) == spark_hash


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_planes_find_all_within_radius(radius):
    rng = random.Random(radius)
    fps = np.array(near_fingerprints(rng, 12, 30, radius) + [0, (1 << 64) - 1], np.uint64)
    found = np.unpackbits(simhash.within_radius(fps, fps, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    assert (found.astype(bool) == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_block_pairs_miss_no_link():
    for radius in (1, 2, 3):
        masks = simhash.block_pairs(radius)
        rng = random.Random(1)
        for _ in range(500):
            x = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("tile", [3, 2048])
def test_links_connect_what_brute_force_connects(spark, tile):
    rng = random.Random(3)
    fps = sorted(set(near_fingerprints(rng, 15, 40, 3)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    edges = simhash.links(nodes, 2, tile)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    want = plain_components(dict(enumerate(fps)))
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(chain)
    hub = [(7, x) for x in range(200, 400)]
    edges = spark.createDataFrame(chain + hub + [(9, 9), (3, None), (400, 401), (401, 400)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{x: 7 for x in range(200, 400)}, 400: 400, 401: 400}
    assert components(edges.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows):
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()]
    fps = {r[0]: plain_fingerprint(r[1]) for r in odd_rows if r[0] is not None}
    reached = plain_components(fps)
    want = [(r[0], plain_fingerprint(r[1]), reached.get(r[0])) for r in odd_rows]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(odd_rows)


def test_keep_one_keeps_rows_as_they_were(odd_docs, odd_rows, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0))
    reached = plain_components({r[0]: plain_fingerprint(r[1]) for r in odd_rows if r[0] is not None})
    assert ids == [*sorted(set(reached.values())), None, None]
    assert simhash.keep_one(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_hex_digits(spark):
    got = spark.createDataFrame([(0,), (-1,), (255,)], "fp long").select(simhash.hex_digits("fp").alias("x")).collect()
    assert [r["x"] for r in got] == ["0" * 16, "f" * 16, "00000000000000ff"]


def test_different_texts_under_one_id_stay(make_docs):
    """Three rows, no two linked, two share an id: all three stay, on every run; linked
    rows of an id leave one, whichever partition they are in."""
    a, b, c = ("alpha beta gamma delta " * 5, "one two three four five six seven", "completely other words stand here now")
    assert len({simhash.fingerprint(x.encode()) for x in (a, b, c)}) == 3
    rows = [(1, a), (1, b), (5, c)]
    for parts in (1, 3):
        docs = make_docs(rows).repartition(parts)
        assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == sorted(rows)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(make_docs(rows + [(0, b)])).collect()}
    assert got == {(1, 1), (1, 0), (0, 0), (5, 5)}
    more = rows + [(1, a), (7, a), (0, b), (1, a.upper())]
    kept = sorted((r["doc_id"], r["text"].lower()) for r in simhash.keep_one(make_docs(more)).collect())
    assert kept == sorted([(1, a), (0, b), (5, c)])
