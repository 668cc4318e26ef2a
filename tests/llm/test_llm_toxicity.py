from __future__ import annotations

import time
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalflow.llm import toxicity as tox
from fiscalflow.llm.queries import op3_toxicity
from llm_fixtures import make_docs, no_docs, odd_docs, odd_rows  # noqa: F401


def test_fold():
    assert tox.fold("An ІDІОТ, a m0r0n!") == [" an idiot a moron "]
    assert tox.fold("c1own") == [" ciown ", " clown "]
    assert tox.fold("ｆｕｌｌ wi​dth") == [" full width "]
    assert tox.fold("été 1999 $tupid") == [" été 1999 stupid "]
    assert tox.fold("") == ["  "] and tox.fold("!?") == ["  "]


@pytest.mark.parametrize(
    "word, plain",
    [("1d10t", "idiot"), ("assh0l3", "asshole"), ("4ssh0l3", "asshole"), ("$h1t", "shit"), ("as$", "ass"), ("6ro8", "grob"), ("b166er", "bigger"), ("m0r0n!!", "moron")],
)
def test_neighbouring_and_rarer_stand_ins(word, plain):
    assert f" {plain} " in tox.fold(word)


def test_numbers_and_hex_strings_stay():
    assert tox.fold("1999 $100 3.14 deadbeef0123 0x1f a!") == [" 1999 100 3 14 deadbeef0123 0x1f a "]


def test_short_words_are_learned_whole(spark):
    words = spark.createDataFrame([("zug", 30, 0), ("the", 30, 900)], "word string, toxic long, clean long")
    found = {r["pattern"]: (r["toxic"], r["clean"]) for r in tox.candidates(words).collect()}
    assert set(tox.choose(found, 100, 1000)) == {" zug "}


ENTRIES = ((" clown", 4.0), (" idiot", 3.0))


@pytest.mark.parametrize(
    "text, weight, hits",
    [
        ("an idiot and idiots", 6.0, 2), ("IDI0T", 3.0, 1), ("іdіоt", 3.0, 1), ("c1own", 4.0, 1), ("clown fish", 0.0, 0),
        ("a clown, a clown fish", 4.0, 1), ("nonidiot", 0.0, 0), ("", 0.0, 0), ("1999 2000", 0.0, 0),
    ],
)
def test_matches(text, weight, hits):
    assert tox.matched(text, ENTRIES, (" clown fish",))[:2] == (weight, hits)


def test_score_grows_with_weight_and_falls_with_length():
    curve = (-3.0, 1.0, 1.0)
    assert tox.score([0.0], [0], curve)[0] == tox.score([0.0], [500], curve)[0] < 0.1
    assert tox.score([4.0], [20], curve)[0] > tox.score([4.0], [2000], curve)[0] > tox.score([0.0], [2000], curve)[0]
    assert tox.score([1e6], [1], curve)[0] <= 1


def test_choose_takes_clean_beginnings_that_hold_the_documents():
    found = {
        " lowe": (40, 0), " lowei": (40, 0), " loweia": (9, 0), " loweib": (31, 0), " mora": (50, 900), " moral": (20, 900),
        " moras": (30, 0), " moras ": (30, 0), " rare": (3, 0),
    }
    assert set(tox.choose(found, 100, 1000)) == {" lowei", " moras"}


def corpus(make_docs, n=600):
    rng = random.Random(11)
    clean = ["river", "stone", "lower", "green", "trahe", "sofar", "clean", "morning", "idea", "tables"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(15, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["gromble", "gromblest", "vexnit", "vexnitty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return make_docs(rows), labels


def test_learns_unseen_endings_and_holds_out(spark, make_docs):
    docs, rows = corpus(make_docs)
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").filter("doc_id % 3 <> 0 or doc_id % 2 = 0")
    model = tox.learn(docs, labels.filter("doc_id < 400"))
    assert {" gromble", " vexnit"} <= {p for p, _ in model.entries}
    scores = {r["doc_id"]: r["score"] for r in tox.score_rows(docs, model).collect()}
    assert all((scores[i] >= tox.THRESHOLD) == bool(t) for i, _, t in rows)
    planted = make_docs([(1, "some stones vexnitoid river " * 3), (2, "gr0mb1e and green tables"), (3, "only rivers and stones here")])
    scores = {r["doc_id"]: r["score"] for r in tox.score_rows(planted, model).collect()}
    assert scores[1] >= tox.THRESHOLD and scores[2] >= tox.THRESHOLD and scores[3] < tox.THRESHOLD


def test_odd_rows_and_labels(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, 1, 1), (4, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = tox.learn(odd_docs, given)
        scored = tox.score_rows(odd_docs, model).collect()
        assert sorted(map(str, (r["doc_id"] for r in scored))) == sorted(str(r[0]) for r in odd_rows)
        assert all(0 <= r["score"] <= 1 for r in scored)
        kept = tox.keep(odd_docs, model)
        assert kept.schema == odd_docs.schema and kept.count() == sum(r["score"] < tox.THRESHOLD for r in scored)
        assert tox.score_rows(no_docs, model).count() == 0
    assert tox.learn(no_docs, labels).curve == tox.DEFAULT_CURVE


def test_curve_fit_separates():
    rng = np.random.default_rng(0)
    toxic = rng.integers(0, 2, 2000).astype(float)
    weight = toxic * rng.uniform(2, 20, 2000)
    words = rng.integers(10, 400, 2000)
    p = tox.score(weight, words, tox.fit_curve(weight, words, toxic))
    assert ((p >= 0.3) == (toxic > 0)).mean() > 0.99
    assert tox.fit_curve(weight, words, np.ones(2000)) == tox.DEFAULT_CURVE


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = op3_toxicity(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter(F.col("toxic").isNotNull()).collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p == t for p, t in held]) > 0.9


def test_entries_that_only_copies_of_one_text_hold_go():
    chosen = {" vexnit": 5.0, " river": 4.0}
    held = [[" vexnit"]] * 9 + [[" vexnit", " river"]] * 30 + [[]] * 50
    toxic = [1] * 39 + [0] * 50
    signatures = [*range(9), *[100] * 30, *range(200, 250)]
    assert set(tox.recount(chosen, held, toxic, signatures)) == {" vexnit"}


def test_near_copies_share_a_signature():
    words = [f"longword{i}x" for i in range(200)]
    same = sum(tox.signature(set(words)) == tox.signature({*words[:k], "otherword", *words[k + 1 :]}) for k in range(200))
    assert same >= 190


def plain_matched(text, entries, exceptions):
    """Every place of every pattern by plain search, exceptions span by span."""
    best = (0.0, 0)
    readings = tox.fold(text)
    for reading in readings:
        places = lambda p: [i for i in range(len(reading)) if reading.startswith(p, i)]
        spans = [(i, i + len(p) - 1) for p in exceptions for i in places(p)]  # a last space begins the next word
        at: dict = {}
        for p, w in entries:
            if p not in exceptions:
                for i in places(p):
                    at[i] = max(w, at.get(i, 0.0))
        hits = [w for i, w in at.items() if not any(a <= i < b for a, b in spans)]
        best = max(best, (sum(hits), len(hits)))
    return best


def test_matches_equal_plain_search():
    rng = random.Random(11)
    words = ["bast", "bastard", "sword", "bastards", "ass", "class", "idiot", "1diot", "moron", "m0r0n", "x", "bad"]
    entries = ((" bast", 1.0), (" bastard", 2.5), (" ass ", 1.5), (" idiot", 2.0), (" moron", 3.0), (" bad sword", 0.5))
    exceptions = (" bastard sword", " ass class", " bad bad ", " x")
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randrange(12)))
        got = tox.matched(text, entries, exceptions)
        want = plain_matched(text, entries, exceptions)
        assert got[1] == want[1] and got[0] == pytest.approx(want[0])


def test_a_million_words_of_matches_take_seconds():
    text = "bastard sword idiot " * 350_000
    began = time.time()
    weight, hits, words = tox.matched(text, ((" bast", 1.0), (" idiot", 2.0)), (" bastard sword",))
    assert (weight, hits, words) == (700_000.0, 350_000, 1_050_000) and time.time() - began < 30


def test_repeated_labelled_ids_stay_within_the_bound(spark, make_docs):
    """5,000 rows of one labelled id are one row of the sample; repeated texts too."""
    rows = [(1, f"text {i} of the same id") for i in range(5000)] + [(2, "two")] * 50 + [(i, f"clean words {i}") for i in range(3, 40)]
    labels = spark.createDataFrame([(i, 0, int(i < 3)) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    for bound in (10, 1000):
        learned, shift = tox.training_rows(make_docs(rows).repartition(4), labels, bound)
        found = learned.collect()
        assert len(found) <= max(4 * bound, 39) and sum(r["toxic"] for r in found) <= 2
        assert sorted(map(tuple, found)) == sorted(map(tuple, tox.training_rows(make_docs(rows), labels, bound)[0].collect()))
    assert len(found) == 39 and shift == 0


def test_few_toxic_labels_are_not_thinned(spark):
    """One toxic label in a thousand: all of them are in the sample, and the logit is shifted back."""
    known = spark.range(20_000).select((F.col("id") % 1000 == 0).cast("int").alias("toxic"))
    clean, toxic = tox.class_rates(known, 2000)
    assert toxic == 1.0 and clean == pytest.approx(1000 / 19_980)
