from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fiscalflow.llm import kn_quality as kn
from llm_fixtures import make_docs, no_docs, odd_docs, odd_rows  # noqa: F401


def plain_model(texts, base=None):
    """Interpolated modified Kneser-Ney over characters, straight from the formulas; below
    the single characters ``base`` of the whole n-gram, or one place for symbols never seen."""
    padded = [kn.START * 3 + " ".join(t.split()) + kn.END for t in texts]
    top = Counter(p[i : i + 4] for p in padded for i in range(len(p) - 3))
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, c in counts.items():
        t = Counter(c.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
        d = []
        for k in (1, 2, 3):
            x = k - (k + 1) * y * t[k + 1] / t[k] if y is not None and t[k] else 0.5
            d.append(min(max(x, 0.05), k - 0.05))
        discounts[n] = d
    followers = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            followers[n][g[:-1]].append(k)

    def p(gram, whole=None):
        n, whole = len(gram), whole or gram
        if not n:
            return base(whole) if base else 1 / (len(counts[1]) + 1)
        some = followers[n].get(gram[:-1])
        if not some:
            return p(gram[1:], whole)
        d, c = discounts[n], counts[n][gram]
        freed = sum(d[min(k, 3) - 1] for k in some)
        return ((c - d[min(c, 3) - 1] if c else 0) + freed * p(gram[1:], whole)) / sum(some)

    return p


def layered(texts, all_texts=None):
    """A language's model over the model of all languages."""
    return plain_model(texts, plain_model(all_texts or texts))


def plain_perplexity(p, text):
    """Symbols are UTF-16 units: a character beyond them is two."""
    text = " ".join((text or "").split()).encode("utf-16-le")
    padded = kn.START * 3 + "".join(chr(text[i] | text[i + 1] << 8) for i in range(0, len(text), 2)) + kn.END
    logs = [math.log(p(padded[i : i + 4])) for i in range(len(padded) - 3)]
    return math.exp(-sum(logs) / len(logs))


TRAIN = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog and a hat", "that is that, they said", "été à la plage"]


def test_probabilities_of_a_context_add_up():
    p = plain_model(TRAIN)
    symbols = sorted({c for t in TRAIN for c in t} | {kn.END})
    for context in ("the", "at ", "zzz", kn.START * 3):
        # what is left is the place of symbols never seen
        assert sum(p(context + s) for s in symbols) + p(context[1:] + "\x07") == pytest.approx(1, abs=0.02)


FRENCH = ["le chat et le chien", "la plage est belle"]


def test_perplexities_match_the_formulas(spark, make_docs, monkeypatch):
    """Two languages with trusted text, one without, several parts."""
    monkeypatch.setattr(kn, "PART_CHARS", 40)
    trusted = [(i, t, "en") for i, t in enumerate(TRAIN)] + [(50 + i, t, "fr") for i, t in enumerate(FRENCH)]
    model = kn.count_grams(kn.documents(make_docs(trusted)).withColumn("place", F.lit(0)))
    texts = [*TRAIN, "", None, "the  hat\n sat", "QQQ %%% \U0001f642", "xyz " * 300, "the cat sat on the mat"]
    docs = make_docs([(i, t, "en") for i, t in enumerate(texts)] + [(98, "le chat", "fr"), (99, "the cat", "de")])
    stored = kn.materialize(kn.documents(docs).withColumn("place", F.lit(kn.FOLDS)).repartition(2), "test-kn")
    got = {r["doc_id"]: r["perplexity"] for r in kn.perplexities(stored, model).collect()}
    everything = TRAIN + FRENCH
    assert got.pop(99) == pytest.approx(plain_perplexity(plain_model(everything), "the cat"), rel=1e-9)
    assert got.pop(98) == pytest.approx(plain_perplexity(layered(FRENCH, everything), "le chat"), rel=1e-9)
    p = layered(TRAIN, everything)
    assert got == {i: pytest.approx(plain_perplexity(p, t), rel=1e-9) for i, t in enumerate(texts)}
    assert got[8] > got[0]


def test_grams_when_cells_are_many(monkeypatch):
    flat, sizes = kn.units(["some words", "", "more words é漢"])
    keys, number = kn.grams(flat)
    monkeypatch.setattr(kn, "DENSE_CELLS", 1)
    keys2, number2 = kn.grams(flat)
    assert (keys[number] == keys2[number2]).all() and len(number) == sizes.sum()


def test_classify(spark, make_docs):
    sentences = ["the small river runs to the sea", "a stone lies in the green field", "they walk along the old road"]
    rows, labels = [], []
    for i in range(240):
        junk = i % 8 == 7
        text = " ".join(f"{w}%%%" for w in sentences[i % 3].upper().split()) if junk else f"{sentences[i % 3]} and {sentences[(i + 1) % 3]}"
        rows.append((i, text, "en" if i % 2 else None))
        if i < 160:
            labels.append((i, int(not junk), 0))
    rows += [(500, None, "en"), (501, "", None), (None, sentences[0], "en"), (502, "un pez en el mar", "es")]
    docs = kn.materialize(make_docs(rows), "test-kn-docs")
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kn.classify(docs, known).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] != (i % 8 == 7) for i in range(240))
    assert got[502]["perplexity"] > 0 and got[502]["threshold"] > 0 and got[500]["perplexity"] > 0  # no trusted Spanish
    nothing = kn.classify(docs, known.limit(0)).collect()
    assert len(nothing) == len(rows) and all(r["kept"] and r["perplexity"] is None for r in nothing)
    assert kn.classify(kn.materialize(docs.limit(0), "test-kn-none"), known).count() == 0


def test_limits_rest_on_all_trusted_rows_and_small_languages_share_them(spark, make_docs):
    words = {"en": "river stone field road water house".split(), "fr": "maison pierre chemin herbe ville jour".split()}
    rng = random.Random(5)
    prose = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(30))
    rows = [(i, prose("en"), "en") for i in range(300)] + [(300 + i, prose("fr"), "fr") for i in range(5)]
    rows += [(400, "%%% ZQX " * 30, "fr"), (401, prose("fr"), "fr"), (402, "%%% ZQX " * 30, "en"), (7, rows[7][1], "en")]
    rows[3] = (3, "%%% one trusted outlier ### " * 6, "en")  # alone it set the limit
    docs = kn.materialize(make_docs(rows), "test-kn-limits")
    known = spark.createDataFrame([(i, 1, 0) for i in range(305)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kn.classify(docs, known).collect()}
    assert not got[3]["kept"] and not got[402]["kept"] and got[3]["perplexity"] > 2 * got[3]["threshold"]
    # fr: five trusted rows, any fold of which may be empty
    assert got[400]["threshold"] is not None and not got[400]["kept"] and got[401]["kept"]
    assert sum(got[i]["kept"] for i in range(300)) >= 295


def test_trusted_rows_are_scored_without_their_fold(spark, make_docs):
    texts = [" ".join(random.Random(i).choices(TRAIN, k=6)) for i in range(40)]
    docs = kn.materialize(make_docs([(i, t, "en") for i, t in enumerate(texts)]), "test-kn-folds")
    known = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["perplexity"] for r in kn.classify(docs, known).collect()}
    fold = {r["doc_id"]: r["place"] for r in kn.placed(kn.documents(docs), kn.trusted_ids(known)).collect()}
    assert set(fold.values()) <= set(range(kn.FOLDS))
    for k in set(fold.values()):
        p = layered([t for i, t in enumerate(texts) if fold[i] != k])
        assert all(got[i] == pytest.approx(plain_perplexity(p, t), rel=1e-9) for i, t in enumerate(texts) if fold[i] == k)


def test_limits_shrink_without_jumps(spark):
    """A language's own quantile counts more with each trusted row; none means the shared."""
    rng = random.Random(1)
    rows = [("en", math.exp(rng.gauss(2, 0.2)), True) for _ in range(4000)]
    for lang, n in (("a", 1), ("b", 200), ("c", 4000)):
        rows += [(lang, math.exp(rng.gauss(3, 0.2)), True) for _ in range(n)]
    scored = spark.createDataFrame(rows + [("z", 5.0, False)], "lang string, perplexity double, trusted boolean")
    of_lang, shared = kn.limits(scored, 0.99)
    got, common = {r["lang"]: math.log(r["threshold"]) for r in of_lang.collect()}, math.log(shared.first()[0])
    own = 3 + 2.33 * 0.2
    assert "z" not in got and abs(got["a"] - common) < 0.05 and abs(got["c"] - own) < 0.15
    assert sorted([common, got["a"], got["b"], got["c"]]) == [common, got["a"], got["b"], got["c"]]


def test_all_trusted_rows_in_one_fold(spark, make_docs):
    """Without its own fold nothing is left: no perplexity, kept."""
    docs = kn.materialize(make_docs([(1, "same text", "en"), (2, "same text", "en"), (3, "other", "en")]), "test-kn-one-fold")
    known = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kn.classify(docs, known).collect()}
    assert got[1]["perplexity"] is None and got[1]["kept"] and got[3]["perplexity"] > 0


def test_splits_do_not_follow_the_cores(spark):
    name = "spark.sql.files.minPartitionNum"
    with kn.same_splits(spark):
        assert int(spark.conf.get(name)) == spark.sparkContext.defaultParallelism
    assert spark.conf.get(name, None) is None
