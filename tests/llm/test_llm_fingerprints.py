from __future__ import annotations

import base64
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from fiscalflow.llm import fingerprints as fp
from fiscalflow.llm import queries
from llm_fixtures import make_docs, no_docs, odd_docs, odd_rows  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chained(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed >> 16


def plain_shingles(text, size=5):
    words = WORD.findall(text or "")
    if not words:
        return set()
    return {chained(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def plain_sketch(text, k=fp.K):
    return sorted(plain_shingles(text))[:k]


def plain_next(rows):
    """doc_id -> the next document's text."""
    texts: dict = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(t or "")
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    ids = sorted(texts)
    return {i: min(texts[j], key=signed) for i, j in zip(ids, ids[1:] + ids[:1])}


def plain_edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def plain_likeness(a, b, k=fp.K):
    limit = min([s[-1] for s in (a, b) if len(s) == k], default=1 << 48)
    a, b = ({x for x in s if x <= limit} for s in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_rows(rows, k=fp.K):
    following = plain_next(rows)
    out = []
    for i, text in rows:
        text = text or ""
        after = following.get(i)
        edited = plain_edited(text, after or "")
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_sketch(text, k), plain_sketch(edited, k),
            None if after is None else plain_sketch(after, k),
        ))
    return sorted(out, key=str)


def got(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 6])
def test_equals_brute_force(odd_docs, odd_rows, parts):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert got(fp.against_edited(odd_docs.repartition(parts))) == plain_rows(rows)
    assert got(fp.against_edited(odd_docs, k=7)) == plain_rows(rows, 7)


def test_query_over_whole_tables(spark):
    base = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in queries.op11_fingerprints(spark, base).collect()}
    assert len(found) == len(rows)
    for i, n, sha, mine, edited, after in plain_rows(rows):
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["fingerprint"] == base64.b64encode(b"".join(x.to_bytes(6, "big") for x in mine)).decode()
        assert r["edited_fingerprint"] == base64.b64encode(b"".join(x.to_bytes(6, "big") for x in edited)).decode()
        assert r["near_edited"] == pytest.approx(plain_likeness(mine, edited))
        assert r["near_next"] == pytest.approx(plain_likeness(mine, after))


def test_estimates(spark):
    """Long texts: estimates near the truth; short ones: exact."""
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    pairs = [(text(0, 4004), text(2000, 6004)), (text(0, 40), text(10, 40)), ("", ""), ("", "a"), ("a b", "a b"), (text(0, 1004), text(0, 4004))]
    df = spark.createDataFrame(pairs, "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    found = df.select(
        fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("a"), F.col("b")), fp.distinct_shingles(F.col("a"))
    ).collect()
    for (a, b), (likeness, inside, n) in zip(pairs, found):
        x, y = plain_shingles(a), plain_shingles(b)
        small = len(x | y) < fp.K
        assert likeness == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0, abs=1e-9 if small else 0.15)
        assert inside == pytest.approx(len(x & y) / len(x) if x else 1.0, abs=1e-9 if small else 0.2)
        assert n == pytest.approx(len(x), rel=1e-9 if small else 0.3)


def test_merging_parts_is_the_sketch_of_the_whole(spark, odd_docs, odd_rows):
    sketches = fp.fingerprints(odd_docs).join(odd_docs.select("doc_id", "source").distinct(), "doc_id")
    merged = {r["source"]: r["sketch"] for r in fp.merged_by(sketches, "source").collect()}
    want: dict = {}
    for row in odd_rows:
        if row[0] is not None:
            source = row[3] if len(row) > 3 else "src0"
            want.setdefault(source, set()).update(plain_shingles(row[1]))
    assert merged == {s: sorted(x)[: fp.K] for s, x in want.items()}
    two = spark.createDataFrame([(list(range(0, 300, 3)), list(range(0, 300, 2)))], "a array<long>, b array<long>")
    assert two.select(fp.merged(F.col("a"), F.col("b"))).first()[0] == sorted({*range(0, 300, 3), *range(0, 300, 2)})[: fp.K]
    empty = spark.createDataFrame([("x", [])], "key string, sketch array<long>")
    assert [tuple(r) for r in fp.merged_by(empty, "key").collect()] == [("x", [])]


def test_text_form_round_trip(spark):
    sketches = [[], [0], [5, 1 << 40, (1 << 48) - 1]]
    df = spark.createDataFrame([(s,) for s in sketches], "s array<long>").select("s", fp.text_of(F.col("s")).alias("t"))
    assert all(r["s"] == r["again"] for r in df.select("s", fp.from_text(F.col("t")).alias("again")).collect())


def test_repeated_ids_of_third_of_all_rows(make_docs):
    rows = [(i, f"text number {i} " * 12) for i in range(60)] + [(30, "again and again the same words here")] * 20 + [(30, "other words")] * 10
    assert got(fp.against_edited(make_docs(rows).repartition(5))) == plain_rows(rows)


def test_one_and_none(make_docs, no_docs):
    assert fp.against_edited(no_docs).count() == 0
    one = [(3, "one two three four five six")]
    assert got(fp.against_edited(make_docs(one))) == plain_rows(one)
    assert got(fp.against_edited(make_docs([(None, "abc d"), (None, None)]))) == plain_rows([(None, "abc d"), (None, None)])


def test_main_path_is_native(spark, odd_docs):
    plan = fp.against_edited(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|SerializeFromObject", plan)


def test_texts_cross_one_shuffle(spark):
    """Both joins read the same exchange of the texts, also when nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fp.against_edited(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in plan
