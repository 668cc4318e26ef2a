from __future__ import annotations

from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from fiscalflow.llm import packing, quality_rules, queries, simhash, toxicity
from fiscalflow.llm.common import materialize
from test_llm_quality_rules import plain_verdict
from test_llm_simhash import plain_components, plain_fingerprint
from llm_fixtures import make_docs, no_docs, odd_docs, odd_rows  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_entry_registers_the_queries():
    registered = __spark_entry__.queries()
    assert registered["pipeline"].__wrapped__ is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert all(registered[name].__wrapped__ is query for name, query in queries.QUERIES.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "packing"]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {i: t for i, t in rows.items() if plain_verdict(t)}
    model = toxicity.learn(docs, queries.learnt_labels(spark, SF))
    found = {i: toxicity.matched(t, model.entries, model.exceptions) for i, t in good.items()}
    mild = {i: t for i, t in good.items() if toxicity.score([found[i][0]], [found[i][2]], model.curve)[0] < toxicity.THRESHOLD}
    kept = set(plain_components({i: plain_fingerprint(t) for i, t in mild.items()}).values())
    held = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (set(good), set(mild), kept)):
        held = materialize(stage(spark, held, SF), "test-pipeline")
        assert {r["doc_id"] for r in held.collect()} == want, name
        assert held.columns == docs.columns
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]] += r["length"]
        assert 0 <= r["offset"] < 4096 and r["offset"] + r["length"] <= 4096
    encoded = packing.encode_partitions(held)
    assert pieces == {r["doc_id"]: len(r["ids"]) // 4 for r in encoded.collect()} and pieces.keys() == kept


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_no_rows(spark, odd_docs, no_docs, name, stage):
    assert stage(spark, no_docs, SF).count() == 0
    out = stage(spark, odd_docs, SF)
    assert out.count() > 0
    if name != "packing":
        assert out.schema == odd_docs.schema


def test_clean_documents_stay(spark, make_docs):
    text = "The morning train was late again, so we walked along the river and talked about the long summer that had just ended."
    docs = make_docs([(i, f"{text} Number {i} of our walks went {'north' if i % 2 else 'south'} for {i * 7} minutes.") for i in range(20)])
    assert quality_rules.keep(docs).count() == 20
    assert corpus_pipeline.toxicity_stage(spark, docs, SF).count() == 20
    assert simhash.keep_one(docs).count() >= 1
