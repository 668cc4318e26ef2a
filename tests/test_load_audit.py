"""Insert-if-absent, audits and the streaming ingest."""

from __future__ import annotations

import os
import tempfile

import pytest
from conftest import build_model, doc, task, ts
from pyspark.sql import functions as F

from fiscalflow.operators.audit import audit_fk, audit_pk, audit_status_pairs
from fiscalflow.operators.load import (
    BUCKET,
    KeyedTarget,
    first_per_key,
    insert_if_absent,
    load_if_absent,
    load_together,
    read_together,
    rejected_rows,
)
from fiscalflow.streaming import start_keyed_ingest

SCHEMA = "id long, name string, seq int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_if_absent_cases(spark):
    target = spark.createDataFrame([(1, "old", 0)], SCHEMA)
    incoming = spark.createDataFrame(
        [(1, "ignored", 1), (2, "second", 3), (2, "first", 2), (None, "rejected", 4)], SCHEMA
    )
    once = insert_if_absent(target, incoming, "id", ["seq"])
    assert rows(once) == [(1, "old", 0), (2, "first", 2)]
    twice = insert_if_absent(once, incoming, "id", ["seq"])
    assert rows(twice) == rows(once)
    assert rows(rejected_rows(incoming, "id")) == [(None, "rejected", 4)]


def test_first_per_key_is_skew_safe_aggregate(spark):
    # one key holds most rows: the result is still the first by load order
    data = [(7, f"r{i}", 1000 - i) for i in range(1000)] + [(8, "x", 5)]
    out = first_per_key(spark.createDataFrame(data, SCHEMA), "id", ["seq"])
    assert rows(out) == [(7, "r999", 1), (8, "x", 5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan  # map-side combine before the shuffle


def test_load_if_absent_appends_only_new(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ff-load-"), "t")
    batch1 = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], SCHEMA)
    batch2 = spark.createDataFrame([(2, "B", 0), (3, "c", 1), (3, "C", 2)], SCHEMA)
    load_if_absent(spark, path, batch1, "id", ["seq"])
    load_if_absent(spark, path, batch2, "id", ["seq"])
    load_if_absent(spark, path, batch2, "id", ["seq"])  # re-run: nothing added
    assert rows(spark.read.parquet(path)) == [(1, "a", 0), (2, "b", 1), (3, "c", 1)]


def test_load_refuses_or_sets_aside_rows_without_key(spark):
    base = tempfile.mkdtemp(prefix="ff-load-")
    path, aside = os.path.join(base, "t"), os.path.join(base, "rejected")
    batch = spark.createDataFrame([(1, "a", 0), (None, "b", 1)], SCHEMA)
    with pytest.raises(ValueError, match="1 rows without id"):
        load_if_absent(spark, path, batch, "id", ["seq"])
    assert not os.path.exists(path)
    assert load_if_absent(spark, path, batch, "id", ["seq"], rejected_path=aside) == 1
    assert rows(spark.read.parquet(path)) == [(1, "a", 0)]
    assert rows(spark.read.parquet(aside)) == [(None, "b", 1)]


def test_only_a_missing_path_is_a_new_target(spark):
    base = tempfile.mkdtemp(prefix="ff-load-")
    with open(os.path.join(base, "part-0.parquet"), "w") as f:
        f.write("no parquet file")
    batch = spark.createDataFrame([(1, "a", 0)], SCHEMA)
    with pytest.raises(Exception):
        load_if_absent(spark, base, batch, "id", ["seq"])
    assert os.listdir(base) == ["part-0.parquet"]


def test_tables_load_together_or_not_at_all(spark):
    base = tempfile.mkdtemp(prefix="ff-together-")
    one = spark.createDataFrame([(1, "a", 0)], SCHEMA)
    broken = one.withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        load_together(spark, base, {"docs": one, "items": broken}, "b1")
    with pytest.raises(ValueError, match="nothing is loaded"):
        read_together(spark, base, "docs")
    load_together(spark, base, {"docs": one, "items": one}, "b1")
    load_together(spark, base, {"docs": one, "items": one.limit(0)}, "b2")
    assert rows(read_together(spark, base, "docs")) == [(1, "a", 0)] * 2
    assert rows(read_together(spark, base, "items")) == [(1, "a", 0)]
    with pytest.raises(ValueError, match="already loaded"):
        load_together(spark, base, {"docs": one}, "b2")


def test_streaming_ingest_available_now(spark):
    base = tempfile.mkdtemp(prefix="ff-stream-")
    src, target, ckpt = (os.path.join(base, d) for d in ("src", "target", "ckpt"))
    spark.createDataFrame([(1, "a", 0), (2, "b", 1)], SCHEMA).write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame([(2, "x", 0), (3, "c", 1)], SCHEMA).write.parquet(os.path.join(src, "b2"))
    schema = spark.createDataFrame([], SCHEMA).schema
    q = start_keyed_ingest(spark, os.path.join(src, "*"), schema, target, "id", ["seq"], ckpt,
                           max_files_per_trigger=1)
    q.awaitTermination(120)
    got = rows(spark.read.parquet(target))
    assert [r[0] for r in got] == [1, 2, 3]
    assert len(got) == 3


def test_audits(spark):
    m = build_model(
        spark,
        cities=[(1, "A", 1), (2, "B", 9)],
        tax_documents=[doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 1, 5, 100),
                       doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 1, 1, 100),
                       doc(None, 1, "MaterialInvoice", 1.0, "1", "2", None, None, 100)],
        tasks=[task(1, None, ts(2024, 2, 1), 12, 130, 100),
               task(2, None, ts(2024, 2, 1), 12, 120, 100)],
    )
    pk = {(r["table_name"], r["key_value"], r["rows"]) for r in audit_pk(m).collect()}
    assert ("tax_documents", 1, 2) in pk and ("tax_documents", None, 1) in pk
    fk = {(r["constraint"], r["fk_value"]) for r in audit_fk(m).collect()}
    assert ("cities.state_id -> states", 9) in fk
    assert ("tax_documents.customer_city_id -> cities", 5) in fk
    assert ("tasks.process_instance_id -> process_instances", 100) in fk  # no process rows
    pairs = [tuple(r) for r in audit_status_pairs(m).collect()]
    assert pairs == [(1, 12, 130)]


def test_fk_one_row_two_violations(spark):
    m = build_model(
        spark,
        tax_documents=[doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 77, 88, None)],
        tasks=[task(5, None, ts(2024, 2, 1), 99, 999, None)],
    )
    got = sorted((r["constraint"], r["child_id"], r["fk_value"]) for r in audit_fk(m).collect())
    assert got == [
        ("tasks.status_id -> status", 5, 999),
        ("tasks.task_definition_id -> task_definitions", 5, 99),
        ("tax_documents.customer_city_id -> cities", 1, 88),
        ("tax_documents.process_instance_id -> process_instances", 1, 501),  # helper default
        ("tax_documents.supplier_city_id -> cities", 1, 77),
    ]


def test_first_per_key_null_order_value_first(spark):
    df = spark.createDataFrame([(1, "late", 5), (1, "unknown", None), (2, "x", 1)], SCHEMA)
    assert rows(first_per_key(df, "id", ["seq"])) == [(1, "unknown", None), (2, "x", 1)]


def test_a_batch_is_evaluated_once(spark):
    """Count, rejects and load read what was staged, with an old and a new target."""
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    base = tempfile.mkdtemp(prefix="ff-once-")
    path, aside = os.path.join(base, "t"), os.path.join(base, "rejected")
    batch = spark.createDataFrame([(i, "n", i) for i in range(50)] + [(None, "x", 0)] * 3, SCHEMA)
    for times in (1, 2):
        counted = batch.mapInArrow(counting, SCHEMA)
        assert load_if_absent(spark, path, counted, "id", ["seq"], rejected_path=aside) == 3
        assert seen.value == 53 * times
    report = KeyedTarget(spark, os.path.join(base, "k"), "id", 4).load(batch.mapInArrow(counting, SCHEMA), ["seq"], aside)
    assert seen.value == 53 * 3 and (report.rows, report.rejected, report.added) == (53, 3, 50)
    assert spark.read.parquet(path).count() == 50 and spark.read.parquet(aside).count() == 9


def test_keyed_target_equals_insert_if_absent_and_reads_few_files(spark):
    base = tempfile.mkdtemp(prefix="ff-keyed-")
    target = KeyedTarget(spark, os.path.join(base, "t"), "id", 16)
    assert target.read() is None
    first = spark.range(5000).select("id", F.col("id").cast("string").alias("name"), F.lit(0).alias("seq"))
    assert target.load(first, ["seq"]).added == 5000
    plain = first
    batches = [
        [(7, "seven", 1), (7, "sept", 0), (9001, "b", 2), (9001, "a", 1)],
        [(i, "x", i) for i in range(4990, 5300)],
        [(4999, "old", 0)],
        [],
    ]
    files = []
    for rows_in in batches:
        batch = spark.createDataFrame(rows_in, SCHEMA)
        report = KeyedTarget(spark, os.path.join(base, "t"), "id", 99).load(batch, ["seq"])  # buckets are stored
        plain = insert_if_absent(plain, batch, "id", ["seq"])
        assert rows(target.read()) == rows(plain)
        files.append(report.files_read)
    held = len([f for f in spark.read.parquet(os.path.join(base, "t")).inputFiles()])
    assert files[0] <= 2 and files[2] <= 3 and files[3] == 0 and files[1] >= 15 and held > 16
    at = spark.read.parquet(os.path.join(base, "t")).filter("id = 7").first()[BUCKET]
    plan = target.candidates(spark.createDataFrame([(7, at)], f"id long, {BUCKET} int"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan
    with pytest.raises(ValueError, match="keyed by id"):
        KeyedTarget(spark, os.path.join(base, "t"), "name")
    with pytest.raises(ValueError, match="1 rows without id"):
        target.load(spark.createDataFrame([(None, "a", 0)], SCHEMA), ["seq"])


def test_foreign_keys_are_one_anti_join_per_child_table(spark):
    from fiscalflow.plans.catalog import QUERIES

    plan = QUERIES["audit_fk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 4  # cities, documents, items, tasks; twelve constraints
    broken = build_model(
        spark,
        tax_documents=[doc(i, i, "MaterialInvoice", 1.0, "1", "2", 77 if i % 3 else 1, 1, 100) for i in range(300)],
        process_instances=[(100, "Inbound")],
    )
    found = audit_fk(broken)
    assert found.count() == 200 and {r["fk_value"] for r in found.collect()} == {77}
