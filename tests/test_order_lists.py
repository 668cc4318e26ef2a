"""Streamed purchase-order lists against the aggregate's and plain Python."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fiscalflow.operators.order_lists import joined_runs, order_pieces, po_rollup_streamed
from fiscalflow.operators.report import po_rollup

SCHEMA = "extra int, tax_document_id long, purchase_order string"


@pytest.fixture()
def small_batches(spark):
    """Runs and repeated pairs cross the borders of batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, old)


def rows_of(df):
    return sorted(((r["tax_document_id"], r["purchase_orders"]) for r in df.collect()), key=str)


def test_equal_the_aggregate(spark, small_batches):
    rng = random.Random(3)
    orders = [None, "", " ", "PO-1", "PO-10", "PO-2", "po-1", "é", "\U0001f600", "￿", "a, b"]
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3, *range(10, 30)]), rng.choice(orders)) for i in range(400)]
    rows += [(0, 99, None), (0, 99, None), (0, 98, "")]
    items = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for _, document, order in rows:
        want.setdefault(document, set()).add(order)
    plain = {d: ", ".join(sorted(s - {None}, key=str.encode)) if s - {None} else None for d, s in want.items()}
    for partitions in (1, 3, None):
        got = rows_of(po_rollup_streamed(items, partitions=partitions))
        assert got == sorted(plain.items(), key=str)
    assert rows_of(po_rollup(items)) == sorted(plain.items(), key=str)
    assert dict(po_rollup_streamed(items).dtypes) == dict(po_rollup(items).dtypes)


def test_one_document_of_a_million_orders(spark):
    n = 1_000_000
    hot = spark.range(2 * n).select(F.lit(7).cast("long").alias("tax_document_id"), F.format_string("PO-%07d", F.col("id") % n).alias("purchase_order"))
    rest = spark.range(n // 2).select((F.col("id") % 1000 + 100).alias("tax_document_id"), F.format_string("PO-%d", F.col("id") % 3).alias("purchase_order"))
    items = hot.unionByName(rest)
    pieces = order_pieces(items, partitions=8).filter("tax_document_id = 7").select(
        F.spark_partition_id().alias("range"), "first_order", F.length("purchase_orders").alias("length")
    ).collect()
    assert len({p["range"] for p in pieces}) >= 5  # the document is spread over tasks
    assert max(p["length"] for p in pieces) <= 10_000 * len("PO-0000000, ")
    got = po_rollup_streamed(items, partitions=8).select(
        "tax_document_id", F.length("purchase_orders").alias("length"), F.xxhash64("purchase_orders").alias("hash")
    )
    want = spark.createDataFrame([(", ".join(f"PO-{i:07d}" for i in range(n)),)], "t string").select(F.length("t"), F.xxhash64("t")).first()
    found = {r["tax_document_id"]: (r["length"], r["hash"]) for r in got.collect()}
    assert found[7] == tuple(want) and len(found) == 1001
    assert {found[d] for d in found if d != 7} == {tuple(spark.sql("select length('PO-0, PO-1, PO-2'), xxhash64('PO-0, PO-1, PO-2')").first())}


def test_text_keys_and_no_items(spark, small_batches):
    items = spark.createDataFrame([("d", "b"), ("d", "a"), (None, "c"), ("e", None)], "tax_document_id string, purchase_order string")
    assert rows_of(po_rollup_streamed(items)) == sorted([("d", "a, b"), (None, "c"), ("e", None)], key=str)
    assert po_rollup_streamed(items.limit(0)).collect() == []


def test_runs_of_a_batch():
    documents, first, texts = joined_runs(pa.array([None, 1, 1, 1, 2]), pa.array(["x", None, "a", "a", None]))
    assert (documents.to_pylist(), first.to_pylist(), texts.to_pylist()) == ([None, 1, 2], ["x", "a", None], ["x", "a", None])
