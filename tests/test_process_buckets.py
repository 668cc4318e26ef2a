"""Bucketed documents and tasks: the same fact without a shuffle below its join."""

from __future__ import annotations

import pytest

from conftest import build_model
from fiscalflow.operators.fact import build_fact, docs_tasks_join
from fiscalflow.operators.process_buckets import ProcessBuckets
from test_factorised import crowded, values  # noqa: F401  (the fixture)


@pytest.fixture(scope="module")
def stored(crowded):  # noqa: F811
    return ProcessBuckets.store(crowded, buckets=4, busy_rows=30)


def test_equal_the_fact_of_the_tables(crowded, stored):  # noqa: F811
    assert values(stored.fact()) == values(build_fact(crowded))
    for name in ("tax_documents", "tasks"):
        assert values(stored.table(name)) == values(crowded.table(name))


def test_busy_processes_and_rows_without_one_are_apart(stored):
    for name in ("tax_documents", "tasks"):
        assert {r[0] for r in stored.apart.table(name).select("process_instance_id").collect()} == {7, None}
        assert not {7, None} & {r[0] for r in stored.even.table(name).select("process_instance_id").collect()}


def test_no_exchange_below_the_join(spark, stored, crowded):  # noqa: F811
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = docs_tasks_join(stored.even)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert plan.count("Bucketed: true") == 2
        assert "Exchange" in docs_tasks_join(crowded)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_nothing(spark):
    assert ProcessBuckets.store(build_model(spark), buckets=2).fact().collect() == []
