"""Physical-plan checks: broadcast of small dimensions, pushdown, top-k, no
row-at-a-time Python, no cross joins, scalar subquery for the histogram."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fiscalflow.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_and_no_cartesian(spark, key):
    p = plan(QUERIES[key](spark, SF))
    assert "EvalPython" not in p
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_small_dimensions_broadcast_in_fact(spark):
    p = plan(entry.queries()["fact"](spark, SF))
    # code tables and geography are broadcast from the first (static) plan
    assert p.count("BroadcastHashJoin") >= 4
    assert "LocalTableScan" in p


def test_pareto_is_take_ordered(spark):
    p = plan(entry.queries()["supplier_pareto_top10"](spark, SF))
    assert "TakeOrderedAndProject" in p


def test_histogram_bounds_are_a_scalar_subquery(spark):
    p = final_plan(entry.queries()["lead_time_hist"](spark, SF))
    assert "Subquery" in p


def test_lineitem_scan_prunes_columns(spark):
    p = plan(entry.queries()["fmt_date"](spark, SF))
    scan = [line for line in p.splitlines() if "lineitem.parquet" in line][0]
    assert "l_extendedprice" not in scan and "l_partkey" not in scan


def test_insert_if_absent_partial_aggregation(spark):
    p = plan(entry.queries()["insert_if_absent"](spark, SF))
    assert "partial_min" in p


def test_a_grown_dimension_is_planned_by_its_size_now(spark, tmp_path):
    """The choice of join follows the table as it is read, not an earlier proof."""
    from fiscalflow.functions.keys import lookup_with_default

    path = f"{tmp_path}/codes"
    facts = spark.range(1000).withColumnRenamed("id", "k")
    codes = spark.range(20).select("id", F.col("id").cast("string").alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        codes.write.parquet(path)
        look = lambda: plan(lookup_with_default(facts, "k", spark.read.parquet(path), "id", "v", "?", "w"))
        assert "BroadcastHashJoin" in look()
        spark.range(20, 200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")).write.mode("append").parquet(path)
        assert "BroadcastHashJoin" not in look()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_process_is_split_under_the_report_distinct(spark):
    """One process holds a third of the tasks: AQE splits its join partition below the
    report's distinct without any setting that forces it."""
    import datetime as dt

    from conftest import build_model, doc

    from fiscalflow.operators.report import report_keys

    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        m = build_model(spark, tax_documents=[doc(i, i, "MaterialInvoice", 1.0, "1", "2", 1, 2, i) for i in range(300)])
        tasks = spark.range(300_000).select(
            "id",
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
            F.expr("timestamp_ntz'2024-02-03 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("completed_at"),
            F.lit(12).cast("long").alias("task_definition_id"),
            F.lit(120).cast("long").alias("status_id"),
            F.lit(None).cast("long").alias("assing_to_id"),
            F.lit(None).cast("long").alias("completed_by_id"),
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 300).alias("process_instance_id"),
        )
        df = report_keys(m.with_tables(tasks=tasks), dt.date(2024, 3, 15))
        df.collect()
        assert "SortMergeJoin(skew=true)" in plan(df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_null_suppliers_stay_out_of_the_supplier_join(spark):
    from fiscalflow.sources.tpch import model_from_tpch

    docs = model_from_tpch(spark, SF).tax_documents
    assert docs.filter("supplier_identification_number is null").count() > 0
    assert "% 40) = 0)" in plan(docs)


def test_stored_histogram_sends_one_row_per_bin_and_task(spark):
    from fiscalflow.operators.metrics import lead_time_histogram, stored_lead_time_histogram

    fact = spark.range(0, 200_000, 1, 4).select(((F.col("id") * 7919 % 100003) / 97).alias("lead_time_hours"))
    df = stored_lead_time_histogram(fact)
    assert [tuple(r) for r in df.collect()] == [tuple(r) for r in lead_time_histogram(fact).collect()]
    executed = df._jdf.queryExecution().executedPlan()
    written = []

    def walk(node):
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        for name in ("executedPlan", "plan", "child"):
            if node.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "AQEShuffleRead", "ResultQueryStage") and hasattr(node, name):
                try:
                    walk(getattr(node, name)())
                except Exception:  # noqa: BLE001 - a node without that method
                    pass

    walk(executed)
    assert written and max(written) <= 20 * 4


def test_kpis_have_no_expand_and_membership_is_pushed(spark, tmp_path):
    q = entry.queries()
    assert "Expand" not in plan(q["kpis"](spark, SF))
    from fiscalflow.operators.filters import FilterSpec, filter_members

    q["fact"](spark, SF).write.parquet(f"{tmp_path}/fact")
    stored = spark.read.parquet(f"{tmp_path}/fact")
    p = plan(filter_members(stored, FilterSpec(types=["MaterialInvoice"], tasks=["a", "b"])))
    assert "EqualTo(document_type,MaterialInvoice)" in p and "In(task_name" in p


def test_exports_evaluate_the_selection_once(spark, tmp_path):
    import datetime as dt

    from fiscalflow.operators.export import export_filtered

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    fact = entry.queries()["fact"](spark, SF).limit(1000)
    counted = fact.mapInArrow(count, fact.schema)
    export_filtered(counted, str(tmp_path), dt.datetime(2024, 1, 1))
    assert seen.value == 1000
