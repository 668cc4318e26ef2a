"""Panels from per-process aggregates against the panels of the fact."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import build_model, doc, task, ts
from fiscalflow import schemas
from fiscalflow.operators import metrics
from fiscalflow.operators.fact import build_fact
from fiscalflow.operators.factorised import FactorisedPanels
from fiscalflow.operators.filters import FilterSpec, apply_filters

TASK_NAMES, STATUS_NAMES = dict(schemas.TASK_DEFINITION_ROWS), dict(schemas.STATUS_ROWS)


@pytest.fixture(scope="module")
def crowded(spark):
    """Several documents and tasks per process, one process with a third of both, nulls."""
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    process = lambda: pick(7, 7, 7, None, *range(20, 27))
    docs = [
        doc(pick(i, i, None), i, pick("MaterialInvoice", "ServiceInvoice", None), pick(None, 10.25, 0.1 * i), pick(None, "1", "22", "333"),
            None, pick(None, 1, 2, 3, 99), 1, process() or -1)
        for i in range(1, 80)
    ]
    docs = [(*d[:-1], None if d[-1] == -1 else d[-1]) for d in docs]
    tasks = [
        task(i, pick(None, ts(2024, 1, 1, i % 24)), pick(None, ts(2024, 1, 1 + i % 9, 5), ts(2024, 2, 3, 23)), pick(10, 12, 13, 55, None),
             pick(100, 120, 121, None), process())
        for i in range(120)
    ]
    return build_model(spark, tax_documents=docs, tasks=tasks)


SPECS = [
    FilterSpec(),
    FilterSpec(period=("2024-01-03", "2024-01-08"), types=["MaterialInvoice", None]),
    FilterSpec(period=(dt.date(2024, 2, 1), None), tasks=[TASK_NAMES[12]], statuses=[STATUS_NAMES[120], None], states=["Serra", None]),
    FilterSpec(types=[]),
]


def values(df):
    def same(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(same(x) for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("spec", SPECS, ids=["default", "period", "narrow", "nothing"])
def test_equal_the_panels_of_the_fact(crowded, spec):
    fact = apply_filters(build_fact(crowded), spec)
    panels = FactorisedPanels(crowded, spec)
    for mine, theirs in (
        (panels.kpis(), metrics.kpis(fact)),
        (panels.distinct_documents(), metrics.distinct_documents(fact)),
        (panels.spend_by_supplier(), metrics.spend_by_supplier(fact)),
        (panels.supplier_pareto(2), metrics.supplier_pareto(fact, 2)),
        (panels.geo_volume(), metrics.geo_volume(fact)),
        (panels.geo_rollup_share(), metrics.geo_rollup_share(fact)),
        (panels.daily_volume(), metrics.daily_volume(fact)),
        (panels.lead_time_histogram(), metrics.lead_time_histogram(fact)),
        (panels.lead_time_summary(), metrics.lead_time_summary(fact)),
    ):
        assert mine.columns == theirs.columns and dict(mine.dtypes) == dict(theirs.dtypes)
        assert values(mine) == values(theirs)


def test_one_process_of_many_documents_and_tasks_makes_no_product(spark):
    """20,000 documents x 20,000 tasks of one process: 4 x 10^8 fact rows, never made."""
    n = 20_000
    docs = spark.range(n).select(
        "id", F.col("id").alias("number"), F.lit("MaterialInvoice").alias("type"), F.lit(1.5).alias("total_value"),
        (F.col("id") % 10).cast("string").alias("supplier_identification_number"), F.lit(None).cast("string").alias("customer_identification_number"),
        F.lit(None).cast("long").alias("supplier_state_id"), F.lit(None).cast("long").alias("customer_state_id"),
        F.lit(1).cast("long").alias("supplier_city_id"), F.lit(1).cast("long").alias("customer_city_id"), F.lit(7).cast("long").alias("process_instance_id"),
    )
    tasks = spark.range(n).select(
        "id", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("created_at"),
        F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, cast(id % 24 as int))").alias("completed_at"),
        F.lit(12).cast("long").alias("task_definition_id"), F.lit(120).cast("long").alias("status_id"),
        F.lit(None).cast("long").alias("assing_to_id"), F.lit(None).cast("long").alias("completed_by_id"), F.lit(7).cast("long").alias("process_instance_id"),
    )
    panels = FactorisedPanels(build_model(spark).with_tables(tax_documents=docs, tasks=tasks))
    k = panels.kpis().first()
    assert (k["spend"], k["documents"], k["suppliers"]) == (1.5 * n * n, n * n, 10)
    assert panels.daily_volume().collect()[0]["documents"] == n * n
    assert sum(r["documents"] for r in panels.lead_time_histogram().collect()) == n * n


@pytest.mark.parametrize("panel, shared", [("lead_time_histogram", "lead_time_hours"), ("geo_rollup_share", "supplier_state")])
def test_one_run_of_the_fact(spark, panel, shared):
    """The subquery reads the exchange of the panel's own aggregate, which stands above
    the documents x tasks join; the factorised form shares per-process aggregates."""
    from fiscalflow.plans.catalog import _model

    model = _model(spark, "/root/testdata/sf0.001")
    final = {}
    for name, found in (("fact", getattr(metrics, panel)(build_fact(model))), ("factorised", getattr(FactorisedPanels(model), panel)())):
        found.collect()
        final[name] = found._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in final["fact"] and f"ReusedExchange [{shared}" in final["fact"]
    assert "ReusedExchange" in final["factorised"]
