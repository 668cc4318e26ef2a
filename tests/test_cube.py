"""The stored cube against the KPIs of the fact, under random selections."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import build_model, doc, task, ts
from fiscalflow import schemas
from fiscalflow.operators import cube, metrics
from fiscalflow.operators.cube import KpiCube
from fiscalflow.operators.fact import build_fact
from fiscalflow.operators.filters import FilterSpec, apply_filters
from test_factorised import crowded, values  # noqa: F401  (the fixture)

TYPES = ["MaterialInvoice", "ServiceInvoice", "None such", None]
TASKS = [*dict(schemas.TASK_DEFINITION_ROWS).values()]
STATUSES = [*dict(schemas.STATUS_ROWS).values(), None]
STATES = ["Serra", "Porto Novo", None]
DAYS = [None, *(f"2024-01-0{d}" for d in range(1, 10)), "2024-02-03", "2024-03-01"]


def random_spec(rng):
    some = lambda xs: None if rng.random() < 0.4 else rng.sample(xs, rng.randrange(len(xs)))
    period = None if rng.random() < 0.3 else (rng.choice(DAYS), rng.choice(DAYS))
    return FilterSpec(period, some(TYPES), some(TASKS), some(STATUSES), some(STATES))


@pytest.fixture(scope="module")
def stored(crowded):  # noqa: F811
    fact = build_fact(crowded).withColumn("posted_month", F.date_format("posted_on", "yyyy-MM")).cache()
    yield KpiCube.build(crowded), fact
    fact.unpersist()


def test_equal_the_kpis_of_the_fact(stored):
    rng = random.Random(3)
    cells, fact = stored
    for spec in [FilterSpec(), *(random_spec(rng) for _ in range(10))]:
        assert values(cells.kpis(spec)) == values(metrics.kpis(apply_filters(fact, spec))), spec


@pytest.mark.parametrize("by", [["supplier_state"], ["posted_month", "document_type"], ["posted_on", "task_name", "task_status"]])
def test_suppliers_by_columns(stored, by):
    cells, fact = stored
    wanted = apply_filters(fact, FilterSpec()).groupBy(*by).agg(F.count_distinct("supplier_cnpj").alias("suppliers")).filter("suppliers > 0")
    assert values(cells.suppliers(by=by)) == values(wanted)


def test_period_prunes_months_and_the_fact_is_not_read(stored):
    cells, _ = stored
    chosen = cells._selected(cells.sets, FilterSpec(period=("2024-02-01", "2024-02-28")))
    plan = cells.kpis(FilterSpec(period=("2024-02-01", "2024-02-28")))._jdf.queryExecution().toString()
    assert chosen.count() == cells.sets.filter("posted_month = '2024-02' and supplier_state is not null").count() > 0
    assert "PartitionFilters: [isnotnull(posted_month" in plan
    assert "Join" not in plan and "lead_time_hours(" not in plan


def test_suppliers_over_many_buckets(spark, monkeypatch):
    """Numbers far apart: several buckets a cell, a supplier in several cells once."""
    docs = [doc(i, i, total=1.0, sup=str(i % 40), sup_city=1 + i % 3, pid=i % 5) for i in range(200)]
    tasks = [task(i, ts(2024, 1, 1), ts(2024, 1, 1 + i % 3), 12, 120, i % 5) for i in range(30)]
    model = build_model(spark, tax_documents=docs, tasks=tasks)
    far = spark.range(40).select(F.col("id").cast("string").alias("supplier_cnpj"), (F.col("id") * 30_011).alias("supplier_no"))
    monkeypatch.setattr(cube, "numbered_suppliers", lambda documents: far)
    cells = KpiCube.build(model)
    assert cells.sets.select("bucket").distinct().count() > 30
    assert values(cells.kpis()) == values(metrics.kpis(apply_filters(build_fact(model), FilterSpec())))


def test_nothing(spark):
    cells = KpiCube.build(build_model(spark))
    assert values(cells.kpis()) == [(0.0, 0, None, 0)]
    assert values(cells.suppliers(by=["supplier_state"])) == []


def test_documents_and_tasks_meet_once(crowded, monkeypatch):  # noqa: F811
    """Sums, sets and numbers are made of one stored table."""
    plans = []
    kept = cube.materialize
    monkeypatch.setattr(cube, "materialize", lambda df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, *more))
    KpiCube.build(crowded)
    assert [cube.PROCESS in plan for plan in plans] == [True] + [False] * (len(plans) - 1) and len(plans) == 6
