"""Fact, filters, facets and period bounds."""

from __future__ import annotations

import datetime as dt

from conftest import build_model, doc, task, ts

from fiscalflow.operators.fact import FACT_COLUMNS, build_fact
from fiscalflow.operators.filters import (
    FilterSpec,
    apply_filters,
    facets,
    filter_members,
    period_bounds,
)
from fiscalflow.operators.metrics import kpis


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_seed_fact_and_default_filters(seed):
    fact = build_fact(seed)
    assert fact.columns == FACT_COLUMNS
    assert fact.count() == 5  # left joins keep 43-45 with null geography
    filtered = apply_filters(fact, FilterSpec())
    assert sorted(r["id"] for r in rows(filtered)) == [41, 42]
    k = rows(kpis(filtered))[0]
    assert k == {
        "spend": 728.5, "documents": 2,
        "mean_lead_time_hours": 0.0, "suppliers": 2,
    }


def _model(spark, docs, tasks, cities=None):
    kw = dict(tax_documents=docs, tasks=tasks)
    if cities is not None:
        kw["cities"] = cities
    return build_model(spark, **kw)


def test_customer_city_null_is_kept_in_fact(spark):
    m = _model(spark, [doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 1, None, 100)],
               [task(1, ts(2024, 2, 1), ts(2024, 2, 2), 12, 120, 100)])
    assert [r["supplier_city"] for r in rows(build_fact(m))] == ["Lagoa Clara"]


def test_city_without_state(spark):
    m = _model(
        spark,
        [doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 7, 1, 100)],
        [task(1, ts(2024, 2, 1), ts(2024, 2, 2), 12, 120, 100)],
        cities=[(7, "Nowhere", None)],
    )
    fact = build_fact(m)
    assert [(r["supplier_city"], r["supplier_state"]) for r in rows(fact)] == [("Nowhere", None)]
    assert apply_filters(fact, FilterSpec()).count() == 0


def test_null_type_kept_by_default_and_by_none_in_list(spark):
    m = _model(spark, [doc(1, 1, None, 1.0, "1", "2", 1, 1, 100)],
               [task(1, ts(2024, 2, 1), ts(2024, 2, 2), 12, 120, 100)])
    fact = build_fact(m)
    assert apply_filters(fact, FilterSpec()).count() == 1
    assert apply_filters(fact, FilterSpec(types=["MaterialInvoice"])).count() == 0
    assert apply_filters(fact, FilterSpec(types=["MaterialInvoice", None])).count() == 1


def test_empty_selection_keeps_nothing(seed):
    fact = build_fact(seed)
    for spec in (FilterSpec(types=[]), FilterSpec(tasks=[]), FilterSpec(statuses=[]),
                 FilterSpec(states=[])):
        assert apply_filters(fact, spec).count() == 0
        assert filter_members(fact, spec).count() == 0


def test_null_completion_in_fact_dropped_by_period(spark):
    m = _model(spark, [doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 1, 1, 100)],
               [task(1, ts(2024, 2, 1), None, 12, 120, 100),
                task(2, ts(2024, 2, 1), ts(2024, 2, 3), 12, 120, 100)])
    fact = build_fact(m)
    assert fact.count() == 2
    assert apply_filters(fact, FilterSpec()).count() == 1
    b = rows(period_bounds(fact))[0]
    assert b == {"first_day": dt.date(2024, 2, 3), "last_day": dt.date(2024, 2, 3)}


def test_period_is_inclusive_by_day(spark):
    m = _model(spark, [doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 1, 1, 100)],
               [task(1, None, ts(2024, 2, 1, 0, 0), 12, 120, 100),
                task(2, None, ts(2024, 2, 29, 23, 59), 12, 120, 100),
                task(3, None, ts(2024, 3, 1, 0, 0), 12, 120, 100)])
    fact = build_fact(m)
    spec = FilterSpec(period=(dt.date(2024, 2, 1), dt.date(2024, 2, 29)))
    assert apply_filters(fact, spec).count() == 2
    assert apply_filters(fact, FilterSpec(period=(None, dt.date(2024, 2, 1)))).count() == 1
    assert apply_filters(fact, FilterSpec(period=(dt.date(2024, 3, 1), None))).count() == 1


def test_facets_keep_null_except_state(spark):
    m = _model(
        spark,
        [doc(1, 1, None, 1.0, "1", "2", 7, 1, 100), doc(2, 1, "ServiceInvoice", 1.0, "1", "2", 1, 1, 101)],
        [task(1, None, ts(2024, 2, 1), 12, 120, 100), task(2, None, ts(2024, 2, 1), 13, 130, 101)],
        cities=[(7, "Nowhere", None), (1, "Lagoa Clara", 1)],
    )
    got = {(r["facet"], r["value"]) for r in rows(facets(build_fact(m)))}
    assert ("document_type", None) in got
    assert ("supplier_state", None) not in got
    assert ("supplier_state", "Serra") in got
    assert ("task_name", "Pagamento da Nota") in got
    assert ("task_status", "Nota Paga") in got


def test_unknown_code_drops_task_from_fact(spark):
    m = _model(spark, [doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 1, 1, 100)],
               [task(1, None, ts(2024, 2, 1), 99, 120, 100),
                task(2, None, ts(2024, 2, 1), 12, None, 100)])
    assert build_fact(m).count() == 0


def test_display_order_nulls_last(spark):
    from fiscalflow.operators.fact import display_order

    m = _model(spark, [doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 1, 1, 100)],
               [task(1, None, None, 12, 120, 100),
                task(2, None, ts(2024, 2, 3), 12, 120, 100),
                task(3, None, ts(2024, 2, 1), 12, 120, 100)])
    got = [r["completed_at"] for r in rows(display_order(build_fact(m)))]
    assert got == [ts(2024, 2, 1), ts(2024, 2, 3), None]


def test_report_sql_matches_dataframe_form(seed_unconfounded, spark):
    from conftest import AS_OF

    from fiscalflow.operators.report import report_last_month
    from fiscalflow.operators.report_sql import report_last_month_sql

    a = [tuple(r) for r in report_last_month(seed_unconfounded, AS_OF).collect()]
    b = [tuple(r) for r in report_last_month_sql(spark, seed_unconfounded, AS_OF).collect()]
    assert a == b


def test_period_bounds_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        m = _model(spark, [doc(1, 1, "MaterialInvoice", 1.0, "1", "2", 1, 1, 100)],
                   [task(1, None, ts(2024, 2, 1, 0, 0), 12, 120, 100),
                    task(2, None, ts(2024, 2, 29, 23, 30), 12, 120, 100),
                    task(3, None, ts(2024, 3, 1, 0, 0), 12, 120, 100)])
        spec = FilterSpec(period=(dt.date(2024, 2, 1), dt.date(2024, 2, 29)))
        assert apply_filters(build_fact(m), spec).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
