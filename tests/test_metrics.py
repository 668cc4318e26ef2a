"""KPIs and panels, with the properties of SURVEY 5.2."""

from __future__ import annotations

import pytest
from conftest import build_model, doc, task, ts

from fiscalflow.operators.fact import build_fact
from fiscalflow.operators.filters import FilterSpec, apply_filters
from fiscalflow.operators.labels import kpi_labels
from fiscalflow.operators.metrics import (
    daily_volume,
    geo_rollup_share,
    geo_volume,
    kpis,
    lead_time_histogram,
    lead_time_summary,
    spend_by_supplier,
    supplier_pareto,
)


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture()
def fact(spark):
    cities = [(1, "Lagoa Clara", 1), (2, "Vista Longa", 1), (3, "Porto Novo", 2),
              (4, "Nowhere", None)]
    docs, tasks = [], []
    for i in range(1, 41):
        sup = None if i % 9 == 0 else str(1000 + i % 12)
        total = None if i % 7 == 0 else float(i * 10)
        docs.append(doc(i, i, "MaterialInvoice", total, sup, "9", 1 + i % 4, 1, 1000 + i))
        created = None if i % 11 == 0 else ts(2024, 2, 1 + i % 20)
        tasks.append(task(i, created, ts(2024, 2, 1 + i % 20, i % 24), 12, 120, 1000 + i))
    return build_fact(build_model(spark, tax_documents=docs, tasks=tasks, cities=cities))


def test_kpis_against_python(fact):
    data = rows(fact)
    k = rows(kpis(fact))[0]
    assert k["documents"] == len(data)
    assert k["spend"] == pytest.approx(sum(r["total_value"] or 0 for r in data))
    leads = [r["lead_time_hours"] for r in data if r["lead_time_hours"] is not None]
    assert k["mean_lead_time_hours"] == pytest.approx(sum(leads) / len(leads))
    assert k["suppliers"] == len({r["supplier_cnpj"] for r in data if r["supplier_cnpj"]})


def test_spend_zero_when_all_null(spark):
    m = build_model(spark, tax_documents=[doc(1, 1, "MaterialInvoice", None, "1", "2", 1, 1, 100)],
                    tasks=[task(1, None, ts(2024, 2, 1), 12, 120, 100)])
    f = build_fact(m)
    assert rows(spend_by_supplier(f)) == [{"supplier_cnpj_masked": "00.000.000/0000-01", "spend": 0.0}]
    assert rows(kpis(f))[0]["spend"] == 0.0
    empty = apply_filters(f, FilterSpec(types=[]))
    k = rows(kpis(empty))[0]
    assert k["spend"] == 0.0 and k["documents"] == 0 and k["mean_lead_time_hours"] is None


def test_pareto_is_top_of_spend(fact):
    full = sorted(rows(spend_by_supplier(fact)), key=lambda r: (-r["spend"], r["supplier_cnpj_masked"]))
    top = rows(supplier_pareto(fact, 10))
    assert top == full[:10]
    assert "" in {r["supplier_cnpj_masked"] for r in full}  # documents without supplier


def test_geo_sum_equals_rows_with_geography(fact):
    total = sum(r["volume"] for r in rows(geo_volume(fact)))
    data = rows(fact)
    assert total == sum(1 for r in data if r["supplier_state"] and r["supplier_city"])


def test_rollup_total_is_sum_of_leaves(fact):
    out = rows(geo_rollup_share(fact))
    leaves = [r for r in out if r["level"] == "city"]
    states = [r for r in out if r["level"] == "state"]
    (total,) = [r for r in out if r["level"] == "total"]
    assert total["volume"] == sum(r["volume"] for r in leaves)
    for s in states:
        assert s["volume"] == sum(r["volume"] for r in leaves if r["supplier_state"] == s["supplier_state"])
    assert total["share"] == 1.0
    assert sum(r["share"] for r in leaves) == pytest.approx(1.0)


def test_histogram_bins_cover_measured_rows(fact):
    hist = rows(lead_time_histogram(fact))
    summary = rows(lead_time_summary(fact))[0]
    assert sum(r["documents"] for r in hist) == summary["measured"]
    assert 1 <= len(hist) <= 20
    assert all(0 <= r["bin"] <= 19 for r in hist)
    assert min(r["bin_lo"] for r in hist) == summary["lead_time_min"]
    assert max(r["bin_hi"] for r in hist) == pytest.approx(summary["lead_time_max"])


def test_histogram_single_bin_when_all_equal(spark):
    m = build_model(
        spark,
        tax_documents=[doc(i, i, "MaterialInvoice", 1.0, "1", "2", 1, 1, 100 + i) for i in range(5)],
        tasks=[task(i, ts(2024, 2, 1), ts(2024, 2, 1, 5), 12, 120, 100 + i) for i in range(5)],
    )
    hist = rows(lead_time_histogram(build_fact(m)))
    assert hist == [{"bin": 0, "bin_lo": 5.0, "bin_hi": 5.0, "documents": 5}]


def test_daily_volume_sorted_no_gaps_filled(fact):
    out = rows(daily_volume(fact))
    days = [r["posted_on"] for r in out]
    assert days == sorted(days)
    assert sum(r["documents"] for r in out) == fact.filter("posted_on is not null").count()


def test_kpi_labels_follow_python_format(spark):
    df = spark.createDataFrame([(1234567.891, 3.25)], "spend double, mean_lead_time_hours double")
    r = rows(kpi_labels(df))[0]
    assert r["spend_label"] == f"R$ {1234567.891:,.2f}"
    assert r["lead_time_label"] == f"{3.25:.1f} h" == "3.2 h"


def test_grouping_sets_panels_equal_separate_panels(fact):
    from fiscalflow.operators.metrics import panel_aggregates

    out = rows(panel_aggregates(fact))
    sup = {r["supplier_cnpj_masked"]: r["spend"] for r in out if r["panel"] == "supplier"}
    assert sup == {r["supplier_cnpj_masked"]: r["spend"] for r in rows(spend_by_supplier(fact))}
    geo = {(r["supplier_state"], r["supplier_city"]): r["volume"] for r in out if r["panel"] == "geo"}
    assert geo == {(r["supplier_state"], r["supplier_city"]): r["volume"] for r in rows(geo_volume(fact))}
    daily = {r["posted_on"]: r["documents"] for r in out if r["panel"] == "daily"}
    assert daily == {r["posted_on"]: r["documents"] for r in rows(daily_volume(fact))}
    plan = panel_aggregates(fact)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan
