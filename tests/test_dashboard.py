"""The stored-fact dashboard flow gives the same answers as the lazy plans."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import os

import pytest

from fiscalflow.operators import metrics
from conftest import build_model, doc, task, ts
from fiscalflow.operators.dashboard import Dashboard
from fiscalflow.operators.fact import build_fact
from fiscalflow.operators.filters import FilterSpec, apply_filters
from fiscalflow.sources.tpch import model_from_tpch

SF = "/root/testdata/sf0.001"
SPEC = FilterSpec(period=(dt.date(1999, 2, 1), dt.date(2000, 5, 31)),
                  types=["MaterialInvoice", "ServiceInvoice"])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_stored_dashboard_matches_lazy(spark):
    model = model_from_tpch(spark, SF)
    dash = Dashboard.refresh(model, name="test_dashboard_fact")
    lazy = apply_filters(build_fact(model), SPEC)
    assert rows(dash.select(SPEC)) == rows(lazy)
    panels = dash.panels(SPEC)
    assert rows(panels["kpis"]) == rows(metrics.kpis(lazy))
    assert rows(panels["geo_rollup_share"]) == rows(metrics.geo_rollup_share(lazy))
    assert rows(panels["lead_time_hist"]) == rows(metrics.lead_time_histogram(lazy))
    plan = dash.select(SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(posted_month" in plan


def _model(spark, docs, tasks):
    return build_model(spark, tax_documents=docs, tasks=tasks)


def test_changed_processes_only(spark):
    """After each change the dashboard equals a full rebuild; months without changed rows
    keep their files, a month left without rows goes."""
    docs = [doc(i, i, "MaterialInvoice", 10.0 * i, str(i), "2", 1 + i % 3, 1, 100 + i) for i in range(1, 7)]
    tasks = [task(i, ts(2024, 1, 1), ts(2024, 1 + i % 4, 9), 12, 120, 101 + i % 6) for i in range(12)]
    tasks.append(task(50, None, None, 12, 120, 103))
    model = _model(spark, docs, tasks)
    dash = Dashboard.refresh(model, name="changed_fact")

    def files():
        return {f: os.stat(f).st_mtime_ns for f in (x.removeprefix("file:") for x in dash.fact.inputFiles())}

    def months(found):
        return {m for m in ("2024-01", "2024-02", "2024-03", "2024-04", "__HIVE_DEFAULT_PARTITION__") if any(f"={m}/" in f for f in found)}

    assert len(months(files())) == 5
    steps = [
        # a document's value, a new task in May, a task without completion
        ({"docs": [(*docs[0][:3], 99.5, *docs[0][4:]), *docs[1:]], "tasks": [*tasks, task(60, ts(2024, 5, 1), ts(2024, 5, 2), 13, 130, 101)]}, [101]),
        # all tasks of April go, process 103 loses its open task, an unknown process
        ({"docs": docs, "tasks": [t for t in tasks if t[0] not in (3, 7, 11, 50)]}, [101, 103, 102, 104, 106, 999, None]),
        ({"docs": [], "tasks": tasks}, [101 + i for i in range(6)]),
    ]
    for step, changed in steps:
        before = files()
        model = _model(spark, **step) if step["docs"] else build_model(spark, tasks=tasks)
        dash = dash.refresh_changed(model, spark.createDataFrame([(c,) for c in changed], "process_instance_id long"))
        full = Dashboard.refresh(model, name="full_fact")
        assert sorted(map(str, dash.fact.collect())) == sorted(map(str, full.fact.collect()))
        assert dash.fact.columns == full.fact.columns
        if changed == [101]:
            same = {f for f, t in files().items() if before.get(f) == t}
            touched = {f"2024-{1 + i % 4:02d}" for i in range(12) if 101 + i % 6 == 101} | {"2024-05"}
            assert months(same) == {"2024-01", "2024-02", "2024-03", "2024-04", "__HIVE_DEFAULT_PARTITION__"} - touched
        if 999 in changed:
            assert "2024-04" not in months(files())
    assert dash.fact.count() == 0 and dash.panels(SPEC)["kpis"].first()["documents"] == 0
