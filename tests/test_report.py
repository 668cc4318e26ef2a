"""The monthly posting report over the seed scenarios and FIXTURES edge cases."""

from __future__ import annotations

import datetime as dt

from conftest import AS_OF, M1, build_model, doc, item, seed_rows, task, ts

from fiscalflow.functions.dates import previous_month_window
from fiscalflow.operators.report import REPORT_COLUMNS, report_last_month
from plain_report import plain_report


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_seed_report(seed):
    out = report_last_month(seed, AS_OF)
    assert out.columns == REPORT_COLUMNS
    got = rows(out)
    day = M1.strftime("%d/%m/%Y")
    assert sorted(got) == [
        (41, 7301, "W-30", "4070001", "Lagoa Clara", "63000000000017", "Vista Longa", day),
        (42, 7302, "W-31, W-8", "815500090001", "Porto Novo", "63000000000017", "Lagoa Clara", day),
    ]


def test_negative_scenarios_excluded_by_their_own_filter(seed_unconfounded):
    ids = {r[0] for r in rows(report_last_month(seed_unconfounded, AS_OF))}
    assert ids == {41, 42}  # 43 date, 44 type, 45 status - cities are set


def test_report_equals_plain_python(seed_unconfounded):
    got = rows(report_last_month(seed_unconfounded, AS_OF))
    assert sorted(got) == plain_report(seed_unconfounded, AS_OF)


def test_window_bounds(spark):
    for as_of, lo, hi in ((dt.date(2024, 3, 31), ts(2024, 2, 1), ts(2024, 3, 1)), ("2024-01-15", ts(2023, 12, 1), ts(2024, 1, 1))):
        assert tuple(spark.range(1).select(*previous_month_window(as_of)).first()) == (lo, hi)


def _one_doc_model(spark, tasks, items=None, sup_city=1, cust_city=2):
    return build_model(
        spark,
        tax_documents=[doc(1, 10, "MaterialInvoice", 5.0, "1", "2", sup_city, cust_city, 100)],
        tasks=tasks,
        items=items if items is not None else [item(1, "PO-1", 1)],
    )


def test_window_edges_half_open(spark):
    as_of = dt.date(2024, 3, 31)
    m = _one_doc_model(spark, [
        task(1, None, ts(2024, 2, 1), 12, 120, 100),     # first instant: in
        task(2, None, ts(2024, 3, 1), 12, 120, 100),     # next month: out
        task(3, None, ts(2024, 1, 31, 23, 59), 12, 120, 100),  # before: out
    ])
    got = rows(report_last_month(m, as_of))
    assert [r[-1] for r in got] == ["01/02/2024"]


def test_grain_is_document_by_completion(spark):
    as_of = dt.date(2024, 3, 31)
    two_instants = _one_doc_model(spark, [
        task(1, None, ts(2024, 2, 3, 10), 12, 120, 100),
        task(2, None, ts(2024, 2, 5, 10), 12, 120, 100),
    ])
    assert len(rows(report_last_month(two_instants, as_of))) == 2
    assert len(rows(report_last_month(two_instants, as_of, one_row_per_document=True))) == 1
    same_instant = _one_doc_model(spark, [
        task(1, None, ts(2024, 2, 3, 10), 12, 120, 100),
        task(2, None, ts(2024, 2, 3, 10), 12, 120, 100),
    ])
    assert len(rows(report_last_month(same_instant, as_of))) == 1


def test_two_documents_on_one_process(spark):
    m = build_model(
        spark,
        tax_documents=[
            doc(1, 10, "MaterialInvoice", 1.0, "1", "2", 1, 2, 100),
            doc(2, 20, "MaterialInvoice", 1.0, "1", "2", 1, 2, 100),
        ],
        tasks=[task(1, None, ts(2024, 2, 3), 12, 120, 100)],
    )
    assert {r[0] for r in rows(report_last_month(m, dt.date(2024, 3, 31)))} == {1, 2}


def test_purchase_order_rollup_edges(spark):
    as_of = dt.date(2024, 3, 31)
    done = [task(1, None, ts(2024, 2, 3), 12, 120, 100)]
    cases = {
        "same PO twice": ([item(1, "PO-B", 1), item(2, "PO-A", 1), item(3, "PO-B", 1)], "PO-A, PO-B"),
        "null among others": ([item(1, None, 1), item(2, "PO-A", 1)], "PO-A"),
        "all null": ([item(1, None, 1), item(2, None, 1)], None),
        "no items": ([], None),
    }
    for name, (its, expected) in cases.items():
        got = rows(report_last_month(_one_doc_model(spark, done, its), as_of))
        assert [r[2] for r in got] == [expected], name


def test_unknown_city_drops_row_from_report(spark):
    done = [task(1, None, ts(2024, 2, 3), 12, 120, 100)]
    m = _one_doc_model(spark, done, cust_city=None)
    assert rows(report_last_month(m, dt.date(2024, 3, 31))) == []
    m = _one_doc_model(spark, done, cust_city=99)  # dangling city id
    assert rows(report_last_month(m, dt.date(2024, 3, 31))) == []


def test_sorted_newest_first(spark):
    m = build_model(
        spark,
        tax_documents=[doc(i, i, "MaterialInvoice", 1.0, "1", "2", 1, 2, 100 + i) for i in range(1, 4)],
        tasks=[
            task(1, None, ts(2024, 2, 3), 12, 120, 101),
            task(2, None, ts(2024, 2, 9), 12, 120, 102),
            task(3, None, ts(2024, 2, 6), 12, 120, 103),
        ],
    )
    assert [r[0] for r in rows(report_last_month(m, dt.date(2024, 3, 31)))] == [2, 3, 1]


def test_seed_dates_follow_as_of(seed):
    # the same data a year later has nothing in the window
    assert rows(report_last_month(seed, dt.date(2025, 3, 15))) == []
    assert seed_rows()  # fixture rows are plain data
    assert M1 == ts(2024, 2, 15)


def test_materialized_keys_same_result(seed_unconfounded):
    a = rows(report_last_month(seed_unconfounded, AS_OF))
    b = rows(report_last_month(seed_unconfounded, AS_OF, materialize_keys=True))
    assert a == b
