"""The monthly posting report.

Material invoices whose posting task (definition 12) succeeded (status 120) with a
completion in the calendar month before ``as_of``; supplier and customer cities must
be known; purchase orders of the document's items are listed once each, sorted,
joined with ', ' (null when the document has no purchase order). The grain is
document x completion instant; newest first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalflow import schemas
from fiscalflow.functions.dates import format_ddmmyyyy, previous_month_window
from fiscalflow.operators.fact import docs_tasks_join
from fiscalflow.operators.store import materialize
from fiscalflow.sources.model import Model

REPORT_COLUMNS = [
    "id",
    "number",
    "purchase_orders",
    "supplier_id",
    "supplier_city",
    "customer_id",
    "customer_city",
    "posted_on",
]

PO_SEPARATOR = ", "


def sorted_list(values: Column) -> Column:
    """Aggregate: the non-null values, sorted, joined by ', '; null when there are
    none."""
    s = F.collect_list(values)
    return F.when(F.size(s) > 0, F.array_join(F.array_sort(s), PO_SEPARATOR))


def po_rollup(items: DataFrame, key: str = "tax_document_id") -> DataFrame:
    """Per document: its distinct purchase orders as one sorted string.

    (document, order) pairs are made distinct by a hash aggregate, map-side first, and
    only then listed: a list holds each order once, however many items name it."""
    pairs = items.select(key, "purchase_order").distinct()
    return pairs.groupBy(key).agg(sorted_list(F.col("purchase_order")).alias("purchase_orders"))


def posting_tasks(model: Model, window: tuple[Column, Column] | None = None) -> DataFrame:
    """Successful posting tasks, optionally with completion inside [lo, hi)."""
    tasks = model.tasks if window is None else model.tasks_between(*window)
    return tasks.filter(
        (F.col("task_definition_id") == schemas.POSTING_TASK_ID)
        & (F.col("status_id") == schemas.POSTING_SUCCESS_STATUS_ID)
    )


def success_postings(model: Model, window: tuple[Column, Column] | None = None) -> DataFrame:
    """Material invoices joined with their successful posting tasks
    (the report's equality filters, no date window unless one is given)."""
    docs = model.tax_documents.filter(F.col("type") == schemas.REPORT_DOCUMENT_TYPE)
    tasks = posting_tasks(model, window).select(
        "process_instance_id", F.col("id").alias("task_id"), "completed_at"
    )
    return docs_tasks_join(model, docs, tasks).select(
        F.col("id"), "task_id", "process_instance_id", "completed_at"
    )


def report_keys(model: Model, as_of: dt.date | str | Column) -> DataFrame:
    """The report rows without purchase orders: one row per document x completion.

    The distinct does not carry ``process_instance_id``: an aggregate that relied on the
    join's partitioning would keep AQE from splitting a hot process (unless a setting
    forces it). It shuffles the report's rows, one month of postings, once more.
    """
    window = previous_month_window(as_of)
    docs = model.tax_documents.filter(F.col("type") == schemas.REPORT_DOCUMENT_TYPE).select(
        "process_instance_id",
        "id",
        "number",
        F.col("supplier_identification_number").alias("supplier_id"),
        F.col("customer_identification_number").alias("customer_id"),
        "supplier_city_id",
        "customer_city_id",
    )
    tasks = posting_tasks(model, window).select("process_instance_id", "completed_at")
    supplier_city = model.cities.select(
        F.col("id").alias("supplier_city_id"), F.col("name").alias("supplier_city")
    )
    customer_city = model.cities.select(
        F.col("id").alias("customer_city_id"), F.col("name").alias("customer_city")
    )
    return (
        docs_tasks_join(model, docs, tasks)
        .join(supplier_city, "supplier_city_id", "inner")
        .join(customer_city, "customer_city_id", "inner")
        .select(
            "id",
            "number",
            "supplier_id",
            "supplier_city",
            "customer_id",
            "customer_city",
            "completed_at",
        )
        .distinct()
    )


def report_last_month(
    model: Model,
    as_of: dt.date | str | Column,
    one_row_per_document: bool = False,
    materialize_keys: bool = False,
) -> DataFrame:
    """The posting report for the month before ``as_of`` (sorted newest first).

    Items are aggregated before they meet the report rows: they are first reduced
    to the report's documents (a semi join whose small side AQE broadcasts when it
    is small), then rolled up per document, then left-joined. This avoids the
    items x tasks product of the direct SQL form and its second distinct shuffle.

    ``one_row_per_document`` keeps only the latest completion of each document.

    ``materialize_keys`` runs the report as a two-phase batch job: the report rows
    (one month of postings - small next to the items) are first written to the
    shared folder. Their measured size then lets the planner broadcast them into the
    items scan, so items are filtered map-side instead of shuffled whole; lineage
    is cut at the written table.
    """
    keys = report_keys(model, as_of)
    if one_row_per_document:
        keys = keys.groupBy(
            "id", "number", "supplier_id", "supplier_city", "customer_id", "customer_city",
        ).agg(F.max("completed_at").alias("completed_at"))
    if materialize_keys:
        keys = materialize(keys, f"report_keys_{_as_of_tag(as_of)}")
    report_docs = keys.select(F.col("id").alias("tax_document_id"))
    items = model.items.select("tax_document_id", "purchase_order").join(
        report_docs, "tax_document_id", "left_semi"
    )
    pos = po_rollup(items)
    return (
        keys.join(pos, keys["id"] == pos["tax_document_id"], "left")
        .orderBy(F.col("completed_at").desc(), F.col("id").asc())
        .select(
            "id",
            "number",
            "purchase_orders",
            "supplier_id",
            "supplier_city",
            "customer_id",
            "customer_city",
            format_ddmmyyyy("completed_at").alias("posted_on"),
        )
    )


def _as_of_tag(as_of) -> str:
    if isinstance(as_of, Column):
        return "expr"
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return f"{as_of:%Y%m%d}"
