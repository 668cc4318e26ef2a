"""The named queries: ``(spark, sf_dir) -> DataFrame`` over the driver's tables.

Every query maps the driver's tables onto the invoice model (lazily, in the same
plan) and runs one operator of the library over the whole tables with fixed
parameters, so results are reproducible and comparable with
``fiscalflow.plans.oracle``. Exports write under the session's shared folder and
return what they wrote, read back.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
import zlib
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fiscalflow import schemas
from fiscalflow.functions import cnpj, dates, keys, money
from fiscalflow.operators import audit, export, filters, labels, load, metrics
from fiscalflow.operators import report as rep
from fiscalflow.operators.report_sql import report_last_month_sql
from fiscalflow.operators.clustered_fact import ClusteredFact
from fiscalflow.operators.cube import KpiCube
from fiscalflow.operators.delta_audit import DeltaAudit
from fiscalflow.operators.fact import build_fact, display_order, docs_tasks_join
from fiscalflow.operators.factorised import FactorisedPanels
from fiscalflow.operators.filters import FilterSpec
from fiscalflow.operators.order_lists import po_rollup_streamed as streamed_lists
from fiscalflow.operators.process_buckets import ProcessBuckets
from fiscalflow.session import shared_dir
from fiscalflow.sources.tpch import model_from_tpch, read_source

# ---------------------------------------------------------------------------
# Fixed parameters of the catalog (the oracle SQL states the same values).
# ---------------------------------------------------------------------------
AS_OF = dt.date(2000, 3, 31)  # report window [2000-02-01, 2000-03-01)
PERIOD = (dt.date(2000, 2, 1), dt.date(2000, 5, 31))
DASHBOARD = FilterSpec(period=PERIOD, types=schemas.DOCUMENT_TYPES[:2])
_TASK, _STATUS = dict(schemas.TASK_DEFINITION_ROWS), dict(schemas.STATUS_ROWS)
MEMBERS = FilterSpec(
    types=[schemas.REPORT_DOCUMENT_TYPE, None],
    tasks=[_TASK[12], _TASK[13]],
    statuses=[_STATUS[120], _STATUS[121], _STATUS[130]],
    states=["AMERICA", "EUROPE", None],
)
EXPORT_STAMP = dt.datetime(2000, 3, 31, 18, 30)
# insert-if-absent: documents of finished orders are already loaded; a batch of
# candidate documents arrives with one row per order line (line 7 carries no key).
LOADED_ORDER_STATUS = "F"
KEYLESS_LINE_NUMBER = 7
LOAD_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]

Query = Callable[[SparkSession, str], DataFrame]


def _model(spark, sf_dir):
    """The mapped model of ``sf_dir``: lazy DataFrames, made anew for every query, so
    that a rewritten folder is read as it is now."""
    return model_from_tpch(spark, sf_dir)


def _fact(spark, sf_dir):
    return build_fact(_model(spark, sf_dir))


def _panel_fact(spark, sf_dir):
    """The fact under the dashboard's default selection: everything its facets offer."""
    return filters.apply_filters(_fact(spark, sf_dir), FilterSpec())


def _dashboard(spark, sf_dir):
    """The fact under an explicit selection of period and types."""
    return filters.apply_filters(_fact(spark, sf_dir), DASHBOARD)


# --- report (P1-P3, J1-J4, A1, A2, O1, F1-F4) -------------------------------

def report_last_month(spark, sf_dir):
    return rep.report_last_month(_model(spark, sf_dir), AS_OF)


def report_one_per_document(spark, sf_dir):
    return rep.report_last_month(_model(spark, sf_dir), AS_OF, one_row_per_document=True)


def report_sql(spark, sf_dir):
    return report_last_month_sql(spark, _model(spark, sf_dir), AS_OF)


def success_postings(spark, sf_dir):
    return rep.success_postings(_model(spark, sf_dir))


def last_month_window(spark, sf_dir):
    lo, hi = dates.previous_month_window(AS_OF)
    tasks = _model(spark, sf_dir).tasks
    return tasks.filter((F.col("completed_at") >= lo) & (F.col("completed_at") < hi)).select(
        "id", "process_instance_id", "completed_at"
    )


def docs_tasks(spark, sf_dir):
    m = _model(spark, sf_dir)
    return docs_tasks_join(
        m,
        m.tax_documents.select("process_instance_id", "id"),
        m.tasks.select("process_instance_id", F.col("id").alias("task_id")),
    ).select("id", "task_id")


def po_rollup(spark, sf_dir):
    return rep.po_rollup(_model(spark, sf_dir).items)


def _package_for_workers(spark):
    """Puts the folder of this package on the import path of the Python workers too (on a
    cluster without a shared file system the package goes along with --py-files)."""
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    given = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x and x != here]
    env["PYTHONPATH"] = os.pathsep.join([here, *given])


def po_rollup_streamed(spark, sf_dir):
    _package_for_workers(spark)
    return streamed_lists(_model(spark, sf_dir).items)


# --- fact, filters, facets (P4-P7, J5-J8, A13, A14) --------------------------

def fact(spark, sf_dir):
    return _fact(spark, sf_dir)


def fact_bucketed(spark, sf_dir):
    """The fact from stored tables bucketed by process."""
    return ProcessBuckets.store(_model(spark, sf_dir), buckets=16).fact()


def fact_clustered(spark, sf_dir):
    """The explicit selection from the fact stored by its interleaved key."""
    return ClusteredFact.store(_fact(spark, sf_dir)).select(DASHBOARD)


def fact_display(spark, sf_dir):
    """The fact in display order."""
    ordered = display_order(_fact(spark, sf_dir))
    return ordered.select("id", "completed_at", "task_name")


def filter_period(spark, sf_dir):
    return filters.filter_period(_fact(spark, sf_dir), *PERIOD)


def filter_members(spark, sf_dir):
    return filters.filter_members(_fact(spark, sf_dir), MEMBERS)


def filtered_fact(spark, sf_dir):
    return _dashboard(spark, sf_dir)


def facet_state(spark, sf_dir):
    return filters.facet_values(_fact(spark, sf_dir), "supplier_state", drop_null=True)


def facets(spark, sf_dir):
    return filters.facets(_fact(spark, sf_dir))


def period_bounds(spark, sf_dir):
    return filters.period_bounds(_fact(spark, sf_dir))


# --- KPIs and panels (A3-A12, O3) --------------------------------------------

def kpis(spark, sf_dir):
    return metrics.kpis(_panel_fact(spark, sf_dir))


def distinct_documents(spark, sf_dir):
    return metrics.distinct_documents(_panel_fact(spark, sf_dir))


def kpi_labels(spark, sf_dir):
    return labels.kpi_labels(metrics.kpis(_panel_fact(spark, sf_dir)))


def spend_by_supplier(spark, sf_dir):
    return metrics.spend_by_supplier(_panel_fact(spark, sf_dir))


def supplier_pareto_top10(spark, sf_dir):
    return metrics.supplier_pareto(_panel_fact(spark, sf_dir), 10)


def geo_volume(spark, sf_dir):
    return metrics.geo_volume(_panel_fact(spark, sf_dir))


def geo_rollup_share(spark, sf_dir):
    return metrics.geo_rollup_share(_panel_fact(spark, sf_dir))


def panel_grouping_sets(spark, sf_dir):
    return metrics.panel_aggregates(_panel_fact(spark, sf_dir))


def daily_volume(spark, sf_dir):
    return metrics.daily_volume(_panel_fact(spark, sf_dir))


def lead_time_hist(spark, sf_dir):
    return metrics.lead_time_histogram(_panel_fact(spark, sf_dir))


def lead_time_hist_mean(spark, sf_dir):
    return metrics.lead_time_summary(_panel_fact(spark, sf_dir))


# --- the same from per-process aggregates -------------------------------------

def _factorised(spark, sf_dir):
    return FactorisedPanels(_model(spark, sf_dir))


def factorised_kpis(spark, sf_dir):
    return _factorised(spark, sf_dir).kpis()


def factorised_documents(spark, sf_dir):
    return _factorised(spark, sf_dir).distinct_documents()


def factorised_spend(spark, sf_dir):
    return _factorised(spark, sf_dir).spend_by_supplier()


def factorised_pareto(spark, sf_dir):
    return _factorised(spark, sf_dir).supplier_pareto(10)


def factorised_geo_volume(spark, sf_dir):
    return _factorised(spark, sf_dir).geo_volume()


def factorised_geo_rollup(spark, sf_dir):
    return _factorised(spark, sf_dir).geo_rollup_share()


def factorised_daily_volume(spark, sf_dir):
    return _factorised(spark, sf_dir).daily_volume()


def factorised_lead_time_hist(spark, sf_dir):
    return _factorised(spark, sf_dir).lead_time_histogram()


def factorised_lead_time_mean(spark, sf_dir):
    return _factorised(spark, sf_dir).lead_time_summary()


# --- the same from a stored cube ----------------------------------------------

def cube_kpis(spark, sf_dir):
    return KpiCube.build(_model(spark, sf_dir)).kpis()


def cube_suppliers(spark, sf_dir):
    """Distinct suppliers per state and document type, under the explicit selection."""
    return KpiCube.build(_model(spark, sf_dir)).suppliers(DASHBOARD, ["supplier_state", "document_type"])


# --- loading and audits (S5, C1-C3, P9) --------------------------------------

def _loaded_and_incoming(spark, sf_dir):
    orders = read_source(spark, sf_dir, "orders")
    lineitem = read_source(spark, sf_dir, "lineitem")
    target = orders.filter(F.col("o_orderstatus") == LOADED_ORDER_STATUS).select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") + 10000).alias("number"),
        F.col("o_totalprice").alias("total_value"),
    )
    incoming = lineitem.select(
        F.when(F.col("l_linenumber") == KEYLESS_LINE_NUMBER, F.lit(None))
        .otherwise(F.col("l_orderkey"))
        .alias("id"),
        (F.col("l_orderkey") + 10000).alias("number"),
        F.col("l_extendedprice").alias("total_value"),
        *LOAD_ORDER,
    )
    return target, incoming


def insert_if_absent(spark, sf_dir):
    target, incoming = _loaded_and_incoming(spark, sf_dir)
    return load.insert_if_absent(target, incoming, "id", LOAD_ORDER)


def insert_rejected(spark, sf_dir):
    _, incoming = _loaded_and_incoming(spark, sf_dir)
    return load.rejected_rows(incoming, "id").select("number", "total_value", *LOAD_ORDER)


def bulk_load(spark, sf_dir):
    """Four tables loaded together, then read back: rows and key sum of each."""
    m = _model(spark, sf_dir)
    names = ["process_instances", "tax_documents", "items", "tasks"]
    base = shared_dir(spark, "bulk_load", f"{_tag(sf_dir)}-{uuid.uuid4().hex}")
    load.load_together(spark, base, {n: m.table(n) for n in names}, "b1")
    parts = [
        load.read_together(spark, base, n).agg(
            F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.sum("id").alias("key_sum")
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_pk(spark, sf_dir):
    return audit.audit_pk(_model(spark, sf_dir))


def audit_fk(spark, sf_dir):
    return audit.audit_fk(_model(spark, sf_dir))


def _audited_in_batches(spark, sf_dir):
    """The model's tables in three batches: everything but one key in five, with the
    documents twice; the rest; the second copies of the documents taken out."""
    model = _model(spark, sf_dir)
    late = F.coalesce(F.pmod("id", F.lit(5)) == 0, F.lit(False))
    first = {n: model.table(n).filter(~late) for n in model.names()}
    again = first["tax_documents"]
    first["tax_documents"] = again.unionByName(again)
    state = DeltaAudit.start(spark, shared_dir(spark, "audits", uuid.uuid4().hex), first, buckets=16)
    state = state.apply({n: model.table(n).filter(late) for n in model.names()})
    return state.apply({}, {"tax_documents": again})


def audit_pk_batches(spark, sf_dir):
    return _audited_in_batches(spark, sf_dir).audit_pk()


def audit_fk_batches(spark, sf_dir):
    return _audited_in_batches(spark, sf_dir).audit_fk()


def audit_status_pairs(spark, sf_dir):
    return audit.audit_status_pairs(_model(spark, sf_dir), spark)


# --- exports (S2, S3) --------------------------------------------------------

def export_report(spark, sf_dir):
    out_dir = shared_dir(spark, "exports", _tag(sf_dir))
    report = rep.report_last_month(_model(spark, sf_dir), AS_OF, materialize_keys=True)
    path = export.export_report(report, out_dir, AS_OF, fmt="csv")
    schema = StructType(
        [StructField(f.name, f.dataType, True) for f in report.schema.fields]
    )
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def filtered_export(spark, sf_dir):
    out_dir = shared_dir(spark, "exports", _tag(sf_dir))
    dash = _dashboard(spark, sf_dir)
    path = export.export_filtered(dash, out_dir, EXPORT_STAMP)
    schema = StructType(
        [StructField(f.name, f.dataType, True) for f in dash.schema.fields]
        + [StructField("posted_month", StringType(), True)]
    )
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _tag(sf_dir: str) -> str:
    """A folder name for one data folder: its last part and a digest of its whole path."""
    path = sf_dir.rstrip("/")
    return f"{path.rsplit('/', 1)[-1]}-{zlib.crc32(path.encode()):08x}"


# --- scalar functions (F1-F18) ------------------------------------------------

def fmt_date(spark, sf_dir):
    t = _model(spark, sf_dir).tasks
    return t.select("id", dates.format_ddmmyyyy("completed_at").alias("completed_on"))


def month_offset(spark, sf_dir):
    t = _model(spark, sf_dir).tasks
    day = dates.posting_day("completed_at")
    return t.select(
        "id",
        day.alias("posted_on"),
        dates.month_offset(day, -1).alias("one_month_before"),
        dates.month_offset(day, -3).alias("three_months_before"),
        F.trunc(day, "MM").alias("month_start"),
    )


def month_bounds(spark, sf_dir):
    t = _model(spark, sf_dir).tasks
    first, last = dates.previous_month_bounds(dates.posting_day("completed_at"))
    return t.select("id", first.alias("prev_month_first"), last.alias("prev_month_last"))


def lead_time_hours(spark, sf_dir):
    t = _model(spark, sf_dir).tasks
    return t.select("id", dates.lead_time_hours("created_at", "completed_at").alias("lead_time_hours"))


def posting_day(spark, sf_dir):
    t = _model(spark, sf_dir).tasks
    return t.select("id", dates.posting_day("completed_at").alias("posted_on"))


def shift_time(spark, sf_dir):
    t = _model(spark, sf_dir).tasks
    return t.select(
        "id",
        dates.shift_time("created_at", days=1).alias("created_plus_1d"),
        dates.shift_time("completed_at", hours=-2).alias("completed_minus_2h"),
    )


def cnpj_mask(spark, sf_dir):
    d = _model(spark, sf_dir).tax_documents
    return d.select(
        "id",
        cnpj.mask_cnpj("supplier_identification_number").alias("supplier_cnpj_masked"),
        cnpj.mask_cnpj("customer_identification_number").alias("customer_cnpj_masked"),
    )


def cnpj_unmask(spark, sf_dir):
    d = _model(spark, sf_dir).tax_documents
    masked = cnpj.mask_cnpj("supplier_identification_number")
    return d.select(
        "id",
        masked.alias("supplier_cnpj_masked"),
        cnpj.unmask_cnpj(masked).alias("supplier_cnpj_digits"),
    )


def round_money(spark, sf_dir):
    li = read_source(spark, sf_dir, "lineitem")
    net = money.as_money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        money.round_money(net, 2).cast("double").alias("net_value"),
    )


def even_split(spark, sf_dir):
    m = _model(spark, sf_dir)
    counts = m.items.groupBy(F.col("tax_document_id").alias("id")).agg(
        F.count(F.lit(1)).alias("item_count")
    )
    return m.tax_documents.join(counts, "id").select(
        "id", "item_count", money.even_split("total_value", "item_count").alias("item_share")
    )


def city_state_lookup(spark, sf_dir):
    m = _model(spark, sf_dir)
    docs = m.tax_documents.select("id", "supplier_city_id")
    return keys.lookup_with_default(
        docs, "supplier_city_id", m.cities, "id", "state_id",
        schemas.DEFAULT_STATE_ID, "supplier_state_id",
    ).select("id", "supplier_city_id", F.col("supplier_state_id").cast("long"))


def item_keys(spark, sf_dir):
    return _model(spark, sf_dir).items.select("id", "tax_document_id", "purchase_order")


QUERIES: dict[str, Query] = {
    "report_last_month": report_last_month,
    "report_one_per_document": report_one_per_document,
    "report_sql": report_sql,
    "success_postings": success_postings,
    "last_month_window": last_month_window,
    "docs_tasks_join": docs_tasks,
    "po_rollup": po_rollup,
    "po_rollup_streamed": po_rollup_streamed,
    "fact": fact,
    "fact_bucketed": fact_bucketed,
    "fact_clustered": fact_clustered,
    "fact_display": fact_display,
    "filter_period": filter_period,
    "filter_members": filter_members,
    "filtered_fact": filtered_fact,
    "facet_state": facet_state,
    "facets": facets,
    "period_bounds": period_bounds,
    "kpis": kpis,
    "distinct_documents": distinct_documents,
    "kpi_labels": kpi_labels,
    "spend_by_supplier": spend_by_supplier,
    "supplier_pareto_top10": supplier_pareto_top10,
    "geo_volume": geo_volume,
    "geo_rollup_share": geo_rollup_share,
    "daily_volume": daily_volume,
    "panel_grouping_sets": panel_grouping_sets,
    "lead_time_hist": lead_time_hist,
    "lead_time_hist_mean": lead_time_hist_mean,
    "factorised_kpis": factorised_kpis,
    "factorised_documents": factorised_documents,
    "factorised_spend": factorised_spend,
    "factorised_pareto": factorised_pareto,
    "factorised_geo_volume": factorised_geo_volume,
    "factorised_geo_rollup": factorised_geo_rollup,
    "factorised_daily_volume": factorised_daily_volume,
    "factorised_lead_time_hist": factorised_lead_time_hist,
    "factorised_lead_time_mean": factorised_lead_time_mean,
    "cube_kpis": cube_kpis,
    "cube_suppliers": cube_suppliers,
    "insert_if_absent": insert_if_absent,
    "insert_rejected": insert_rejected,
    "bulk_load": bulk_load,
    "audit_pk": audit_pk,
    "audit_fk": audit_fk,
    "audit_pk_batches": audit_pk_batches,
    "audit_fk_batches": audit_fk_batches,
    "audit_status_pairs": audit_status_pairs,
    "export_report": export_report,
    "filtered_export": filtered_export,
    "fmt_date": fmt_date,
    "month_offset": month_offset,
    "month_bounds": month_bounds,
    "lead_time_hours": lead_time_hours,
    "posting_day": posting_day,
    "shift_time": shift_time,
    "cnpj_mask": cnpj_mask,
    "cnpj_unmask": cnpj_unmask,
    "round_money": round_money,
    "even_split": even_split,
    "city_state_lookup": city_state_lookup,
    "item_keys": item_keys,
}
