"""The dashboard's KPIs and panels without the documents x tasks product.

The fact repeats every document once per task of its process, and every aggregate of it
factors over the process: of m documents and n tasks there are m x n rows, their spend is
n times the documents' spend, their lead times sum up to m times the tasks' lead times,
and so on. Both sides are therefore reduced per process first (and per supplier, city, day
or lead time where a panel asks for it), filtered before that, and the reduced rows meet
in one join. A process that holds a third of all documents and of all tasks is one row, or
one row per distinct value, on either side: nothing multiplies.

Results equal those of ``metrics`` over ``filters.apply_filters(build_fact(model), spec)``.
Means divide exact sums of the same values, in another order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalflow.functions.cnpj import mask_cnpj
from fiscalflow.functions.dates import lead_time_hours, posting_day
from fiscalflow.functions.money import SUMMAND
from fiscalflow.operators import metrics
from fiscalflow.operators.fact import supplier_geography
from fiscalflow.operators.filters import FilterSpec, document_predicates, task_predicates
from fiscalflow.sources.model import Model

PROCESS = "process_instance_id"


def placed_documents(model: Model) -> DataFrame:
    """Documents of a process: process, id, value, supplier and its place."""
    docs = model.tax_documents.filter(F.col(PROCESS).isNotNull()).select(
        PROCESS, "id", "total_value", F.col("type").alias("document_type"),
        F.col("supplier_identification_number").alias("supplier_cnpj"), "supplier_city_id",
    )
    return docs.join(supplier_geography(model), F.col("supplier_city_id") == F.col("city_id"), "left")


def document_side(model: Model, spec: FilterSpec) -> DataFrame:
    """The selected documents."""
    return placed_documents(model).filter(reduce(and_, document_predicates(spec), F.lit(True)))


def named_tasks(model: Model) -> DataFrame:
    """Tasks of a process with a known definition and status, and their names."""
    names = model.task_definitions.select(F.col("id").alias("task_definition_id"), F.col("name").alias("task_name"))
    states = model.status.select(F.col("id").alias("status_id"), F.col("name").alias("task_status"))
    tasks = model.tasks.filter(F.col(PROCESS).isNotNull()).select(PROCESS, "created_at", "completed_at", "task_definition_id", "status_id")
    return tasks.join(names, "task_definition_id").join(states, "status_id")


def task_side(model: Model, spec: FilterSpec) -> DataFrame:
    """The selected tasks: process, lead time, day."""
    return named_tasks(model).filter(reduce(and_, task_predicates(spec), F.lit(True))).select(PROCESS, *timed())


def timed() -> list[Column]:
    return [lead_time_hours("created_at", "completed_at").alias("lead_time_hours"), posting_day("completed_at").alias("posted_on")]


def summed_documents() -> list[Column]:
    """Documents, documents with an id, their value."""
    value = F.coalesce(F.sum(F.col("total_value").cast(SUMMAND)), F.lit(0).cast(SUMMAND))
    return [F.count(F.lit(1)).alias("docs"), F.count("id").alias("ids"), value.alias("value")]


def summed_tasks() -> list[Column]:
    """Tasks, and the sum and number of their lead times."""
    return [F.count(F.lit(1)).alias("n"), F.sum("lead_time_hours").alias("lead"), F.count("lead_time_hours").alias("measured")]


class FactorisedPanels:
    """KPIs and panels of one selection, each as one lazy DataFrame."""

    def __init__(self, model: Model, spec: FilterSpec = FilterSpec()):
        self.documents = document_side(model, spec)
        self.tasks = task_side(model, spec)

    def _documents(self, *keys: str) -> DataFrame:
        return self.documents.groupBy(PROCESS, *keys).agg(*summed_documents())

    def _tasks(self, *keys: str) -> DataFrame:
        return self.tasks.groupBy(PROCESS, *keys).agg(*summed_tasks())

    def kpis(self) -> DataFrame:
        met = self._documents("supplier_cnpj").join(self._tasks(), PROCESS)
        rows = F.sum(F.col("docs") * F.col("measured"))
        return met.agg(
            F.coalesce(F.sum(F.col("value") * F.col("n")).cast("double"), F.lit(0.0)).alias("spend"),
            F.coalesce(F.sum(F.col("ids") * F.col("n")), F.lit(0)).alias("documents"),
            (F.sum(F.col("lead") * F.col("docs")) / F.nullif(rows, F.lit(0))).alias("mean_lead_time_hours"),
            F.count_distinct("supplier_cnpj").alias("suppliers"),
        )

    def distinct_documents(self) -> DataFrame:
        """Documents, each once, of processes that have a selected task."""
        known = self.documents.join(self._tasks().select(PROCESS), PROCESS, "left_semi")
        return known.agg(F.count_distinct("id").alias("distinct_documents"))

    def spend_by_supplier(self) -> DataFrame:
        masked = mask_cnpj("supplier_cnpj").alias("supplier_cnpj_masked")
        met = self._documents("supplier_cnpj").join(self._tasks(), PROCESS)
        return met.groupBy(masked).agg(F.sum(F.col("value") * F.col("n")).cast("double").alias("spend"))

    def supplier_pareto(self, top: int = metrics.PARETO_TOP) -> DataFrame:
        return self.spend_by_supplier().orderBy(F.col("spend").desc(), F.col("supplier_cnpj_masked").asc()).limit(top)

    def geo_volume(self) -> DataFrame:
        return self._places().groupBy("supplier_state", "supplier_city").agg(F.sum("rows").alias("volume"))

    def _places(self) -> DataFrame:
        per_place = self._documents("supplier_state", "supplier_city").filter("supplier_state is not null and supplier_city is not null")
        return per_place.join(self._tasks(), PROCESS).select("supplier_state", "supplier_city", (F.col("docs") * F.col("n")).alias("rows"))

    def geo_rollup_share(self) -> DataFrame:
        return metrics.share_of_rollup(self._places(), F.sum("rows"))

    def daily_volume(self) -> DataFrame:
        met = self._tasks("posted_on").filter("posted_on is not null").join(self._documents(), PROCESS)
        return met.groupBy("posted_on").agg(F.sum(F.col("n") * F.col("ids")).alias("documents")).orderBy("posted_on")

    def _lead_times(self) -> DataFrame:
        """``(lead_time_hours, documents)``: fact rows per distinct lead time."""
        met = self._tasks("lead_time_hours").filter("lead_time_hours is not null").join(self._documents(), PROCESS)
        return met.groupBy("lead_time_hours").agg(F.sum(F.col("n") * F.col("docs")).alias("documents"))

    def lead_time_histogram(self, bins: int = metrics.HIST_BINS) -> DataFrame:
        return metrics.histogram_of_counts(self._lead_times(), bins)

    def lead_time_summary(self, bins: int = metrics.HIST_BINS) -> DataFrame:
        hours, rows = F.col("lead_time_hours"), F.col("documents")
        return metrics.with_bin_width(
            self._lead_times().agg(
                F.min(hours).alias("lead_time_min"), F.max(hours).alias("lead_time_max"),
                (F.sum(hours * rows) / F.sum(rows)).alias("mean_lead_time_hours"),
                F.coalesce(F.sum(rows), F.lit(0)).alias("measured"),
            ),
            bins,
        )
