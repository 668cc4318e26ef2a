"""KPIs of any selection from a stored cube, distinct suppliers included.

A cell is a (day, document type, task, status, state). Its spend, documents and lead times
are sums and add up over cells. Distinct suppliers do not, so each cell keeps its set of
them: suppliers are numbered once, and a set is one bitmap per bucket of 32,768 numbers.
The suppliers of a selection are the bits of the cells' bitmaps put together by OR, which
is exact. A selection reads cells only, neither the fact nor its tables.

Numbers go out in the order of (state, supplier), so that the suppliers of a state share
few buckets. Both tables are partitioned by month and sorted by day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalflow.functions.membership import isin_filter
from fiscalflow.operators.factorised import PROCESS, named_tasks, placed_documents, summed_documents, summed_tasks, timed
from fiscalflow.operators.filters import FilterSpec, document_predicates
from fiscalflow.operators.store import materialize
from fiscalflow.sources.model import Model

MONTH = "posted_month"
OF_DOCUMENT = ["document_type", "supplier_state"]
OF_TASK = ["posted_on", "task_name", "task_status"]
CELL = [*OF_TASK, *OF_DOCUMENT]
SUMS = ["spend", "documents", "lead", "measured"]


def numbered_suppliers(documents: DataFrame) -> DataFrame:
    """``(supplier_cnpj, supplier_no)``, stored, so that a number is given once: a task run
    again must not number anew. The numbers of a range follow each other. ``documents`` may
    be any rows of a supplier and its state."""
    known = documents.filter("supplier_cnpj is not null").groupBy("supplier_cnpj").agg(F.min("supplier_state").alias("state"))
    order = ["state", "supplier_cnpj"]
    ranged = known.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.select("supplier_cnpj", F.monotonically_increasing_id().alias("supplier_no")), "cube_suppliers")


def _stored(cells: DataFrame, name: str) -> DataFrame:
    """Written as it comes, then by month: sampling the ranges reads the first table."""
    cells = materialize(cells.withColumn(MONTH, F.date_format("posted_on", "yyyy-MM")), f"{name}_unsorted")
    return materialize(cells, name, [MONTH], ["posted_on"])


@dataclass(frozen=True)
class KpiCube:
    """The stored cells: ``sums`` has one row per cell, ``sets`` one per cell and bucket."""

    sums: DataFrame
    sets: DataFrame

    @classmethod
    def build(cls, model: Model, name: str = "kpi_cube") -> KpiCube:
        """Documents and tasks are reduced per process and the cell's columns, documents per
        supplier too, before they meet, so a process that holds a third of both makes no
        product of its rows. They meet once: sums per cell and supplier are stored, and
        sums, sets and the suppliers' numbers are made of those. A set is made of distinct
        (cell, number) pairs, at most 32,768 in a bucket, however many documents a supplier
        has. Rows without a completion day are in no selection."""
        documents = placed_documents(model).groupBy(PROCESS, *OF_DOCUMENT, "supplier_cnpj").agg(*summed_documents())
        tasks = named_tasks(model).select(PROCESS, "task_name", "task_status", *timed()).filter("posted_on is not null")
        tasks = tasks.groupBy(PROCESS, *OF_TASK).agg(*summed_tasks())
        met = documents.join(tasks, PROCESS).groupBy(*CELL, "supplier_cnpj").agg(
            F.sum(F.col("value") * F.col("n")).alias("spend"),
            F.sum(F.col("ids") * F.col("n")).alias("documents"),
            F.sum(F.col("lead") * F.col("docs")).alias("lead"),
            F.sum(F.col("measured") * F.col("docs")).alias("measured"),
        )
        met = materialize(met, f"{name}_suppliers")

        sums = met.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in SUMS])
        members = met.select(*CELL, "supplier_cnpj").join(numbered_suppliers(met), "supplier_cnpj")
        bucket = F.bitmap_bucket_number("supplier_no").alias("bucket")
        placed = members.select(*CELL, bucket, F.bitmap_bit_position("supplier_no").alias("position"))
        # one exchange of pairs; partial bitmaps of 4 KB per task would weigh more
        sets = placed.repartition(*CELL, "bucket").groupBy(*CELL, "bucket").agg(F.bitmap_construct_agg("position").alias("members"))
        return cls(_stored(sums, f"{name}_sums"), _stored(sets, f"{name}_sets"))

    def _selected(self, cells: DataFrame, spec: FilterSpec) -> DataFrame:
        return cells.filter(reduce(and_, [*_days(spec.period), *_names(spec), *document_predicates(spec)], F.lit(True)))

    def kpis(self, spec: FilterSpec = FilterSpec()) -> DataFrame:
        """``metrics.kpis`` of the selection."""
        totals = self._selected(self.sums, spec).agg(
            F.coalesce(F.sum("spend").cast("double"), F.lit(0.0)).alias("spend"),
            F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
            (F.sum("lead") / F.nullif(F.sum("measured"), F.lit(0))).alias("mean_lead_time_hours"),
        )
        return totals.withColumn("suppliers", self.suppliers(spec).scalar())

    def suppliers(self, spec: FilterSpec = FilterSpec(), by: Sequence[str] = ()) -> DataFrame:
        """Distinct suppliers of the selection, per value of the cell columns ``by`` (or
        ``posted_month``). A value whose documents name no supplier has no row."""
        together = self._selected(self.sets, spec).groupBy(*by, "bucket").agg(F.bitmap_or_agg("members").alias("members"))
        return together.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("members")), F.lit(0)).alias("suppliers"))


def _days(period: tuple | None) -> list[Column]:
    """The inclusive period on the day, and on the month, which prunes partitions."""
    days = [d if d is None or isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in period or (None, None)]
    month, day = F.col(MONTH), F.col("posted_on")
    lower = [] if days[0] is None else [month >= f"{days[0]:%Y-%m}", day >= F.lit(days[0])]
    upper = [] if days[1] is None else [month <= f"{days[1]:%Y-%m}", day <= F.lit(days[1])]
    return lower + upper


def _names(spec: FilterSpec) -> list[Column]:
    chosen = ((spec.tasks, "task_name"), (spec.statuses, "task_status"))
    return [isin_filter(column, values) for values, column in chosen if values is not None]
