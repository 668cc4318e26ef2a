"""Dashboard filters, facet values and period bounds over the fact."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalflow.functions.membership import isin_filter

# facet name -> fact column, in display order
FACETS = {
    "document_type": "document_type",
    "task_name": "task_name",
    "task_status": "task_status",
    "supplier_state": "supplier_state",
}


@dataclass(frozen=True)
class FilterSpec:
    """The five dashboard filters, ANDed.

    ``None`` means the dashboard default (everything offered by the facet):

    * period: the days present, i.e. a row without a completion day is dropped;
      either end of an explicit period may be None (open);
    * types / tasks / statuses: no restriction, null cells kept;
    * states: every known state, so a row without a state is dropped (the state
      facet offers no null).

    An explicit list is a null-safe membership test: None in the list matches null
    cells, an empty list keeps nothing.
    """

    period: tuple[dt.date | None, dt.date | None] | None = None
    types: Sequence[str | None] | None = None
    tasks: Sequence[str | None] | None = None
    statuses: Sequence[str | None] | None = None
    states: Sequence[str | None] | None = None


def _as_date(d) -> dt.date | None:
    if d is None or isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(d)


def period_predicate(period: tuple | None) -> Column:
    """Inclusive day range, written on the raw ``completed_at`` so it is pushed to
    the scan: ``day >= lo`` is ``completed_at >= lo 00:00`` and ``day <= hi`` is
    ``completed_at < (hi + 1 day) 00:00``. A null completion never passes.

    The bounds are DATE literals cast to TIMESTAMP_NTZ - a zone-free conversion. (A
    Python datetime literal would be a zoned timestamp, shifted by the session time
    zone when cast.)"""
    ts = F.col("completed_at")
    pred = ts.isNotNull()
    if period is None:
        return pred
    lo, hi = (_as_date(p) for p in period)
    if lo is not None:
        pred = pred & (ts >= F.lit(lo).cast("timestamp_ntz"))
    if hi is not None:
        pred = pred & (ts < F.lit(hi + dt.timedelta(days=1)).cast("timestamp_ntz"))
    return pred


def day_predicate(period: tuple | None) -> Column:
    """``period_predicate`` as a condition on the posting day, for stored facts: Parquet
    compares dates with its statistics and skips row groups, but no zone-less timestamps."""
    day = F.col("posted_on")
    pred = day.isNotNull()
    lo, hi = (None, None) if period is None else (_as_date(p) for p in period)
    if lo is not None:
        pred = pred & (day >= F.lit(lo))
    if hi is not None:
        pred = pred & (day <= F.lit(hi))
    return pred


def task_predicates(spec: FilterSpec) -> list[Column]:
    """The filters on a task: period, name and status."""
    named = ((spec.tasks, "task_name"), (spec.statuses, "task_status"))
    return [period_predicate(spec.period), *(isin_filter(column, values) for values, column in named if values is not None)]


def document_predicates(spec: FilterSpec) -> list[Column]:
    """The filters on a document: type and the supplier's state."""
    types = [] if spec.types is None else [isin_filter("document_type", spec.types)]
    known = F.col("supplier_state").isNotNull() if spec.states is None else isin_filter("supplier_state", spec.states)
    return [*types, known]


def filter_predicates(spec: FilterSpec) -> list[Column]:
    return task_predicates(spec) + document_predicates(spec)


def apply_filters(fact: DataFrame, spec: FilterSpec) -> DataFrame:
    """One conjunctive filter over the fact (Catalyst pushes each conjunct to the
    table it reads: period to tasks, type to documents, state to geography)."""
    return fact.filter(reduce(and_, filter_predicates(spec)))


def filter_period(fact: DataFrame, lo, hi) -> DataFrame:
    """Only the inclusive day-range filter."""
    return fact.filter(period_predicate((lo, hi)))


def filter_members(fact: DataFrame, spec: FilterSpec) -> DataFrame:
    """Only the membership filters of ``spec`` (lists left None are not applied)."""
    preds = [
        isin_filter(column, values)
        for values, column in (
            (spec.types, "document_type"),
            (spec.tasks, "task_name"),
            (spec.statuses, "task_status"),
            (spec.states, "supplier_state"),
        )
        if values is not None
    ]
    return fact.filter(reduce(and_, preds)) if preds else fact


def facets(fact: DataFrame) -> DataFrame:
    """(facet, value) for every value offered by each multi-select, in one pass.

    Null is a value of the type, task and status facets; the state facet drops it.
    One explode + distinct: the distinct is partially aggregated map-side, so the
    shuffle carries at most one row per distinct value and map partition.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("facet"), F.col(column).alias("value"))
            for name, column in FACETS.items()
        ]
    )
    return (
        fact.select(F.explode(pairs).alias("f"))
        .select("f.facet", "f.value")
        .filter(~((F.col("facet") == "supplier_state") & F.col("value").isNull()))
        .distinct()
    )


def facet_values(fact: DataFrame, column: str, drop_null: bool = False) -> DataFrame:
    """Distinct values of one facet column."""
    out = fact.select(column)
    if drop_null:
        out = out.filter(F.col(column).isNotNull())
    return out.distinct()


def period_bounds(fact: DataFrame) -> DataFrame:
    """First and last posting day (nulls skipped), the default period."""
    return fact.agg(
        F.min("posted_on").alias("first_day"), F.max("posted_on").alias("last_day")
    )
