"""The interactive dashboard flow: the fact is built once and stored, then every
interaction (a FilterSpec) is a filter on the stored table plus small aggregates.

The stored fact is partitioned by posting month; a period selection adds a
predicate on the partition column, so only the months in range are read, and on the
day, so that within them row groups of other days are skipped.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.operators import filters, metrics
from fiscalflow.operators.fact import build_fact
from fiscalflow.operators.filters import FilterSpec
from fiscalflow.operators.store import materialize, read_stored, replace_partitions, store
from fiscalflow.sources.model import Model

MONTH = "posted_month"


def _rows(model: Model) -> DataFrame:
    """The fact as stored: with its process id and posting month."""
    return build_fact(model, with_process=True).withColumn(MONTH, F.date_format("posted_on", "yyyy-MM"))


def _month(d) -> str | None:
    if d is None:
        return None
    if not isinstance(d, dt.date):
        d = dt.date.fromisoformat(d)
    return f"{d:%Y-%m}"


@dataclass(frozen=True)
class Dashboard:
    """The stored fact and the analytics over a selection of it."""

    fact: DataFrame
    path: str

    @classmethod
    def refresh(cls, model: Model, name: str = "dashboard_fact") -> Dashboard:
        """Build the fact and store it (the explicit refresh of the cache). It is written
        as it comes first, so that sampling the month ranges reads a table and does not
        run the fact's joins a second time."""
        fact = materialize(_rows(model), f"{name}_unsorted")
        return cls._at(fact, store(fact, name, partition_by=[MONTH], sort_within=["completed_at"]))

    @classmethod
    def _at(cls, like: DataFrame, path: str) -> Dashboard:
        return cls(read_stored(like.sparkSession, path, like.schema, [MONTH]).select(*like.columns), path)

    def refresh_changed(self, model: Model, changed: DataFrame) -> Dashboard:
        """The dashboard after changes to the processes in ``changed`` (a column
        ``process_instance_id``; a document or task that moved names both): equal to a
        full ``refresh`` of ``model`` if nothing else changed.

        Only the changed processes' documents and tasks meet in the join, and only the
        months that hold a row of them, before or after, are written anew, by dynamic
        partition overwrite. All other months keep their files. The new rows are stored
        before anything is overwritten; a refresh that failed may be run again. The
        number of months that come to the driver is that of the changed rows."""
        ids = changed.select("process_instance_id").filter("process_instance_id is not null").distinct()
        ids = materialize(ids, "dashboard_changed")
        mine = lambda table: table.join(ids, "process_instance_id", "left_semi")
        new = materialize(_rows(model.with_tables(tax_documents=mine(model.tax_documents), tasks=mine(model.tasks))), "dashboard_new_rows")
        touched = {r[0] for r in mine(self.fact).select(MONTH).unionByName(new.select(MONTH)).distinct().collect()}
        months = F.col(MONTH).isin([m for m in touched if m is not None])
        held = self.fact.filter(months | F.col(MONTH).isNull() if None in touched else months)
        kept = held.join(ids, "process_instance_id", "left_anti").select(*self.fact.columns)
        rows = materialize(kept.unionByName(new), "dashboard_touched_months")
        left = {r[0] for r in rows.select(MONTH).distinct().collect()}
        replace_partitions(rows, self.path, MONTH, sorted(touched - left, key=str), ["completed_at"])
        return self._at(rows, self.path)

    def select(self, spec: FilterSpec) -> DataFrame:
        """The filtered fact (13 columns), reading only the months in the period."""
        preds = [*filters.filter_predicates(spec), filters.day_predicate(spec.period)]
        month = F.col(MONTH)
        preds.append(month.isNotNull())
        if spec.period is not None:
            lo, hi = (_month(p) for p in spec.period)
            if lo is not None:
                preds.append(month >= lo)
            if hi is not None:
                preds.append(month <= hi)
        selected = self.fact
        for p in preds:
            selected = selected.filter(p)
        return selected.drop(MONTH, "process_instance_id")

    def facets(self) -> DataFrame:
        return filters.facets(self.fact)

    def period_bounds(self) -> DataFrame:
        return filters.period_bounds(self.fact)

    def panels(self, spec: FilterSpec) -> dict[str, DataFrame]:
        """KPIs and the four panels of one interaction (lazy DataFrames)."""
        selected = self.select(spec)
        return {
            "kpis": metrics.kpis(selected),
            "supplier_pareto": metrics.supplier_pareto(selected),
            "geo_rollup_share": metrics.geo_rollup_share(selected),
            "lead_time_hist": metrics.stored_lead_time_histogram(selected),
            "lead_time_summary": metrics.lead_time_summary(selected),
            "daily_volume": metrics.daily_volume(selected),
            # spend / geography / daily in one GROUPING SETS pass
            "panel_aggregates": metrics.panel_aggregates(selected),
        }
