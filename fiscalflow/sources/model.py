"""The invoice model as a bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalflow import schemas

Table = DataFrame | Callable[[], DataFrame]
# Day of ``completed_at``, which stored tasks may carry beside the schema's columns.
COMPLETION_DAY = "completed_on"


class Model:
    """The ten tables of the invoice model, as attributes.

    ``tax_documents``, ``items`` and ``tasks`` are the large tables; the others are
    small dimensions (geography) or fixed code tables. A table may be given as a function
    that makes it: it is called when the table is first used, so that a query opens only
    the sources of the tables it reads.
    """

    def __init__(self, dated_tasks: DataFrame | None = None, **tables: Table):
        """``dated_tasks``: the tasks with their ``COMPLETION_DAY``, if they are stored so."""
        if set(tables) != set(schemas.SCHEMAS):
            raise TypeError(f"a model has the tables {', '.join(schemas.SCHEMAS)}")
        self._tables = tables
        self._dated_tasks = dated_tasks

    def table(self, name: str) -> DataFrame:
        made = self._tables[name]
        if not isinstance(made, DataFrame):
            made = self._tables[name] = made()
        return made

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schemas.SCHEMAS:
            raise AttributeError(name)
        return self.table(name)

    def names(self) -> list[str]:
        return list(self._tables)

    def with_tables(self, **tables: Table) -> Model:
        """The same model with some tables replaced."""
        return Model(None if "tasks" in tables else self._dated_tasks, **(self._tables | tables))

    def tasks_between(self, lo: Column, hi: Column) -> DataFrame:
        """The tasks completed in [lo, hi). Where they are stored with their day, the scan
        skips row groups by it: Parquet compares dates with its statistics, but no
        zone-less timestamps."""
        done = F.col("completed_at")
        inside = (done >= lo) & (done < hi)
        if self._dated_tasks is None:
            return self.tasks.filter(inside)
        day = F.col(COMPLETION_DAY)  # the day of hi may still hold rows before it
        return self._dated_tasks.filter(inside & (day >= lo.cast("date")) & (day <= hi.cast("date"))).drop(COMPLETION_DAY)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.SCHEMAS[name])


def conform(df: DataFrame, name: str, keep: Iterable[str] = ()) -> DataFrame:
    """Select and cast the columns of ``df`` to the model schema of ``name``, with the
    columns ``keep`` after them. A column that ``df`` lacks is an error: a misspelt
    source must not become nulls."""
    schema = schemas.SCHEMAS[name]
    missing = [field.name for field in schema.fields if field.name not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks the columns {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *keep)


def model_from_tables(
    spark: SparkSession, tables: dict[str, DataFrame], empty_tables: Iterable[str] = ()
) -> Model:
    """Build a Model from DataFrames named like the model tables.

    Code tables default to the fixed ones. Any other table must be given, or be named
    in ``empty_tables``; an unknown or forgotten name is an error.
    """
    empty_tables = set(empty_tables)
    if unknown := ({*tables} | empty_tables) - {*schemas.SCHEMAS}:
        raise ValueError(f"no such tables: {', '.join(sorted(unknown))}")
    defaults = {
        "task_definitions": lambda: schemas.task_definitions_df(spark),
        "status": lambda: schemas.status_df(spark),
    }
    built: dict[str, Table] = {}
    for name in schemas.SCHEMAS:
        if name in tables:
            built[name] = conform(tables[name], name)
        elif name in defaults:
            built[name] = defaults[name]
        elif name in empty_tables:
            built[name] = empty(spark, name)
        else:
            raise ValueError(f"table {name} is neither given nor named as empty")
    return Model(**built)
